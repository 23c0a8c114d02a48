import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np

from packetspark.llm import components, neardup, repeats
from support import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def classes(rows, k=4):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None:
                continue
            both = len(sets[i] & sets[j])
            if rows[i][0] == rows[j][0] or (both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both)):
                parent[find(i)] = find(j)
    low = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        low[find(i)].append(d)
    return Counter((d, len(sets[i]), None if d is None else min(low[find(i)])) for i, (d, _) in enumerate(rows))


def near_rows():
    """Chains: each text differs from the one before by a few words, the ends from each other by many; and a crowd around one text."""
    rnd, rows = random.Random(5), []
    words = prose(7, 200).split()
    for i in range(12):
        rows.append((100 + i, " ".join(words)))
        words = list(words)
        words[(i * 17) % 200] = f"new{i}"
        words[(i * 17 + 60) % 200] = f"old{i}"
    base = prose(8, 150).split()
    for i in range(40):
        w = list(base)
        for _ in range(rnd.randint(1, 9)):
            w[rnd.randrange(150)] = f"edit{rnd.randint(0, 999)}"
        rows.append((200 + i, " ".join(w)))
    rows += [(300 + i, prose(50 + i, 80)) for i in range(20)] + [(400, rows[0][1].upper()), (401, rows[0][1].replace(" ", "\n\t"))]
    return rows


def found(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def test_near_duplicates_against_brute_force(spark, odd, odd_clashing, empty):
    docs = spark.createDataFrame(near_rows(), "doc_id long, text string").repartition(4)
    assert found(neardup.near_duplicates(docs)) == classes([tuple(r) for r in docs.collect()])
    assert found(neardup.near_duplicates(odd_clashing)) == classes([(r.doc_id, r.text) for r in odd.collect()])
    assert neardup.near_duplicates(empty).count() == 0


def test_rows_of_one_id_lose_no_link(spark):
    """Each text of an id links, whichever order the rows come in."""
    a, b = prose(60, 120), prose(61, 120)
    rows = [(1, a), (1, b), (2, a), (3, b), (5, b + " y"), (7, prose(62, 90)), (8, ""), (7, b + " y z"), (8, a + " x"), (None, a)]
    for turn in (rows, rows[::-1]):
        docs = spark.createDataFrame(turn, "doc_id long, text string").repartition(3)
        got = found(neardup.near_duplicates(docs))
        assert got == classes(turn) and {c for d, _, c in got if d is not None} == {1}


def test_small_blocks_and_shares(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    monkeypatch.setattr(neardup, "MEMBERS", 3)
    docs = spark.createDataFrame(near_rows(), "doc_id long, text string")
    assert found(neardup.near_duplicates(docs)) == classes([tuple(r) for r in docs.collect()])


def test_possible_pairs_are_exact_for_small_sets():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 32, 400, dtype=np.uint32)
    sets = [np.unique(rng.choice(pool, rng.integers(1, 300))) for _ in range(40)]
    may = neardup.possible(sets, np.array([len(s) for s in sets]))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            both = len(np.intersect1d(a, b))
            assert may[i, j] == (100 * both >= 80 * (len(a) + len(b) - both))


def test_one_of_each_keeps_one_row(odd, empty):
    rows = neardup.one_of_each(odd).collect()
    ids = [r.doc_id for r in rows if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and 1 in ids and 2 not in ids and ids.count(9) == 1
    assert sum(r.doc_id is None for r in rows) == 2 and rows[0].__fields__ == odd.columns
    assert neardup.one_of_each(empty).count() == 0


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(200, 100), (5, 5), (300, 200)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[300] == 100 and got[100] == 100


def removed(rows, n=200):
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(b[i:i + n] for b in texts for i in range(len(b) - n + 1))
    out = Counter()
    for (d, _), b in zip(rows, texts):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            if count[b[i:i + n]] > 1:
                gone[i:i + n] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + (len(b) > 0 and bool(gone[0])))
        out[d, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()] += 1
    return out


def passage_rows():
    rnd = random.Random(3)
    text = lambda n: "".join(rnd.choice("abcdefgh \n") for _ in range(n))
    p, q, z = text(500), text(199), text(200)
    texts = [p + text(50) + p, "a" * 700, "ab" * 400, text(100) + z + text(3), z, q + "x" + text(9), text(7) + q + "y", None, "", "short", text(300) + p[100:330], "é" * 300,
             p[:210] + text(40) + p[250:], text(30) + p[40:239] + "!", ("xyz " * 30 + p[:150]) * 2, "a" * 200, text(1000), text(3000) + p + text(5000) + p, "ab" * 4000]
    return list(enumerate(texts)) + [(4, z), (None, p), (None, None)]


def told(df):
    return Counter(tuple(r) for r in df.collect())


def test_repeated_passages_against_brute_force(spark, monkeypatch, small, odd_clashing, empty):
    docs = spark.createDataFrame(passage_rows(), "doc_id long, text string")
    want = removed(passage_rows())
    assert told(repeats.report(docs)) == want
    monkeypatch.setattr(repeats, "SEGMENT", 2048)  # texts longer than a segment
    assert told(repeats.report(docs)) == want
    monkeypatch.setattr(repeats, "CONTEXTS", 1)  # every shared core as rows
    assert told(repeats.report(docs)) == want
    for some in (small, odd_clashing):
        assert told(repeats.report(some)) == removed([(r.doc_id, r.text) for r in some.select("doc_id", "text").collect()])
    assert repeats.report(empty).count() == 0
