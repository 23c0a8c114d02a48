import hashlib
import random
import re
from collections import Counter

import numpy as np

from packetspark.llm import debruijn as D
from support import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows):
    """Every window of every document, compared as words."""
    texts = [WORD.findall(t or "") for _, t in rows]
    least = {}
    for (d, _), w in zip(rows, texts):
        for i in range(len(w) - 12 if d is not None else 0):
            key = tuple(w[i:i + 13])
            least[key] = min(d, least.get(key, d))
    out = Counter()
    for (d, _), w in zip(rows, texts):
        gone = [False] * len(w)
        for i in range(len(w) - 12 if d is not None else 0):
            if least[tuple(w[i:i + 13])] < d:
                gone[i:i + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


def found(df):
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def tangled_rows():
    """Copies, passages in other surroundings, edits, loops, periods, near misses of twelve words."""
    rnd = random.Random(3)
    base = prose(1, 300).split()
    rows = [(50, " ".join(base)), (10, " ".join(base)), (30, "\n".join(base).upper())]
    for i in range(40):
        w = prose(100 + i, rnd.randint(5, 120)).split()
        a = rnd.randrange(250)
        w[rnd.randint(0, len(w)):0] = base[a:a + rnd.choice([11, 12, 13, 14, 20, 50, 200])]
        rows.append((100 + (i * 7) % 41, " ".join(w)))
    for i in range(20):
        w = list(base)
        for _ in range(rnd.randint(1, 12)):
            w[rnd.randrange(300)] = f"edit{rnd.randint(0, 5)}"
        rows.append((200 - i, "\t ".join(w)))
    rows += [(300, "a b " * 40), (299, "b a " * 30), (301, "a " * 100), (302, "a " * 12), (303, "a " * 13), (298, " ".join(base[20:60] * 5)), (305, " ".join(base[20:60] * 2)),
             (306, "x" * 9000 + " " + " ".join(base[:30])), (307, "x" * 9000 + " " + " ".join(base[:30])), (308, "ü é " * 30), (309, "é ü " * 30)]
    return rows


def test_against_brute_force(spark, odd, odd_clashing, empty):
    docs = spark.createDataFrame(tangled_rows(), "doc_id long, text string").repartition(5)
    assert found(D.deduplicated(docs)) == plain(tangled_rows())
    assert found(D.deduplicated(odd_clashing)) == plain([(r.doc_id, r.text) for r in odd.collect()])
    assert D.deduplicated(empty).count() == 0


def test_cut_into_small_pieces(spark, monkeypatch):
    """Where texts and runs are cut does not matter."""
    rows = tangled_rows()
    rnd = random.Random(9)
    texts = [t.encode() for _, t in rows]
    whole = sum(r.n.sum() for r in D.runs_of(texts))
    monkeypatch.setattr(D, "WORDS", 37)
    small = list(D.runs_of(texts))
    assert whole == sum(r.n.sum() for r in small)
    edges = Counter()
    for r in small:
        edges.update(np.concatenate([r.edges[e:e + n] for e, n in zip(r.edge_of, r.n)]).tolist())
    monkeypatch.setattr(D, "WORDS", 1 << 19)
    for r in D.runs_of(texts):
        edges.subtract(np.concatenate([r.edges[e:e + n] for e, n in zip(r.edge_of, r.n)]).tolist())
    assert not any(edges.values()) and rnd


def test_paths_are_compacted(spark):
    """A copied passage is a path or two, not its windows, and is judged by its source."""
    a = prose(5, 400)
    docs = spark.createDataFrame([(3, a), (1, a), (2, prose(6, 50) + " " + a + " " + prose(7, 50))], "doc_id long, text string")
    rows = docs.select(docs.doc_id.alias("doc"), docs.doc_id.alias("key"), docs.text.cast("binary").alias("text"))
    every = spark.sparkContext.broadcast(np.full(D.BITS // 8, 255, np.uint8))
    found_runs = rows.mapInArrow(D._likely(every), "core long, run long, doc long, key long, at int, n int, follows long, precedes long")
    path = D.paths(found_runs)[0].collect()
    assert len(path) == 1 and path[0]["doc"] == 1 and path[0]["occurrences"] == 3 and path[0]["n"] > 360


def test_whole_small_table(spark, small):
    want = plain([(r.doc_id, r.text) for r in small.select("doc_id", "text").collect()])
    assert found(D.op12_debruijn(spark, "/root/testdata/sf0.001")) == want
