import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest

from packetspark.llm import ann, pii, quality, suffixtree
from support import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# quality ---------------------------------------------------------------------------------------------------------

def labelled(n=600):
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        text = prose(i, 40)
        if bad:
            text += " vileword and vilest" if i % 8 else " #### $$$$ %%%%" * 12
        rows.append((i, text, "en", f"host{i % 5}", 0))
        labels.append((i, int(not bad), 0))
    return rows, labels


def test_classifier_on_held_out_documents(spark, odd_clashing, empty):
    rows, labels = labelled()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    known = spark.createDataFrame(labels[:400], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality.classify(docs, known).collect()}
    right = [out[i].kept == (i % 4 != 0) for i in range(400, 600)]
    assert sum(right) >= 196 and all(out[i].kept for i in range(600) if i % 4)
    kept = quality.good_documents(docs, known)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if r.kept}
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.classify(odd_clashing, none).where("kept").count() == odd_clashing.count()  # no labels, no evidence
    null = spark.createDataFrame([(1, None, None), (1, 1, 0), (None, 0, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.classify(odd_clashing, null).count() == odd_clashing.count()
    assert quality.classify(empty, known).count() == 0 and quality.good_documents(empty, known).count() == 0


def test_path_comes_from_the_url_where_there_is_one(spark):
    rows, labels = labelled(200)
    urls = ["https://h.org/blog/1", "//h.org/news?x=/blog/", "http://h.org", None]
    want = ["/blog", "/news", "", None]
    docs = spark.createDataFrame([(*row, urls[row[0] % 4]) for row in rows], "doc_id long, text string, lang string, source string, n_chars long, url string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = quality.classify(docs, known).collect()
    assert len(out) == 200 and all(r.path == want[r.doc_id % 4] for r in out)
    assert {r.doc_id for r in quality.good_documents(docs, known).collect()} == {r.doc_id for r in out if r.kept}


def test_sparse_sites_shrink_towards_their_host(spark):
    rows = [(i, "h", "en", 0.0, 1) for i in range(400)] + [(i + 400, "h", "xx", 0.0, 1) for i in range(2)] + [(i + 500, "g", "en", 0.0, 0) for i in range(400)] + [(i + 900, "g", "xx", 0.0, 1) for i in range(1)]
    scored = spark.createDataFrame([(a, b, c, e) for a, b, c, e, _ in rows], "doc_id long, host string, path string, evidence double")
    known = spark.createDataFrame([(a, x) for a, *_, x in rows], "doc_id long, bad int")
    rates = {(r._host, r._path): (r.host_rate, r.path_rate) for r in quality.site_rates(scored, known).collect()}
    assert rates["h", "en"][1] > 0.9 and rates["g", "en"][1] < 0.1
    assert rates["g", "xx"][1] < 0.7 and abs(rates["g", "xx"][1] - rates["g", "xx"][0]) < 1 - rates["g", "xx"][0]  # one bad document is not a rate of 1


# personal data ---------------------------------------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base(text):
    text = text or ""
    only = lambda m: re.sub("[^0-9]", "", m[0])
    return [[m.span() for m in EMAIL.finditer(text)], [m.span() for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))],
            [m.span() for m in CARD.finditer(text) if 13 <= len(only(m)) <= 19 and luhn(only(m))], [m.span() for m in PHONE.finditer(text) if 9 <= len(only(m)) <= 15]]


TEXTS = ["a@b.c%d@e.f", "a..b@c", "x@y.z.", "1.2.3.4.5.6.7.8", "001.002.003.0255 300.1.1.1", "4111 1111 1111 1111", "4111111111111111 4111-1111-1111-1111x", "+1 (927) 555-7911 +12345678901234567",
         "+1+2345678901", "😀 a@b.co é+49 123 456 789", "1" * 20000, "a" * 20000 + "@", "a@b.c" * 300, "1.1.1.1" * 200, "", None, "@@@", "a@b.c@d.e@f.g", "+1 2 3 4 5 6 7 8 9 ",
         "9.9.9.9..8.8.8.8", " 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "1 " * 10000]


def test_base_spans_against_brute_force(spark, small, odd_clashing, empty):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for docs in (rows, small, odd_clashing):
        want = Counter()
        for r in docs.select("doc_id", "text").collect():
            found = base(r.text)
            text = ",".join(f"{k}:{a}:{b}" for k, spans in zip(pii.KINDS, found) for a, b in spans)
            want[(r.doc_id, *map(len, found), hashlib.sha256(text.encode()).hexdigest())] += 1
        out = pii.report(docs).collect()
        assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in out) == want
        assert all(hashlib.sha256(",".join(s for s in r.spans.split(",") if s and not s.startswith("secret")).encode()).hexdigest() == r.base_sha256 for r in out)
    assert pii.report(empty).count() == 0 and pii.redact(empty).count() == 0


def test_secrets_are_added_and_long_words_are_not(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(300):
        text = prose(i, 20) + " incomprehensibilities counterrevolutionaries"
        if i % 5 == 0:
            text += f' token = "{rng.bytes(16).hex()}" end'
        if i % 7 == 0:
            text += " AKIA" + "".join(rng.choice(list("ABCDEFGHIJ234567"), 16)) + " end"
        rows.append((i, text))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in pii.report(docs).collect()}
    assert all(out[i].n_secret == (i % 5 == 0) + (i % 7 == 0) for i in range(300))
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert "[SECRET]" in clean[0] and "AKIA" not in clean[7] and clean[1] == rows[1][1]


def test_redaction_of_overlaps_and_nulls(spark, odd_clashing):
    docs = spark.createDataFrame([(1, "😀 a@b.co and 10.0.0.1, +49 123 456 789.", "x"), (2, None, None), (3, "", "y")], "doc_id long, text string, words string")
    out = {r.doc_id: (r.text, r.words) for r in pii.redact(docs).collect()}
    assert out == {1: ("😀 [EMAIL] and [IP], [PHONE].", "x"), 2: (None, None), 3: ("", "y")}
    assert pii.redact(odd_clashing).columns == odd_clashing.columns


def test_em_finds_reliable_labelers():
    rng, patterns = np.random.default_rng(3), Counter()
    truth = []
    for _ in range(4000):
        y = rng.random() < 0.2
        v = tuple(int((1 if y else -1) * (1 if rng.random() < q else -1)) if rng.random() < 0.8 else 0 for q in (0.95, 0.9, 0.6))
        patterns[v] += 1
        truth.append((v, y))
    prior, posterior = pii.reliabilities(dict(patterns))
    assert abs(prior - 0.2) < 0.05 and np.mean([(posterior[v] > 0.5) == y for v, y in truth]) > 0.88


# nearest neighbours ----------------------------------------------------------------------------------------------

def brute_nearest(rows, every=50, k=5):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for q, a in ok:
        if q % every == 0:
            scored = sorted((-float(a @ b / math.sqrt(a @ a) / math.sqrt(b @ b)), i) for i, b in ok if i != q)[:k]
            out += [(q, r, i, s) for r, (s, i) in enumerate(scored, 1)]
    return out


@pytest.mark.parametrize("block", [4096, 40])
def test_nearest_neighbours(spark, monkeypatch, block):
    monkeypatch.setattr(ann, "BLOCK", block)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(900)]
    rows += [(1000 + i, rows[100][1]) for i in range(30)]  # ties
    rows += [(2000, None), (2050, [0.0] * 16), (2100, [float("nan")] + [1.0] * 15), (2150, [None] + [1.0] * 15), (2200, [float("inf")] + [1.0] * 15), (None, rows[0][1])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).withColumnRenamed("x", "part")
    want = brute_nearest(rows)
    whole = ann.search(vectors, parts=8, probes=8, fit_rows=400).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in whole) == sorted(w[:3] for w in want)
    exact = {(q, i): -s for q, _, i, s in want}
    assert all(abs(r.score - exact[r.query_id, r.vec_id]) < 1e-12 for r in whole)
    some = {(r.query_id, r.vec_id) for r in ann.search(vectors, parts=8, probes=6, fit_rows=400).collect()}
    assert len(some & set(exact)) >= 0.8 * len(exact)


def test_nearest_neighbours_of_little(spark):
    schema = "vec_id long, embedding array<float>"
    assert ann.search(spark.createDataFrame([], schema)).count() == 0
    assert ann.search(spark.createDataFrame([(0, [1.0, 0.0])], schema)).count() == 0
    few = ann.search(spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 3.0]), (2, [0.0, 3.0])], schema)).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in sorted(few, key=lambda r: r["rank"])] == [(0, 1, 1), (0, 2, 2)]


def test_balanced_parts():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(200, 8)) * 0.1 + np.eye(8)[c] for c in range(4)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    part = ann.balanced_parts(x, 4)
    assert np.bincount(part).max() <= 1.1 * 200 + 1
    assert (ann.Router(x, part).best(x, 1)[:, 0] == part).mean() > 0.9


# language model --------------------------------------------------------------------------------------------------

def bases(rows):
    tokens = [(d, WORD.findall((t or "").translate(LOWER)) + ["\n"]) for d, t in rows]
    out = lambda d: zlib.crc32(str("" if d is None else d).encode()) % 10 == 0
    count = Counter(w for d, ws in tokens if not out(d) for w in ws)
    n, v = sum(count.values()), len(count)
    return n, [(d, out(d), len(ws), sum(count[w] > 0 for w in ws), sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws) if n else 0.0) for d, ws in tokens]


def test_base_scores_against_brute_force(spark, small, odd_clashing, empty):
    for docs in (small, odd_clashing):
        n, want = bases([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
        rows = suffixtree.score(docs).collect()
        order = lambda x: (x[0] is None, x[0] or 0, x[2], x[4])
        for r, w in zip(sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.base_score) for r in rows), key=order), sorted(want, key=order)):
            assert r[:4] == w[:4] and abs(r[4] - w[4]) < 1e-6
        assert all(r.train_tokens == n and r.score <= 0 for r in rows)
    assert suffixtree.score(empty).count() == 0
    only = spark.createDataFrame([(i, "a b") for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0], "doc_id long, text string")
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.score == r.base_score == 0 for r in suffixtree.score(only).collect())


def tree_scores(rows, least=10, patience=3):
    """The suffix tree in plain Python: every context of any length, no share of the corpus cuts it."""
    tokens = [(d, WORD.findall((t or "").translate(LOWER)) + ["\n"]) for d, t in rows]
    out = lambda d: zlib.crc32(str(d).encode()) % 10 == 0
    count = Counter(w for d, ws in tokens if not out(d) for w in ws)
    total, v = sum(count.values()), len(count)
    mass, shown = total + 0.1 * (v + 1), {w for w, n in count.items() if n >= least or w == "\n"}
    rare = total - sum(count[w] for w in shown) + 0.1 * (v - len(shown) + 1)
    seqs = [(d, [w if w in shown else None for w in ws]) for d, ws in tokens]
    root = lambda s: (rare if s is None else count[s] + 0.1) / mass
    tree: list[dict] = []

    def contexts(s, i):
        c = tuple((["\n"] + s)[max(0, i - len(tree)):i + 1])
        return [c[len(c) - d:] for d in range(1, len(c) + 1)]

    def p(s, i, x):
        out = root(x)
        for level, c in zip(tree, contexts(s, i)):
            if c in level and level[c][0]:
                _, n, follow, _ = level[c]
                out = (follow[x] + len(follow) * out) / (n + len(follow))
        return out

    while True:
        d, found = len(tree) + 1, {}
        for doc, s in seqs:
            if out(doc):
                continue
            for i in range(len(s)):
                c = tuple((["\n"] + s)[i + 1 - d:i + 1]) if i + 1 >= d else None
                if c is None or None in c or (d > 1 and tree[d - 2].get(c[1:], (0, 0, 0, patience))[3] >= patience):
                    continue
                found.setdefault(c, []).append((p(s, i, s[i]), s[i]))
        level = {}
        for c, seen in found.items():
            if len(seen) >= least:
                follow, n = Counter(x for _, x in seen), len(seen)
                gain = sum(math.log(follow[x] / n / q) for q, x in seen)
                kept = gain > 0.5 * len(follow) * math.log(n)
                level[c] = (kept, n, follow, 0 if kept else 1 + (tree[d - 2][c[1:]][3] if d > 1 else 0))
        if not level:
            break
        tree.append(level)
    score = {}
    for (doc, ws), (_, s) in zip(tokens, seqs):
        score[doc] = sum(math.log10(p(s, i, s[i])) + (0 if s[i] is not None else math.log10((count[ws[i]] + 0.1) / rare)) for i in range(len(s)))
    return score, tree


def test_tree_against_brute_force_beyond_shares_and_depth(spark):
    rng, rows = np.random.default_rng(5), []
    for i in range(400):
        w = [f"f{rng.integers(0, 30)}" for _ in range(300)]
        if i % 20 == 0:  # rare words: 1e-4 of all words is more than they have
            w += f"rareone{i % 40} raretwo{i % 40} answer{i % 40}".split()
        first = rng.integers(0, 3)  # what ends the passage is told by the word four before
        w += [f"s{first}", "a", "b", "c", f"e{first}"] + ["unseen"] * (i == 7)
        rows.append((i, " ".join(w)))
    want, tree = tree_scores(rows)
    got = {r.doc_id: r.score for r in suffixtree.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert len(tree) > 3 and any(kept for kept, *_ in tree[3].values())
    assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-6 for d in want)


def test_contexts_help_and_probabilities_add_up(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(300):  # the word after "x y" depends on the word before it
        w = []
        for _ in range(60):
            first = rng.integers(0, 4)
            w += [f"s{first}", "x", "y", f"e{first}", f"r{rng.integers(0, 3000)}"]
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in suffixtree.score(docs).collect()}
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > 0.7 * sum(r.base_score for r in held)
    want, tree = tree_scores(rows)
    assert len(tree) >= 3 and any(kept for kept, *_ in tree[2].values())
    assert all(abs(got[d].score - want[d]) < 1e-6 for d in want)
    for level in tree:  # smoothed by any distribution, a context's own adds up to one
        assert all(abs((n + len(follow)) / (sum(follow.values()) + len(follow)) - 1) < 1e-12 for _, n, follow, _ in level.values())
    # small chunks, several buckets and contexts spread over them give the same scores
    monkeypatch.setattr(suffixtree, "BUCKET", 20_000)
    many = {r.doc_id: r.score for r in suffixtree.score(docs.repartition(11)).collect()}
    assert all(abs(many[d] - want[d]) < 1e-6 for d in want)


def test_hot_contexts_are_spread(spark):
    """Chunks agree on pairs that are dealt by symbol, with held-out occurrences and several chunks."""
    tokens = np.array([2, 3, 2, 4, 2, 3, 0], np.int32)
    row = {"chunk": 0, "tokens": suffixtree._pack(tokens), "doc_id": [1], "held_out": [False], "n_tokens": [7], "n_known": [7], "base_score": [-1.0], "score": [-1.0]}
    alive, p = np.ones(7, np.uint8), np.full(7, 0.25)
    asked = []
    for name, out in ((0, False), (1, True), (2, False)):
        chunk = suffixtree.Chunk(suffixtree._rows(suffixtree.STATE, [{**row, "chunk": name, "held_out": [out]}]))
        asked.append(chunk.ask(1, alive, p, np.full(7, suffixtree.HOT), 5))
    messages = pa.concat_tables(a.filter(pa.compute.is_valid(a["bucket"])) for a in asked).select([f.split()[0] for f in suffixtree.MESSAGE.split(", ")])
    told = pa.concat_tables(suffixtree._add_pairs(messages.filter(pa.compute.equal(messages["bucket"], b))) for b in set(messages["bucket"].to_pylist()))
    counts, firsts = [], []
    for name, rows in enumerate(asked):
        chunk = suffixtree.Chunk(rows.slice(0, 1))
        chunk.look(alive, 1)
        mine = told.filter(pa.compute.equal(told["chunk"], name))
        answer = chunk.answers(mine, chunk.pairs_dealt(np.ones(len(chunk.ctx), bool), 5), len(chunk.sym), "a")
        counts.append(dict(zip(zip(chunk.ctx[chunk.pair_ctx].tolist(), chunk.sym.tolist()), (answer >> 1).tolist())))
        firsts.append(int((answer & 1).sum()))
    assert counts[0] == counts[1] == counts[2] and sorted(counts[0].values()) == [2, 2, 2, 2, 2, 4]
    assert firsts == [6, 0, 0]


def test_places_are_sent_once_for_some_lengths(spark, monkeypatch):
    """A tree of several lengths takes a round of messages for ``BLOCK`` of them; waves of chunks and buckets give the same scores."""
    rng, rows = np.random.default_rng(11), []
    for i in range(200):
        first = rng.integers(0, 3)
        rows.append((i, " ".join([f"f{rng.integers(0, 20)}" for _ in range(200)] + [f"s{first}", "a", "b", "c", f"e{first}"])))
    want, tree = tree_scores(rows)
    docs, written, write = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), [], suffixtree.shared_path
    monkeypatch.setattr(suffixtree, "shared_path", lambda session, name: written.append(name) or write(session, name))
    got = {r.doc_id: r.score for r in suffixtree.score(docs).collect()}
    assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-6 for d in want)
    assert len(tree) > 3 and written.count("pst-level") <= 2 + len(tree) // suffixtree.BLOCK
    monkeypatch.setattr(suffixtree, "BUCKET", 10_000)
    monkeypatch.setattr(suffixtree, "WAVE", 10_000)
    waves = {r.doc_id: r.score for r in suffixtree.score(docs.repartition(5)).collect()}
    assert all(abs(waves[d] - want[d]) < 1e-6 for d in want)


def test_hot_and_other_contexts_give_one_tree(monkeypatch):
    """The same scores where contexts are grown level by level, in buckets, or in buckets below the hot ones."""
    rng = np.random.default_rng(12)
    texts = [np.concatenate([np.minimum(rng.geometric(0.2, 60) + 1, 9), [2 + k, 7, 8, 5 + k, 0]]) for k in rng.integers(0, 3, 90)]
    flat = np.concatenate(texts)
    n = np.bincount(flat, minlength=10)
    p0, last = n[flat] / n.sum(), np.concatenate([[0], flat[:-1]])
    known = lambda t, kind: suffixtree._rows(kind, t.to_pylist())

    def groups(rows, key):
        keys = rows[key].to_pylist()
        return [rows.take([i for i, x in enumerate(keys) if x == k]) for k in sorted({x for x in keys if x is not None})]

    def scores(hot):
        monkeypatch.setattr(suffixtree, "HOT", hot)
        begun = []
        for name in range(3):
            part = texts[name * 30:name * 30 + 30]
            row = {"chunk": name, "tokens": suffixtree._pack(np.concatenate(part).astype(np.int32)), "doc_id": list(range(30)), "held_out": [i == 4 for i in range(30)],
                   "n_tokens": [65] * 30, "n_known": [65] * 30, "base_score": [0.0] * 30, "score": [0.0] * 30}
            at = slice(name * 30 * 65, (name + 1) * 30 * 65)
            begun.append(suffixtree.Chunk(suffixtree._rows(suffixtree.STATE, [row])).ask(1, np.ones(30 * 65, np.uint8), p0[at], n[last[at]], 3))
        state, depth, sent = pa.concat_tables(begun), 1, [0, 0]
        while True:
            own, asked = state.filter(pa.compute.is_null(state["bucket"])), state.filter(pa.compute.is_valid(state["bucket"]))
            places = [m for c in groups(own, "chunk") if c["left_at"][0].is_valid for m in suffixtree.Chunk(c).blocks(4)]
            if not len(asked) and not places:
                return np.concatenate([np.array(c["score"][0].as_py()) for c in groups(own, "chunk")]), sent
            sent = [sent[0] + len(asked), sent[1] + len(places)]
            answers = [r for b in groups(suffixtree._rows(suffixtree.PLACES, places), "bucket") for r in suffixtree._subtree(b).to_pylist()]
            told = pa.concat_tables([known(suffixtree._add_pairs(b), suffixtree.STATE) for b in groups(asked, "bucket")] or [state.slice(0, 0)])
            shares = pa.concat_tables([suffixtree._gather(depth, 3)(c, told.filter(pa.compute.equal(told["chunk"], c["chunk"][0]))) for c in groups(own, "chunk")])
            answers += [r for b in groups(shares, "bucket") for r in suffixtree._add_contexts(b).to_pylist()] + shares.filter(pa.compute.is_null(shares["bucket"])).to_pylist()
            every = suffixtree._rows(suffixtree.MESSAGE + suffixtree.GROWN.removeprefix("chunk long"), answers)
            state = pa.concat_tables([suffixtree._deepen(depth, 3)(c, every.filter(pa.compute.equal(every["chunk"], c["chunk"][0]))) for c in groups(own, "chunk")])
            depth += 1

    (levels, a), (mixed, b), (buckets, c) = scores(1), scores(300), scores(10 ** 9)
    assert a[0] and b[0] and b[1] and c[1] and not c[0]
    assert abs(levels).max() > 1 and np.allclose(levels, mixed, rtol=0, atol=1e-9) and np.allclose(levels, buckets, rtol=0, atol=1e-9)


def test_assigned_and_dotted_secrets(spark):
    """Short passwords behind a name and a sign, and a token of three parts as one span; names and prose stay."""
    rnd = random.Random(12)
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0"
    rows = [(1, 'password = "hunter2!x" and more'), (2, "pwd=Xk9$2mQ"), (3, f"Authorization: Bearer {jwt} end."), (4, "db_password: s3cr/et+Va1ue== ."),
            (5, "the keynote was long, and the password was changed"), (6, "an uncharacteristically misunderstood counterintuitiveness"), (7, "MY_API_KEY='q7w8e9r0'")]
    rows += [(100 + i, f"token={''.join(rnd.choice('abcdef0123456789') for _ in range(32))} and {prose(i, 20)}") for i in range(60)]
    rows += [(300 + i, prose(900 + i, 60) + " internationalization straightforwardly") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s.startswith("secret")] for r in pii.report(docs).collect()}
    found = {d: [t[a:b] for a, b in spans[d]] for d, t in rows}
    assert found[1] == ["hunter2!x"] and found[2] == ["Xk9$2mQ"] and found[3] == [jwt] and found[4] == ["s3cr/et+Va1ue=="] and found[7] == ["q7w8e9r0"]
    assert not found[5] and not found[6] and not any(found[300 + i] for i in range(100))
    assert all(len(found[100 + i]) == 1 and len(found[100 + i][0]) == 32 for i in range(60))


def test_redaction_looks_once(spark, odd_clashing, monkeypatch):
    """pipeline: the texts are looked through once, whatever the redaction then writes."""
    from packetspark.llm import pii as P
    calls, real = [], P.find
    monkeypatch.setattr(P, "find", lambda *a, **b: calls.append(1) or real(*a, **b))
    out = P.redact(odd_clashing)
    assert out.columns == odd_clashing.columns and out.count() == odd_clashing.count() and len(calls) == 1
    assert not any("Project" in x and "regexp_extract_all" in x for x in out._jdf.queryExecution().optimizedPlan().toString().split("\n"))


def test_named_values_are_found_behind_their_signs(spark):
    """pipeline, op10: the look behind a sign finds the texts that the look from each word found."""
    from packetspark.llm import pii as P
    from pyspark.sql import functions as F
    rnd = random.Random(8)
    bits = [*P.GAZETTEER, "KEY", "Token", "tok", "_", "x9", "abcdefgh", "Key", "'", '"', " ", "  ", "\t", "=", ":", "::", "é", "."]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 9))) for _ in range(4000)]
    plain = rf"(?i:{'|'.join(P.GAZETTEER)})[A-Za-z0-9_]{{0,8}}+[\"']?[ \t]{{0,2}}+[=:]"
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    both = df.select(F.col("t").rlike(plain).alias("a"), F.col("t").rlike(P.NAMED).alias("b"))
    assert both.where("a <> b").isEmpty() and both.where("a").count() > 500 and both.where("not a").count() > 500
    assert P.NAMED.startswith("[=:]")
