import re
from collections import Counter, defaultdict

from packetspark.llm import mixing, rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_targets_and_whole_copies(small):
    rows = mixing.mix(small).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
        assert r.copies in (0, 1, 2) and r.taken == r.size * r.copies
    total = sum(r.size for r in rows)
    assert abs(sum(v[0].target for v in by.values()) - 1.5 * total) < 1e-6 * total
    for v in by.values():
        size = sum(r.size for r in v)
        assert v[0].source_size == size and v[0].target <= 2 * size + 1e-9
        assert abs(sum(r.taken for r in v) - v[0].target) <= max(r.size for r in v) / 2 + 1
    assert Counter(map(tuple, rows)) == Counter(map(tuple, mixing.mix(small.repartition(5)).collect()))


def test_longer_documents_have_larger_odds(spark):
    docs = spark.createDataFrame([(i, "w " * (4 if i % 2 else 60), "en", s, 0) for i in range(600) for s in "abc"], "doc_id long, text string, lang string, source string, n_chars long")
    rows = mixing.mix(docs, weights=(1, 9, 9)).where("source = 'a'").collect()
    mean = {k: sum(r.copies for r in rows if r.size == k) / 300 for k in (4, 60)}
    assert mean[60] > 1.3 * mean[4]


def test_mix_odd_rows(odd, odd_clashing, empty):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count() and Counter(map(tuple, rows)) == Counter(map(tuple, mixing.mix(odd_clashing).collect()))
    assert all(r.taken == 0 for r in rows if r.size == 0)
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    want = Counter()
    for r in rows:
        want[r.doc_id] += r.copies
    got = Counter(r.doc_id for r in mixing.mixed_documents(odd_clashing).collect())
    assert +want == got


def measures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_rules_against_brute_force(small, odd_clashing, empty):
    for docs in (small, odd_clashing):
        texts = Counter((r.doc_id, *measures(r.text)) for r in docs.select("doc_id", "text").collect())
        rows = rules.judge(docs).collect()
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == texts
        for r in rows:
            assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
            assert not (r.kept and r.base_failed)
    assert rules.judge(empty).count() == 0


def test_host_verdict_needs_evidence(spark):
    good, bad = " ".join(f"w{i}" for i in range(30)), "too short"
    rows = [(i, good, "clean") for i in range(300)] + [(1000 + i, bad, "awful") for i in range(300)] + [(2000, good, "awful"), (3000, bad, "sparse"), (3001, good, "sparse")]
    out = {r.doc_id: r for r in rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert out[0].kept and not out[2000].kept and not out[2000].base_failed  # a good text of a bad host
    assert out[3001].kept  # two documents do not condemn a host


def test_sql_judges_hosts_too(spark, tmp_path):
    """The SQL equals the operator where a host fails by the spread of the others, far below one half, and where none does."""
    import duckdb
    from packetspark.llm.oracle import ORACLE
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(100 * h + i, good if i >= (25 if h == 3 else 2) else "too short", f"host{h}") for h in range(30) for i in range(100)]
    rows += [(9000, good, None), (9001, None, None), (9002, "$$$ ### %%%", "host1"), (9003, "a\na\na\na", "host2"), (9003, "a\na\na\na", "host2")]
    for n, part in enumerate((rows, [r for r in rows if r[2] != "host3"])):
        path = str(tmp_path / f"t{n}")
        spark.createDataFrame(part, "doc_id long, text string, source string").write.parquet(path + "/documents.parquet")
        got = Counter(tuple(r.asDict().items()) for r in rules.op6_host_rules(spark, path).collect())
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/documents.parquet/*.parquet')")
        cur = con.execute(ORACLE["op6_host_rules"])
        names = [d[0] for d in cur.description]
        want = Counter(tuple((c, dict(zip(names, r))[c]) for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")) for r in cur.fetchall())
        assert got == want
        lost = [k for k in got if not dict(k)["kept"] and not dict(k)["base_failed"]]
        assert len(lost) == (75 if n == 0 else 0)
