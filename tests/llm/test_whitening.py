import numpy as np
import pytest

from packetspark.llm import whitening as W


def plain(vectors, k=8):
    """The contract in numpy and whole numbers, vector by vector."""
    x = np.array([[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in vectors], dtype=object)
    n, total = len(x), x.sum(axis=0)
    off = n * x - total
    deviation = (off * off).sum(axis=1)
    y = off.astype(float) / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    return deviation, y @ axes / np.sqrt(values), values / np.trace(y.T @ y / n)


def check(rows, ids, vectors, k=8):
    deviation, whitened, explained = plain(vectors, k)
    at = {i: p for p, i in enumerate(ids)}
    assert len(rows) == len(ids) * whitened.shape[1]
    got = np.zeros_like(whitened)
    for r in rows:
        p = at[r["vec_id"]]
        assert r["deviation"] == deviation[p] and r["n"] == len(ids)
        assert r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-6) and r["identity_error"] <= 1e-6
        got[p, r["component"] - 1] = r["whitened"]
    sign = np.sign((got * whitened).sum(axis=0))
    assert np.allclose(got * sign, whitened, atol=1e-6)


def test_whole_table_against_numpy(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    want = e.select("vec_id", "embedding").collect()
    check(W.op13_whitening(spark, "/root/testdata/sf0.01").collect(), [r[0] for r in want], [r[1] for r in want])


def test_blocks_do_not_change_the_result(spark, monkeypatch):
    monkeypatch.setattr(W, "BLOCK", 64)
    rng = np.random.default_rng(1)
    v = (rng.normal(size=(700, 5)) @ rng.normal(size=(5, 5)) * 40).tolist()
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(7)
    check(W.whiten(df).collect(), list(range(700)), v, 5)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 0.5]), (2, None), (3, [1.0, None, 2.0]), (4, [nan, 1.0, 1.0]), (5, [inf, 0.0, 1.0]), (6, []), (7, [3.0, 1.0, 0.5]),
            (8, [1.0]), (9, [0.0, -4.0, 0.5]), (10, [2.0, 2.0, 0.5]), (None, [5.0, 1.0, 0.5]), (7, [3.0, 1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for name in ("x", "at", "w", "n", "index", "vector", "component"):
        df = df.withColumn(name, df.vec_id.cast("string"))
    out = W.whiten(df).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in out) == sorted((i, c) for i in (1, 7, 7, 9, 10, 0) for c in (1, 2, 3))
    assert all((r["whitened"] is None) == (r["component"] == 3) for r in out)  # the third dimension never varies
    assert all(r["n"] == 6 and r["identity_error"] < 1e-9 for r in out)


def test_deviation_beyond_64_bits(spark):
    big = spark.createDataFrame([(i, [float(i) * 4e5, 1.0]) for i in range(2000)], "vec_id long, embedding array<double>")
    want = plain([[i * 4e5, 1.0] for i in range(2000)], 1)[0]
    assert max(want) > 1 << 63
    got = {r["vec_id"]: r["deviation"] for r in W.whiten(big, components=1).collect()}
    assert all(got[i] == (d if d < 1 << 63 else None) for i, d in enumerate(want))


def test_empty_and_same(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert W.whiten(none).count() == 0
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert [(r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in W.whiten(same).collect()] == [(0, None, 0.0, 0.0)] * 4
