import numpy as np
import pytest

from packetspark.operators import stats as ST


def col(spark, vals):
    return spark.createDataFrame([(float(v),) for v in vals], "x double")


def test_iqr_cap_golden(spark):
    capped, b = ST.iqr_cap(col(spark, [1, 2, 3, 4, 100]), ["x"], factor=3.0)
    assert (b["x"]["q1"], b["x"]["q3"], b["x"]["lower"], b["x"]["upper"]) == (2, 4, -4, 10)
    assert [r[0] for r in capped.collect()] == [1, 2, 3, 4, 10]


def test_zscore_cap_golden(spark):
    capped, fit = ST.zscore_cap(col(spark, [1, 2, 3, 4, 100]), ["x"], factor=1.5)
    assert fit["x"]["std"] == pytest.approx(43.6177, abs=1e-4)
    assert [r[0] for r in capped.collect()] == pytest.approx([1, 2, 3, 4, 87.4265], abs=1e-4)


def test_standardise_golden(spark):
    out, _ = ST.standardise(col(spark, [1, 2, 3, 4, 100]), ["x"])
    assert [r[0] for r in out.collect()] == pytest.approx([-0.5383, -0.5127, -0.4870, -0.4614, 1.9993], abs=1e-4)
    const, _ = ST.standardise(col(spark, [5, 5, 5]), ["x"])
    assert [r[0] for r in const.collect()] == [0, 0, 0]


@pytest.mark.parametrize("per_segment", [1_000_000, 50])
def test_exact_quantiles_match_numpy(spark, per_segment):
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.normal(size=5000), np.full(700, 1.25)])  # heavy tie
    q = ST.exact_quantiles(col(spark, v), ["x"], [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0], per_segment)["x"]
    assert q == pytest.approx(list(np.percentile(v, [0, 10, 25, 50, 75, 99.9, 100])))


def test_exact_quantiles_on_ties_and_constants(spark):
    n = 1_200_000
    df = spark.range(n).selectExpr("0.0 as zero", "case when id % 10 = 0 then cast(id as double) else 0.0 end as ties",
                                   "cast(null as double) as nothing", "cast(id as double) as ramp")
    q = ST.exact_quantiles(df, ["zero", "ties", "nothing", "ramp"], [0.25, 0.5, 0.95], 100_000)
    ties = np.where(np.arange(n) % 10 == 0, np.arange(n), 0.0)
    assert q["zero"] == [0, 0, 0] and q["nothing"] == [None] * 3
    assert q["ties"] == pytest.approx(list(np.percentile(ties, [25, 50, 95])))
    assert q["ramp"] == pytest.approx([0.25 * (n - 1), 0.5 * (n - 1), 0.95 * (n - 1)])


def test_state_roundtrip(spark, tmp_path):
    df = col(spark, [1, 2, 3, 4, 100]).withColumnRenamed("x", "iat")
    st = ST.fit_state(df, scale_columns=["iat"], cap_columns=["iat"])
    path = str(tmp_path / "state")
    ST.save_state(st, path)
    scaler, caps = ST.load_state(spark, path)
    assert caps["iat"]["upper"] == 10 and scaler["iat"]["mean"] == pytest.approx(22.0)
    assert ST.load_state(spark, str(tmp_path / "missing")) == ({}, {})


def test_state_of_another_version_is_not_read(spark, tmp_path):
    from pyspark.sql import functions as F
    df = col(spark, [1, 2, 3, 4, 100]).withColumnRenamed("x", "iat").withColumn("us", F.lit(7).cast("long"))
    st = ST.fit_state(df, scale_columns=["iat"], cap_columns=["iat"])
    assert [tuple(r) for r in st.select("n_rows", "from_us", "to_us").collect()] == [(5, 7, 7)]
    path = str(tmp_path / "state")
    ST.save_state(st.withColumn("version", F.lit(99)), path)
    assert ST.load_state(spark, path) == ({}, {})
    refitted, _ = ST.load_state(spark, path, refit_from=df)
    assert refitted["iat"]["mean"] == pytest.approx(22.0)
