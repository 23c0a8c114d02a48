import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from packetspark.operators import timeline as TL

T = [0, 0.5, 1, 1, 2, 12]
P = [10, 20, 0, 40, 50, 7]


def fixture(spark, payload=P):
    rows = [(i, int(t * 1_000_000), None if p is None else float(p)) for i, (t, p) in enumerate(zip(T, payload))]
    return spark.createDataFrame(rows, "event_id long, us long, mqtt_payload_len double")


INCL = {
    1: [(1, 10, 0), (2, 15, 5), (4, 17.5, 14.7902), (4, 17.5, 14.7902), (3, 30, 21.6025), (1, 7, 0)],
    10: [(1, 10, 0), (2, 15, 5), (4, 17.5, 14.7902), (4, 17.5, 14.7902), (5, 24, 18.5472), (2, 28.5, 21.5)],
    60: [(1, 10, 0), (2, 15, 5), (4, 17.5, 14.7902), (4, 17.5, 14.7902), (5, 24, 18.5472), (6, 21.1667, 18.0778)],
}
EXCL = {
    1: [(0, 0, 0), (1, 10, 0), (2, 15, 5), (3, 10, 8.165), (2, 20, 20), (0, 0, 0)],
    10: [(0, 0, 0), (1, 10, 0), (2, 15, 5), (3, 10, 8.165), (4, 17.5, 14.7902), (1, 50, 0)],
    60: [(0, 0, 0), (1, 10, 0), (2, 15, 5), (3, 10, 8.165), (4, 17.5, 14.7902), (5, 24, 18.5472)],
}


@pytest.mark.parametrize("include,table", [(True, INCL), (False, EXCL)])
@pytest.mark.parametrize("null_payload", [False, True])
def test_closed_windows_with_ties(spark, include, table, null_payload):
    pay = [None if (null_payload and p == 0) else p for p in P]
    out = TL.window_stats(fixture(spark, pay), (1, 10, 60), include_current=include).orderBy("event_id").collect()
    for w, cells in table.items():
        for r, (n, m, s) in zip(out, cells):
            assert r[f"msg_rate_{w}s"] == pytest.approx(n / w)
            assert r[f"rolling_mean_payload_{w}s"] == pytest.approx(m, abs=1e-4)
            assert r[f"rolling_std_payload_{w}s"] == pytest.approx(s, abs=1e-4)


def test_iat_gap(spark):
    out = TL.inter_arrival(fixture(spark), "ts_gap").orderBy("event_id").collect()
    assert [r["iat"] for r in out] == pytest.approx([0, 0.5, 0.5, 0, 1, 10])


def test_ordered_scan_matches_pandas(spark):
    rng = np.random.default_rng(7)
    n = 3000
    pdf = pd.DataFrame({"event_id": np.arange(n), "g": rng.integers(0, 3, n),
                        "us": rng.integers(-5_000_000, 5_000_000, n) // 1000 * 1000,  # ties, negatives
                        "v": rng.normal(size=n)})
    pdf.loc[pdf.g == 0, "us"] = 42  # one hot group with a single timestamp
    df = spark.createDataFrame(pdf.sample(frac=1, random_state=1)).repartition(7)
    out = TL.ordered_scan(df, order=["us", "event_id"], group=["g"], sums={"v": F.col("v")},
                          lags=["event_id"], partitions=5, prefix="o_").toPandas()
    exp = pdf.sort_values(["g", "us", "event_id"]).copy()
    exp["idx"] = exp.groupby("g").cumcount()
    exp["before"] = exp.groupby("g")["v"].cumsum() - exp["v"]
    exp["prev"] = exp.groupby("g")["event_id"].shift(1)
    m = out.merge(exp, on="event_id")
    assert (m["o_idx"] == m["idx"]).all()
    assert np.allclose(m["o_v_before"], m["before"])
    assert m["o_prev_event_id"].fillna(-1).astype(int).tolist() == m["prev"].fillna(-1).astype(int).tolist()


def test_bucketed_equals_global_window(spark):
    rng = np.random.default_rng(3)
    n = 2000
    pdf = pd.DataFrame({"event_id": np.arange(n), "us": np.sort(rng.integers(-10**9, 10**9, n)),
                        "mqtt_payload_len": rng.integers(0, 100, n).astype(float)})
    df = spark.createDataFrame(pdf)
    out = TL.window_stats(df, (5, 50)).orderBy("event_id").toPandas()
    for w in (5, 50):
        cnt = [((pdf.us >= u - w * 10**6) & (pdf.us <= u)).sum() for u in pdf.us]
        assert np.allclose(out[f"msg_rate_{w}s"] * w, cnt)


@pytest.mark.parametrize("n,exp", [(10, (6, 2, 2)), (7, (4, 1, 2)), (1, (0, 0, 1))])
def test_split_sizes(spark, n, exp):
    df = spark.createDataFrame([(i, i * 10) for i in range(n)], "event_id long, us long")
    c = {r["split"]: r["count"] for r in TL.time_split(df).groupBy("split").count().collect()}
    assert (c.get("train", 0), c.get("validation", 0), c.get("test", 0)) == exp


def test_windows_keep_small_spreads_of_large_values(spark):
    df = spark.createDataFrame([(i, 1_000_000 * i, 1e8 + i % 2) for i in range(20)], "event_id long, us long, mqtt_payload_len double")
    for include in (True, False):
        rows = TL.window_stats(df, (3,), include_current=include).orderBy("event_id").collect()
        assert all(abs(r["rolling_std_payload_3s"] - 0.5) < 1e-6 for r in rows[4:] if include)
        assert all(abs(r["rolling_mean_payload_3s"] - 1e8) <= 1 for r in rows[1:])


def test_dense_minute_against_brute_force(spark):
    import numpy as np
    rng = np.random.default_rng(5)
    us = np.sort(rng.integers(-90_000_000, 90_000_000, 3000))
    pay = rng.integers(0, 50, 3000).astype(float)
    df = spark.createDataFrame([(i, int(t), float(p)) for i, (t, p) in enumerate(zip(us, pay))], "event_id long, us long, mqtt_payload_len double")
    rows = TL.window_stats(df, (1, 30, 60)).orderBy("event_id").collect()
    for i in range(0, 3000, 37):
        for w in (1, 30, 60):
            frame = pay[(us >= us[i] - w * 1_000_000) & (us <= us[i])]
            assert abs(rows[i][f"msg_rate_{w}s"] - len(frame) / w) < 1e-9
            assert abs(rows[i][f"rolling_mean_payload_{w}s"] - frame.mean()) < 1e-8
            assert abs(rows[i][f"rolling_std_payload_{w}s"] - frame.std()) < 1e-6


def test_segments_grow_with_the_rows(spark, monkeypatch):
    """msg_rate, rolling_*, preprocess_features: no task sorts more rows as tables grow; results stay."""
    from pyspark.sql import functions as F
    from packetspark.operators import timeline as TL
    df = spark.range(3000).select(F.col("id").alias("event_id"), (F.col("id") * 1_500_000).alias("us"), (F.col("id") % 11).cast("double").alias("mqtt_payload_len"))
    few = TL.window_stats(df, (10, 60)).orderBy("event_id").collect()
    seen = []
    real = TL._parts
    monkeypatch.setattr(TL, "_parts", lambda *a: seen.append(real(*a)) or seen[-1])
    monkeypatch.setattr(TL, "SEGMENT_ROWS", 500)
    assert TL.window_stats(df, (10, 60)).orderBy("event_id").collect() == few
    assert seen == [24]
    assert TL.time_split(df).where("split = 'train'").count() == 1800


def test_segments_of_a_scan_do_not_meet_in_a_task(spark, monkeypatch):
    """However small its shuffle, a segment is a partition of its own: no task sorts several."""
    rows = []
    kept = TL.written

    def seen(df, name):
        if name == "scan":
            rows.append(df.groupBy(F.spark_partition_id()).agg(F.countDistinct("_seg").alias("n"), F.max("_rn").alias("last"))
                        .agg(F.max("n"), F.count(F.lit(1)), F.max("last")).first())
        return kept(df, name)
    monkeypatch.setattr(TL, "written", seen)
    df = spark.range(4000).select(F.col("id").alias("event_id"), (F.col("id") * 7 % 4001).alias("us"))
    out = TL.with_global_index(df, ("us", "event_id"), partitions=16)
    assert rows[0][0] == 1 and rows[0][1] == 16
    assert [r["row_idx"] for r in out.orderBy("us").collect()] == list(range(4000))
