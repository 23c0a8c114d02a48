import os
import uuid

import numpy as np
import pytest

from packetspark.streaming import scorer as SC

T = [0, 0.5, 1, 1, 2, 12]
P = [10, 20, 0, 40, 50, 7]


def test_window_features_cuts_match_batch():
    us = (np.array(T) * 1e6).astype("int64")
    p = np.array(P, dtype=float)
    whole = SC.window_features(np.zeros(0, "int64"), np.zeros(0), us, p, (1, 10, 60))
    parts = [SC.window_features(us[:i], p[:i], us[i:i + 1], p[i:i + 1], (1, 10, 60)) for i in range(6)]
    for k, v in whole.items():
        assert np.allclose(v, [x[k][0] for x in parts])
    assert whole["rolling_std_payload_1s"][3] == pytest.approx(8.165, abs=1e-3)
    assert whole["msg_rate_10s"][5] == pytest.approx(0.1)


def test_stream_replay_cuts_and_dead_letter(spark, tmp_path):
    base = str(tmp_path)
    src = os.path.join(base, "src")
    os.makedirs(src)
    header = "event_id,device_id,timestamp,tcp_len,tcp_flags,mqtt_msg,mqtt_hdrflags,mqtt_conflags,mqtt_conack_flags,mqtt_qos\n"
    lines = [f"{i},1,{1_700_000_000 + t},60,0x0018,{p},48,0,0,1\n" for i, (t, p) in enumerate(zip(T, P))]
    lines.append("99,1,not-a-time,60,2,5,48,0,0,1\n")
    # two files: 3 + 4 rows, processed as two micro-batches
    for j, chunk in enumerate([lines[:3], lines[3:]]):
        with open(os.path.join(src, f"part-{j}.csv"), "w") as f:
            f.write(header + "".join(chunk))
        os.utime(os.path.join(src, f"part-{j}.csv"), (1000 + j, 1000 + j))
    parsed = SC.parse_records(SC.read_stream(spark, src, max_files_per_trigger=1))
    out = os.path.join(base, "out")
    SC.run_to_sink(SC.score_stream(parsed, (1, 10, 60), watermark="3650 days"), out, os.path.join(base, "ck"))
    res = spark.read.parquet(out)
    assert res.where("status = 'bad'").select("event_id").collect()[0][0] == 99
    assert res.where("status = 'ok'").count() == 6
    # restart from the checkpoint: nothing is processed twice
    SC.run_to_sink(SC.score_stream(SC.parse_records(SC.read_stream(spark, src)), (1, 10, 60),
                                   watermark="3650 days"), out, os.path.join(base, "ck"))
    assert spark.read.parquet(out).count() == 7
    st = SC.temporal_stream(SC.parse_records(SC.read_stream(spark, src, 1)), (1, 10, 60), watermark="3650 days")
    out2 = os.path.join(base, f"t-{uuid.uuid4().hex}")
    SC.run_to_sink(st, out2, os.path.join(base, "ck2"))
    rows = spark.read.parquet(out2).orderBy("event_id").collect()
    assert [r["iat"] for r in rows] == pytest.approx([0, 0.5, 0.5, 0, 1, 10])
    assert [r["rolling_mean_payload_10s"] for r in rows] == pytest.approx([0, 10, 15, 10, 17.5, 50])
    lim = SC.replay(spark, src, os.path.join(base, "r"), os.path.join(base, "ck3"), max_records=3,
                    windows=(1, 10, 60), watermark="3650 days")
    # the bad record (id 99) lies behind the third success, where the run stops
    assert lim.where("status = 'ok'").count() == 3 and lim.where("status = 'bad'").count() == 0
    assert SC.limit_successes(spark.read.parquet(os.path.join(base, "r")), 7).where("status = 'bad'").count() == 1


def test_windows_of_rows_in_any_order():
    """Frames over (time, arrival) against a loop, and fast on a long buffer."""
    import time
    rng = np.random.default_rng(8)
    for n, nb in ((1, 0), (7, 3), (400, 250)):
        t = rng.integers(0, 60, n + nb) * 500_000
        p = rng.integers(0, 9, n + nb).astype(float)
        got = SC.window_features(t[:nb], p[:nb], t[nb:], p[nb:], (1, 10))
        for w in (1, 10):
            for i in range(n):
                k = nb + i
                v = p[:k][(t[:k] >= t[k] - w * 1_000_000) & (t[:k] <= t[k])]
                assert got[f"msg_rate_{w}s"][i] == pytest.approx(len(v) / w)
                assert got[f"rolling_mean_payload_{w}s"][i] == pytest.approx(v.mean() if len(v) else 0)
                assert got[f"rolling_std_payload_{w}s"][i] == pytest.approx(v.std() if len(v) else 0, abs=1e-9)
    t = rng.integers(0, 10 ** 9, 100_000)
    begin = time.time()
    SC.window_features(t[:0], t[:0].astype(float), t, np.ones(len(t)), (1, 10, 60))
    assert time.time() - begin < 20


def test_devices_share_calls_of_the_state_function(spark, tmp_path, monkeypatch):
    """stream_late: 300 devices in 4 groups cost few calls per micro-batch, and each row has the frames of its own device."""
    from pyspark.sql import functions as F
    rng = np.random.default_rng(3)
    rows = [(int(e), int(d) if d else None, int(t), float(v)) for e, (d, t, v) in enumerate(zip(rng.integers(0, 300, 1500), rng.integers(0, 9000, 1500), rng.integers(0, 40, 1500) / 4))]
    parts = [rows[:600], rows[600:900], rows[900:]]
    monkeypatch.setattr(SC, "GROUPS", 4, raising=False)
    make, calls = SC.make_state_fn, spark.sparkContext.accumulator(0)

    def counted(*args, **kw):
        fn = make(*args, **kw)

        def run(k, pdfs, state):
            calls.add(1)
            yield from fn(k, pdfs, state)
        return run
    monkeypatch.setattr(SC, "make_state_fn", counted)
    frames = [spark.createDataFrame(x, "event_id long, device_id long, t long, mqtt_msg double").withColumn("timestamp", F.date_format(F.timestamp_seconds(F.col("t") + 1_700_000_000), "yyyy-MM-dd HH:mm:ss")) for x in parts]
    out = str(tmp_path / "out")
    SC.run_in_batches(frames, lambda x: SC.temporal_stream(x, (60, 3000), watermark="3650 days", max_buffer=3), str(tmp_path / "src"), out, str(tmp_path / "ck"))
    got = {r["event_id"]: r for r in spark.read.parquet(out).collect()}
    assert len(got) == 1500 and calls.value <= 3 * 5
    before, last = {}, {}
    for part in parts:
        for d, mine in before.items():  # what the state keeps between micro-batches
            before[d] = [x for x in mine if x[0] >= max(mine)[0] - 3000][-3:]
        for e, d, t, v in sorted(part, key=lambda r: (r[2], r[0])):
            mine, r = before.setdefault(d, []), got[e]
            assert r["device_id"] == d and r["iat"] == t - last.get(d, t)
            last[d] = t
            for w in (60, 3000):
                seen = [x for u, x in mine if t - w <= u <= t]
                assert r[f"msg_rate_{w}s"] == pytest.approx(len(seen) / w)
                assert r[f"rolling_mean_payload_{w}s"] == pytest.approx(np.mean(seen) if seen else 0)
                assert r[f"rolling_std_payload_{w}s"] == pytest.approx(np.std(seen) if seen else 0, abs=1e-6)
            mine.append((t, v))


def test_limit_goes_on_after_a_restart(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("src", "out", "ck"))
    rows = [(i, 1, f"2024-01-01 00:00:{i:02d}" if i % 5 else "bad") for i in range(40)]
    for a in range(0, 40, 10):
        SC.stage_records(spark.createDataFrame(rows[a:a + 10], "event_id long, device_id long, timestamp string"), src, mode="append")
        scored = SC.score_stream(SC.parse_records(SC.read_stream(spark, src)), (1,), watermark="3650 days")
        done = SC.run_until(scored, out, ckpt, 13)
    got = [r["event_id"] for r in spark.read.parquet(out).orderBy("event_id").collect()]
    assert done == 13 and got == list(range(17))  # the 13th success is record 16
    assert SC.run_until(scored, out, ckpt, 13) == 13 and spark.read.parquet(out).count() == 17


def test_silent_devices_leave_the_state_and_late_rows_stay(spark, tmp_path):
    def rows(*items):
        p = [(i, d, f"2024-01-01 {h:02d}:00:00", "1") for i, d, h in items]
        return spark.createDataFrame(p, "event_id long, device_id long, timestamp string, mqtt_msg string")
    batches = [rows((1, 1, 0), (2, 2, 1)), rows((3, 2, 9)), rows((4, 1, 10), (5, 2, 2))]
    out = str(tmp_path / "out")
    with SC.one_stateful_operator(spark):
        SC.run_in_batches(batches, lambda x: SC.temporal_stream(x, (60,), watermark="1 hour", idle=3600), str(tmp_path / "src"), out, str(tmp_path / "ckpt"))
    got = spark.read.parquet(out).collect()
    assert {(r["event_id"], r["status"], r["iat"]) for r in got if r["event_id"]} == {
        (1, "ok", 0.0), (2, "ok", 0.0), (3, "ok", 28800.0),
        (4, "ok", 0.0), (5, "late", -25200.0)}
    assert [(r["event_id"], r["us"] % 86_400_000_000) for r in got if r["status"] == "ended" and r["device_id"] == 1] == [(None, 0)]


def test_a_forest_too_large_for_workers_scores_a_stream(spark, tmp_path, monkeypatch):
    """stream_predict: the forest meets each micro-batch as a table; the rows are those of a small forest."""
    from pyspark.sql import functions as F
    from packetspark import schema as S
    from packetspark.operators import forest as RF
    from packetspark.plans import catalog as CAT
    rng = np.random.default_rng(1)
    n = 120
    rows = [(i, i % 4, f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}" if i % 40 else "bad", str(int(v))) for i, v in enumerate(rng.integers(0, 50, n))]
    events = spark.createDataFrame(rows, "event_id long, device_id long, timestamp string, mqtt_msg string")
    base = spark.range(300).select(F.col("id").alias("event_id"), (F.col("id") % 3).cast("double").alias("target"),
                                   *[(F.col("id") * 7 % (5 + i)).cast("double").alias(c) for i, c in enumerate(S.FEATURES)])
    model = RF.fit(base, [RF.Setting(trees=4)])[0]
    monkeypatch.setattr(CAT, "read_packets", lambda *a: events)
    monkeypatch.setattr(SC, "records_from_packets", lambda p, bad: p)

    def run():
        got = CAT._stream_run(spark, "", model=model, kind="forest", windows=S.DEFAULT_WINDOWS)
        return sorted(map(tuple, got.select("event_id", "status", F.coalesce("predicted_label", F.lit(-1)),
                                            F.round(F.coalesce("confidence", F.lit(-1.0)), 6), "error").collect()), key=str)
    small = run()
    monkeypatch.setattr(RF, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(RF.with_scores, "__defaults__", (0, 0))
    assert run() == small and len(small) == n and sum(r[1] == "bad" for r in small) == 3
