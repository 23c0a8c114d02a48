from pyspark.sql import functions as F

from packetspark.functions.coerce import hex_int
from packetspark.functions.mapping import binary_relabel, class_name, map_features


def test_msgtype_and_retain_golden(spark):
    hdr = [0, 15, 16, 48, 49, 240, 256, 271, 272, 512]
    df = spark.createDataFrame([(h,) for h in hdr], "mqtt_hdrflags bigint")
    out = map_features(df).select("mqtt_hdrflags", "mqtt_msgtype", "mqtt_retain").collect()
    got = {r[0]: (r[1], r[2]) for r in out}
    exp_type = [0, 0, 1, 3, 3, 15, 3, 3, 1, 3]
    exp_ret = [0, 1, 0, 0, 1, 0, 0, 1, 0, 0]
    assert [got[h] for h in hdr] == list(zip(exp_type, exp_ret))


def test_missing_columns_default_to_zero(spark):
    df = spark.createDataFrame([(1,)], "event_id int")
    r = map_features(df).first()
    assert r["mqtt_msgtype"] == 0 and r["protocol_flags"] == 0 and r["mqtt_qos"] == 0


def test_hex_coercion_golden(spark):
    vals = ["0x0018", "0X10", "24", " 7 ", "2.9", "abc", None, "0xzz"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    rows = df.select(hex_int(F.col("v")).alias("p"), hex_int(F.col("v"), hex_mode="zero").alias("z")).collect()
    assert [r["p"] for r in rows] == [24, 16, 24, 7, 2, 0, 0, 0]
    assert rows[0]["z"] == 0


def test_relabel_and_names(spark):
    df = spark.createDataFrame([(i,) for i in [0, 3, 5, 9]], "t int")
    rows = df.select(binary_relabel(F.col("t")).alias("y"), class_name(F.col("t")).alias("n")).collect()
    assert [r["y"] for r in rows] == [-1, 1, -1, -1]
    assert [r["n"] for r in rows] == ["bruteforce", "legitimate", "slowite", "class_9"]


def test_ntz_micros_ignores_session_zone_and_dst(spark):
    from packetspark.functions.coerce import ntz_micros, normalise_timestamp_micros
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.createDataFrame([("2024-07-01 12:00:00.5",), ("1969-12-31 23:59:59",)], "s string")
        rows = df.select(ntz_micros(F.col("s").cast("timestamp_ntz")).alias("a"),
                         normalise_timestamp_micros(F.col("s")).alias("b")).collect()
        assert [r["a"] for r in rows] == [1719835200500000, -1000000]
        assert [r["b"] for r in rows] == [1719835200500000, -1000000]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_poison_values_never_fail(spark):
    from packetspark.functions.coerce import hex_float, hex_int, normalise_timestamp_micros, to_int
    bad = ["nan", "inf", "-Infinity", "1e30", "0x" + "f" * 20, "0xZZ", "", None, "9" * 40, "abc"]
    df = spark.createDataFrame([(x,) for x in bad], "s string")
    rows = df.select(to_int(F.col("s")).alias("i"), hex_int(F.col("s")).alias("h"), hex_float(F.col("s")).alias("f"),
                     normalise_timestamp_micros(F.col("s")).alias("t")).collect()
    assert [r["i"] for r in rows] == [0] * len(bad) and [r["h"] for r in rows] == [0] * len(bad)
    assert all(r["t"] is None for r in rows)
    ok = spark.createDataFrame([("0x1F",), ("0x00000000000000000010",), (" 7.9 ",)], "s string")
    assert [r[0] for r in ok.select(hex_int(F.col("s"))).collect()] == [31, 16, 7]


def test_small_numbers_are_days_only_in_numeric_columns(spark):
    from packetspark.functions.coerce import epoch_micros
    text = spark.createDataFrame([("12",), ("500000000",), ("1704067201",)], "timestamp string")
    assert [r[0] for r in text.select(epoch_micros(text, "timestamp")).collect()] == [None, None, 1704067201000000]
    num = spark.createDataFrame([(12.0,), (1704067201.0,), (1e30,)], "timestamp double")
    assert [r[0] for r in num.select(epoch_micros(num, "timestamp")).collect()] == [12 * 86400 * 10**6, 1704067201000000, None]


def test_label_in_any_case_survives(spark):
    from packetspark.functions.mapping import ml_projection
    df = spark.createDataFrame([(1.0, 3)], "frame_length double, Target int")
    assert ml_projection(df).columns == ["frame_length", "target"]
