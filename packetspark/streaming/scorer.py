"""Streaming feature extraction and scoring (ST1-ST10).

One Structured Streaming query: text records -> stateless mapping (M7) and
caps (N8) -> one stateful operator per key (ST2, ST3, ST5) -> IAT cap,
scaling (N9), vector (ST7) -> model (ST8) -> one sink with a ``status``
column (``ok`` / ``late`` / ``bad``).

State per key holds the arrival-ordered buffer of ``(us, payload)`` trimmed
to the longest window, and the previous timestamp; keys share the calls and
rows of the state by groups (``GROUPS``).  Within a micro-batch the
rows of a key are processed in ``(us, event_id)`` order; across micro-batches
in arrival order (the reference's semantics).  The default key is
``device_id``; a constant key reproduces the reference's single global
stream (one task, documented as such).
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from packetspark import schema as S
from packetspark.functions.coerce import hex_float, normalise_timestamp_micros
from packetspark.functions.mapping import feature_map, map_features
from packetspark.operators.stats import SERVE_CAP_TARGETS, apply_caps, scaler_transform
from packetspark.session import written

MICROS = 1_000_000
#: Groups of devices that a stream without ``idle`` keeps its state by: a call of the state function costs some milliseconds
#: before its first row.  A checkpoint is bound to it.
GROUPS = 2048
#: Seconds of a time after all packets (the year 2200; pandas times end in 2262).
FAR = 7_258_118_400

STATE_SCHEMA = T.StructType([
    T.StructField("buf_device", T.ArrayType(T.LongType())),
    T.StructField("buf_us", T.ArrayType(T.LongType())),
    T.StructField("buf_p", T.ArrayType(T.DoubleType())),
    T.StructField("device", T.ArrayType(T.LongType())),
    T.StructField("prev_us", T.ArrayType(T.LongType())),
])


def temporal_schema(windows: Sequence[int], key: str) -> T.StructType:
    fields = [T.StructField(key, T.LongType()), T.StructField("event_id", T.LongType()),
              T.StructField("us", T.LongType()), T.StructField("iat", T.DoubleType())]
    for w in windows:
        fields += [T.StructField(S.rate_col(w), T.DoubleType()),
                   T.StructField(S.mean_col(w), T.DoubleType()),
                   T.StructField(S.std_col(w), T.DoubleType())]
    fields.append(T.StructField("status", T.StringType()))
    return T.StructType(fields)


def _frames_any_order(all_us: np.ndarray, all_p: np.ndarray, us: np.ndarray, pos: np.ndarray, windows: Sequence[int]) -> dict:
    """Count, sum and sum of squares of the rows before ``pos`` in order of
    arrival whose time is in ``[us - w, us]``, for times in any order.

    The rows before ``pos`` are one block of each power of two in ``pos``.  Per
    power all blocks are sorted by time at once and every frame is a pair of
    binary searches in its block: n log^2 n, without a loop over rows."""
    times, rank = np.unique(all_us, return_inverse=True)
    span = len(times) + 1
    high = np.searchsorted(times, us, side="right")
    low = {w: np.searchsorted(times, us - w * MICROS, side="left") for w in windows}
    out = {w: (np.zeros(len(us)), np.zeros(len(us)), np.zeros(len(us))) for w in windows}
    at = np.arange(len(all_us))
    for bit in range(int(len(all_us)).bit_length()):
        rows = np.flatnonzero((pos >> bit) & 1)
        if not len(rows):
            continue
        key = (at >> bit) * span + rank
        order = np.argsort(key, kind="stable")
        key, p = key[order], all_p[order]
        sums, squares = np.concatenate([[0.0], np.cumsum(p)]), np.concatenate([[0.0], np.cumsum(p * p)])
        block = ((pos[rows] >> bit) - 1) * span
        end = np.searchsorted(key, block + high[rows], side="left")
        for w in windows:
            begin = np.searchsorted(key, block + low[w][rows], side="left")
            n, total, square = out[w]
            n[rows] += end - begin
            total[rows] += sums[end] - sums[begin]
            square[rows] += squares[end] - squares[begin]
    return out


def window_features(buf_us: np.ndarray, buf_p: np.ndarray, us: np.ndarray, p: np.ndarray,
                    windows: Sequence[int]) -> dict:
    """Exclusive windows for rows ``us`` (in processing order) given the
    earlier buffer: row i sees the buffer and rows < i with
    ``t_i - w <= t_j <= t_i``.  Sorted input uses prefix sums + binary
    search; out-of-order input a merge-sort tree over the order of arrival."""
    all_us = np.concatenate([buf_us, us])
    all_p = np.concatenate([buf_p, p])
    nb = len(buf_us)
    pos = nb + np.arange(len(us))
    out = {}
    if len(all_us) == 0 or np.all(np.diff(all_us) >= 0):
        cs = np.concatenate([[0.0], np.cumsum(all_p)])
        css = np.concatenate([[0.0], np.cumsum(all_p * all_p)])
        for w in windows:
            lo = np.searchsorted(all_us, us - w * MICROS, side="left")
            lo = np.minimum(lo, pos)
            n = (pos - lo).astype("float64")
            s = cs[pos] - cs[lo]
            ss = css[pos] - css[lo]
            out[w] = (n, s, ss)
    else:
        out = _frames_any_order(all_us, all_p, us, pos, windows)
    res = {}
    for w, (n, s, ss) in out.items():
        res.update(_moments(w, n, s, ss))
    return res


def _moments(w: int, n: np.ndarray, s: np.ndarray, ss: np.ndarray) -> dict:
    """Features of a window from count, sum and sum of squares of its rows."""
    safe = np.where(n > 0, n, 1.0)
    mean = np.where(n > 0, s / safe, 0.0)
    var = np.where(n > 1, np.maximum(ss / safe - mean * mean, 0.0), 0.0)
    return {S.rate_col(w): n / w, S.mean_col(w): mean, S.std_col(w): np.sqrt(var)}


@contextmanager
def one_stateful_operator(spark: SparkSession):
    """Streams started meanwhile have one stateful operator and may have two event-time columns."""
    name = "spark.sql.streaming.statefulOperator.allowMultiple"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _running(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums from the start of each device's rows: the one before row i of device g is at i + g, the one after its last row one further."""
    out = np.zeros(len(values) + len(cuts) - 1)
    for g, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
        np.cumsum(values[a:b], out=out[a + g + 1:b + g + 1])
    return out


def device_windows(buf_dev: np.ndarray, buf_us: np.ndarray, buf_p: np.ndarray, dev: np.ndarray, us: np.ndarray, p: np.ndarray,
                   windows: Sequence[int]) -> dict:
    """``window_features`` of many devices at once, for new rows in order of (device, time).

    All rows of the buffer came before, in any order of time: sorted once, they answer by two binary searches per frame; of
    the new rows a frame has those from its begin to the row itself."""
    devices, times = np.unique(np.concatenate([buf_dev, dev])), np.unique(np.concatenate([buf_us, us]))
    span, of = len(times) + 1, np.searchsorted(devices, dev)
    key = of * span + np.searchsorted(times, us)
    old = np.searchsorted(devices, buf_dev) * span + np.searchsorted(times, buf_us)
    order = np.argsort(old, kind="stable")
    old, buf_p = old[order], buf_p[order]
    sides = []
    for k, v in ((old, buf_p), (key, p)):
        cuts = np.searchsorted(k, np.arange(len(devices) + 1) * span)
        sides.append((k, _running(v, cuts), _running(v * v, cuts)))
    ends, res = (np.searchsorted(old, key, side="right"), np.arange(len(us))), {}
    for w in windows:
        low = of * span + np.searchsorted(times, us - w * MICROS, side="left")
        n, s, ss = np.zeros(len(us)), np.zeros(len(us)), np.zeros(len(us))
        for (k, sums, squares), end in zip(sides, ends):
            begin = np.searchsorted(k, low, side="left")
            n += end - begin
            s += sums[end + of] - sums[begin + of]
            ss += squares[end + of] - squares[begin + of]
        res.update(_moments(w, n, s, ss))
    return res


def make_state_fn(windows: Sequence[int], key: str, max_buffer: int | None = None, idle: int | None = None, also: dict[str, str] | None = None):
    """The state function of a group of devices (``grouped``).  ``also`` names, per further column of the result, the
    column of the records that it copies as a double.  A group is a call, so the call is plain arrays over all its devices
    and makes one frame.  With ``idle`` a group is one device and leaves the state once the
    watermark has passed its last row by so many seconds (at least the longest
    window); a row of status ``ended`` with that row's time says so."""
    windows = [int(w) for w in windows]
    wmax = max(windows) * MICROS

    def fn(k, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            ended = {key: [k[0]], "event_id": pd.array([None], dtype="Int64"), "us": [state.get[4][0]], "status": ["ended"]}
            state.remove()
            yield pd.DataFrame(ended).reindex(columns=temporal_schema(windows, key).names)
            return
        pdfs = list(pdfs)
        pdf = pdfs[0] if len(pdfs) == 1 else pd.concat(pdfs, ignore_index=True)
        dev, ids, us, no_id = (pdf[c].to_numpy(dtype=t) for c, t in (("_device", "int64"), ("_event", "int64"), ("us", "int64"), ("_no_event", "bool")))
        order = np.lexsort((ids, no_id, us, dev))
        dev, ids, us, no_id, p = dev[order], ids[order], us[order], no_id[order], pdf["_payload"].to_numpy(dtype="float64")[order]
        buf_dev, buf_us, buf_p, last_dev, last_us = (np.asarray(x or [], dtype=t) for x, t in zip(state.get if state.exists else [[]] * 5, ("int64", "int64", "float64", "int64", "int64")))
        first = np.flatnonzero(np.concatenate([[True], dev[1:] != dev[:-1]]))
        last = np.concatenate([first[1:], [len(dev)]]) - 1
        prev = np.concatenate([us[:1], us[:-1]])
        prev[first] = us[first]  # of a device's first row, unless the state knows an earlier one
        if len(last_dev):
            at = np.minimum(np.searchsorted(last_dev, dev[first]), len(last_dev) - 1)
            known = last_dev[at] == dev[first]
            prev[first[known]] = last_us[at[known]]
        feats = device_windows(buf_dev, buf_us, buf_p, dev, us, p, windows)
        wm = state.getCurrentWatermarkMs()
        late = (us // 1000) < wm if wm and wm > 0 else np.zeros(len(us), dtype=bool)
        status = np.full(len(us), "ok", dtype=object)
        status[late] = "late"
        copied = {c: pdf[source].to_numpy(dtype="float64")[order] for c, source in (also or {}).items()}
        nobody = pd.arrays.IntegerArray(dev, np.full(len(dev), bool(pd.isna(k[0]))))  # a null device is a group of its own
        out = pd.DataFrame({key: nobody, "event_id": pd.arrays.IntegerArray(ids, no_id), "us": us, "iat": (us - prev) / MICROS, **feats, "status": status, **copied}, copy=False)
        # New state: trim to the longest window (and optionally a row cap), by device, in order of arrival.
        all_dev, all_us, all_p = np.concatenate([buf_dev, dev]), np.concatenate([buf_us, us]), np.concatenate([buf_p, p])
        devices, of = np.unique(all_dev, return_inverse=True)
        newest = np.full(len(devices), np.iinfo(np.int64).min)
        np.maximum.at(newest, of, all_us)
        keep = np.flatnonzero(all_us >= newest[of] - wmax)
        if max_buffer:
            keep = keep[np.argsort(of[keep], kind="stable")]
            keep = np.sort(keep[np.searchsorted(of[keep], of[keep], "right") - np.arange(len(keep)) <= max_buffer])
        ends = np.full(len(devices), 0)
        ends[np.searchsorted(devices, last_dev)] = last_us
        ends[np.searchsorted(devices, dev[last])] = us[last]
        state.update((all_dev[keep].tolist(), all_us[keep].tolist(), all_p[keep].tolist(), devices.tolist(), ends.tolist()))
        if idle:
            state.setTimeoutTimestamp(max(int(all_us.max()) // 1000 + max(idle * 1000, wmax // 1000), wm or 0) + 1)
        yield out

    return fn


def grouped(good: DataFrame, key: str, groups: int | None, *columns):
    """Records by the group of their device: one of ``groups`` by its hash, the device itself without ``groups``; null is a group of its own."""
    device, event = F.col(key).cast("long"), F.col("event_id").cast("long")
    group = F.when(device.isNotNull(), F.pmod(F.xxhash64(device), F.lit(groups))) if groups else device
    return good.select(group.alias("_group"), F.coalesce(device, F.lit(0)).alias("_device"), F.coalesce(event, F.lit(0)).alias("_event"),
                       event.isNull().alias("_no_event"), "us", "ts", "_payload", *columns).groupBy("_group")


def parse_records(raw: DataFrame, hex_mode: str = "parse") -> DataFrame:
    """ST1 stateless part: timestamp (S5), mapping with defaults (M7),
    payload as float (missing -> 0).  ``us`` null marks a bad record."""
    x = raw.withColumn("us", normalise_timestamp_micros(F.col("timestamp")))
    x = x.withColumn("_payload", hex_float(F.col("mqtt_msg"), 0.0, hex_mode))
    for c in ("tcp_len", "mqtt_msg"):
        if c in x.columns:
            x = x.withColumn(c, hex_float(F.col(c), 0.0, hex_mode))
    x = map_features(x, hex_mode)
    return x.withColumn("mqtt_payload_len", F.col("_payload"))


def temporal_stream(parsed: DataFrame, windows: Sequence[int] = S.DEFAULT_WINDOWS,
                    key: str = "device_id", watermark: str = "1 hour",
                    max_buffer: int | None = None, caps: dict | None = None, idle: int | None = None) -> DataFrame:
    """ST2 / ST3 / ST5: stateful temporal features per key; with ``idle`` silent
    keys leave the state (``make_state_fn``): start such a stream under
    ``one_stateful_operator``."""
    good = parsed.where(F.col("us").isNotNull())
    if caps:
        good = apply_caps(good, caps, {"mqtt_msg": "_payload"})
    good = good.withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", watermark)
    if idle:
        # Before a state function with a timeout Spark drops rows that are late by the nearest event-time column.  This one is
        # never late, and the least of both watermarks is that of the packets: late rows reach the function and are flagged.
        good = good.withColumn("ts", F.timestamp_seconds(F.lit(FAR))).withWatermark("ts", "0 seconds")
    feats = (grouped(good, key, None if idle else GROUPS)
                 .applyInPandasWithState(make_state_fn(windows, key, max_buffer, idle),
                                         temporal_schema(windows, key), STATE_SCHEMA, "append",
                                         GroupStateTimeout.EventTimeTimeout if idle else GroupStateTimeout.NoTimeout))
    return feats


def score_stream(parsed: DataFrame, windows: Sequence[int] = S.DEFAULT_WINDOWS, key: str = "device_id",
                 watermark: str = "1 hour", scaler: dict | None = None, caps: dict | None = None,
                 model=None, model_kind: str = "label", max_buffer: int | None = None) -> DataFrame:
    """ST1 + ST6-ST8: full record pipeline as one streaming DataFrame.

    The static per-record features ride along through the state function
    by being re-derived from the record columns kept in the output."""
    good = parsed.where(F.col("us").isNotNull())
    if caps:
        good = apply_caps(good, caps, {"mqtt_msg": "_payload", "tcp_len": "frame_length"})
    good = good.withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", watermark)
    static_cols = ["frame_length", "protocol_flags", "mqtt_msgtype", "mqtt_qos", "mqtt_retain",
                   "mqtt_client_id_hash"]
    schema = temporal_schema(windows, key)
    for c in static_cols:
        schema = schema.add(T.StructField(c, T.DoubleType()))
    fn = make_state_fn(windows, key, max_buffer, also={**{c: c for c in static_cols}, "mqtt_payload_len": "_payload"})
    schema = schema.add(T.StructField("mqtt_payload_len", T.DoubleType()))
    feats = (grouped(good, key, GROUPS, *[F.col(c).cast("double") for c in static_cols])
                 .applyInPandasWithState(fn, schema, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout))
    if caps:
        feats = apply_caps(feats, caps, {k2: v for k2, v in SERVE_CAP_TARGETS.items() if k2 == "iat"})
    if scaler:
        feats = scaler_transform(feats, scaler)
    feats = feats.withColumns({c: (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in feats.columns
                                   else F.lit(0.0)) for c in S.FEATURES})
    feats = feats.withColumn("features_map", feature_map(S.FEATURES))
    scored = _apply_model(feats, model, model_kind)
    bad = parsed.where(F.col("us").isNull()).select(
        F.col(key).cast("bigint").alias(key), "event_id", F.lit(None).cast("bigint").alias("us"),
        F.lit(None).cast("map<string,double>").alias("features_map"),
        F.lit(None).cast("int").alias("predicted_label"), F.lit(None).cast("double").alias("confidence"),
        F.lit("bad").alias("status"),
        F.concat(F.lit("unparsable timestamp: "), F.coalesce(F.col("timestamp"), F.lit("null"))).alias("error"))
    good_out = scored.select(key, "event_id", "us", "features_map", "predicted_label", "confidence", "status",
                             F.lit(None).cast("string").alias("error"))
    return good_out.unionByName(bad)


def _apply_model(feats: DataFrame, model, kind: str) -> DataFrame:
    """ST8: probability model -> max probability; score model -> sigmoid of
    the raw score; any other fitted model gives its label with confidence 1.0."""
    if model is None:
        return feats.withColumn("predicted_label", F.lit(None).cast("int")) \
                    .withColumn("confidence", F.lit(None).cast("double"))
    if kind == "forest":
        from packetspark.operators.forest import with_scores
        x = with_scores(model, feats)
        return x.withColumn("predicted_label", F.col("prediction")).withColumn("confidence", F.array_max("probability_arr"))
    if kind == "iforest":
        from packetspark.functions.mapping import sigmoid_confidence
        from packetspark.operators import isoforest as IF
        x = IF.score(model, feats)
        x = IF.predict(x, model.offset or 0.0, threshold=model.threshold, flipped=model.flipped,
                       out="predicted_label")
        return x.withColumn("confidence", sigmoid_confidence(F.col("score")))
    return model.transform(feats).withColumn("predicted_label", F.col("prediction").cast("int")) \
                .withColumn("confidence", F.lit(1.0))


# ---------------------------------------------------------------- running (S12, S13, ST9)

def scratch(spark: SparkSession, name: str) -> str:
    """Fresh folder under the shared checkpoint folder (never machine-local
    on a cluster)."""
    from packetspark.session import checkpoint_dir
    base = checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def read_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """CSV records, all text."""
    r = spark.readStream.schema(S.STREAM_RAW).option("header", True)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.csv(path)


def run_to_sink(stream_df: DataFrame, out_path: str, checkpoint: str, partition_by: str | None = "status",
                fmt: str = "parquet") -> None:
    """S13 + ST9: append to one sink, ``availableNow`` replay, restartable
    from the checkpoint (no duplicates, no loss)."""
    w = stream_df.writeStream.format(fmt).option("path", out_path).option("checkpointLocation", checkpoint) \
        .outputMode("append").trigger(availableNow=True)
    if partition_by:
        w = w.partitionBy(partition_by)
    q = w.start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def run_scored(stream_df: DataFrame, model, out_path: str, checkpoint: str, model_kind: str = "forest") -> None:
    """ST8 for a model that is too large to be sent to every worker: ``stream_df``
    comes from ``score_stream`` without a model, and each micro-batch meets the
    model as a table.  A micro-batch has its own folder, so one that is repeated
    after a restart replaces its rows."""
    spark = stream_df.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        # the micro-batch is computed once: reading it twice would run its state twice
        staged = f"{out_path.rstrip('/')}-features/batch={number}"
        batch.write.mode("overwrite").parquet(staged)
        x = spark.read.schema(batch.schema).parquet(staged)
        good = x.where(F.col("features_map").isNotNull()).withColumns({c: F.col("features_map")[c] for c in S.FEATURES})
        scored = _apply_model(good.drop("predicted_label", "confidence"), model, model_kind).select(*x.columns)
        scored.unionByName(x.where(F.col("features_map").isNull())).write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/batch={number}")
    q = stream_df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def stage_records(records: DataFrame, path: str, files: int | None = None, mode: str = "overwrite") -> None:
    """Write records as the streaming source's text CSV (all columns as text)."""
    x = records.select(*[F.col(f.name).cast("string").alias(f.name) if f.name in records.columns
                         else F.lit(None).cast("string").alias(f.name) for f in S.STREAM_RAW.fields])
    if files:
        x = x.repartitionByRange(files, "timestamp")
    x.write.mode(mode).option("header", True).csv(path)


def records_from_packets(packets: DataFrame, bad_every: int | None = None) -> DataFrame:
    """Streaming records derived from the packets view: timestamp as text;
    optionally every ``bad_every``-th event gets an unparsable timestamp."""
    ts_text = F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    if bad_every:
        ts_text = F.when(F.col("event_id") % bad_every == 0, F.lit("not-a-time")).otherwise(ts_text)
    return packets.select("event_id", "device_id", ts_text.alias("timestamp"), "tcp_len", "tcp_flags", "mqtt_msg",
                          "mqtt_hdrflags", "mqtt_conflags", "mqtt_conack_flags", "mqtt_qos")


def tumbling_rates(df: DataFrame, width: str = "10 seconds", key: str = "device_id",
                   watermark: str | None = "1 minute", ts: str = "ts") -> DataFrame:
    """ST10: packets per device per tumbling window (coarse form of T4).
    Works on a stream (with a watermark, append mode) and on a batch frame."""
    x = df.withWatermark(ts, watermark) if (watermark and df.isStreaming) else df
    return (x.groupBy(key, F.window(ts, width).alias("w"))
             .agg(F.count(F.lit(1)).alias("n"), F.avg("mqtt_payload_len").alias("mean_payload"))
             .select(key, F.unix_micros(F.col("w.start")).alias("window_start_us"), "n", "mean_payload"))


def limit_successes(results: DataFrame, max_records: int | None, order=("event_id",)) -> DataFrame:
    """R7 on a replayed (bounded) result: keep rows up to the ``max_records``-th
    successful one in record order; failures before it are kept too, as the
    reference counts successes only, and nothing after it.  A bad record has no
    time, so the order is that of the record ids.  0 / None means no limit."""
    if not max_records:
        return results
    from packetspark.operators.timeline import ordered_scan
    ok = (F.col("status") != F.lit("bad")).cast("double")
    x = ordered_scan(results, order=list(order), sums={"ok": ok}, prefix="_lim_")
    return x.where(F.col("_lim_ok_before") < F.lit(float(max_records))).drop("_lim_idx", "_lim_ok_before")


def replay(spark: SparkSession, src: str, out: str, checkpoint: str, max_records: int | None = None,
           **score_kw) -> DataFrame:
    """ST9 + R7: replay a folder of records through the streaming scorer with
    ``availableNow`` and return the written results, cut after the
    ``max_records``-th success (0 / None = all)."""
    run_to_sink(score_stream(parse_records(read_stream(spark, src)), **score_kw), out, checkpoint)
    return limit_successes(spark.read.parquet(out), max_records)


def run_in_batches(batches: Sequence[DataFrame], make: Callable[[DataFrame], DataFrame], src: str, out: str, checkpoint: str,
                   partition_by: str | None = None) -> None:
    """Stages each batch of records and replays what is new, from one checkpoint:
    the micro-batches come in a fixed order, and state, watermark and sink go on
    across restarts of the query."""
    for records in batches:
        spark = records.sparkSession
        stage_records(records, src, mode="append")
        run_to_sink(make(parse_records(read_stream(spark, src))), out, checkpoint, partition_by=partition_by)


def _ledger(spark: SparkSession, path: str) -> dict[int, int]:
    """Successes written per micro-batch (one small row each)."""
    from pyspark.errors import AnalysisException
    try:
        return {r["batch"]: r["successes"] for r in spark.read.schema("successes long, batch long").parquet(path).collect()}
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}


def run_until(stream_df: DataFrame, out: str, checkpoint: str, max_records: int | None, order=("event_id",), poll: float = 0.2) -> int:
    """R7 while streaming: stops after the ``max_records``-th success.

    The count of successes is kept beside the sink, a row per micro-batch, so a
    restarted query goes on counting and a repeated micro-batch replaces its own
    rows.  A micro-batch after the limit is not computed.  Returns the successes
    so far; 0 / None means no limit."""
    spark, counts = stream_df.sparkSession, f"{out.rstrip('/')}-successes"

    def done(before: int | None = None) -> int:
        return sum(n for b, n in _ledger(spark, counts).items() if before is None or b < before)

    def write(batch: DataFrame, number: int) -> None:
        left = max_records - done(number) if max_records else None
        if left is not None and left <= 0:
            return
        path = f"{out.rstrip('/')}/batch={number}"
        # the micro-batch is computed once: reading it twice would run its state twice
        limit_successes(written(batch, "stream-batch"), left, order).write.mode("overwrite").parquet(path)
        n = batch.sparkSession.read.parquet(path).where("status <> 'bad'").count()
        batch.sparkSession.createDataFrame([(n,)], "successes long").write.mode("overwrite").parquet(f"{counts}/batch={number}")
    if max_records and done() >= max_records:
        return done()
    q = stream_df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    while not q.awaitTermination(poll):
        if max_records and done() >= max_records:
            q.stop()
            break
    if q.exception():
        raise q.exception()
    return done()
