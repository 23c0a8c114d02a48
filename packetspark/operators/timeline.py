"""Global and keyed time order.

The reference treats the whole packet table as one time series.  A plain
``Window.orderBy(...)`` would put that series on one task, so two
distributed building blocks are used instead:

``ordered_scan``
    Row-level order on ``(group..., order...)`` for lag, row index and
    exclusive running sums.  Rows are range-partitioned on the full sort key
    (Spark samples the key, so a hot timestamp or device is split across
    segments because the tie-breaker differs), each segment is scanned by a
    window, and a *segment table* with exactly one row per range partition
    (a bound fixed by configuration, or one per ``SEGMENT_ROWS`` rows) carries counts, sums and the
    last row across segment borders through a broadcast join.

``window_stats``
    Range frames ``[t - w, t]`` over time in linear work.  Packets are first
    collapsed to one row per distinct ``(key, microsecond)``, so a flood of
    identical timestamps is one row.  A frame is the running sum at ``t`` minus
    the running sum just before ``t - w``: every row adds one probe event per
    window, and one ``ordered_scan`` over rows and probes gives all running
    sums.  The scan starts anew in each bucket of the longest window (with the
    bucket before as context), around the bucket's rounded mean, which keeps
    sums of whole numbers exact; being range-partitioned it splits a dense bucket
    over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from packetspark import schema as S
from packetspark.session import written

MICROS = 1_000_000
#: Rows of a segment of an ordered scan, where their number is known.
SEGMENT_ROWS = 1_000_000


def _parts(df: DataFrame, partitions: int | None, rows: int | None = None) -> int:
    """Segments: the session's shuffle partitions, and more where ``rows`` would fill them beyond ``SEGMENT_ROWS``."""
    if partitions:
        return int(partitions)
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), -(-(rows or 0) // SEGMENT_ROWS))


def bucket_of(us: Column, width_us: int) -> Column:
    """Floor division that is exact for negative epochs."""
    return ((us - F.pmod(us, F.lit(width_us))) / F.lit(width_us)).cast("bigint")


# --------------------------------------------------------------------------
# Row-level ordered scan
# --------------------------------------------------------------------------

def ordered_scan(df: DataFrame, order: Sequence[str], group: Sequence[str] = (),
                 sums: dict[str, Column] | None = None,
                 lags: Sequence[str] = (), partitions: int | None = None,
                 prefix: str = "", carry: Sequence[str] = (), scan_of: DataFrame | None = None,
                 rows: int | None = None) -> DataFrame:
    """Adds, per row and within ``group`` in ``order``:

    * ``{prefix}idx``: 0-based position,
    * ``{prefix}{name}_before``: sum of ``sums[name]`` over earlier rows,
    * ``{prefix}prev_{col}``: value of ``col`` on the previous row (null on
      the first row of the group).

    ``order`` must be a total order (end it with a unique id).  The scan runs
    on a narrow projection (sort key, summed values, lagged values) and the
    results are joined back to the full rows on the unique sort key, so only
    the narrow columns are shuffled by range and cached.  ``carry`` names
    further columns that travel with the scan; if they are all that is left,
    there is no join.  ``scan_of`` is scanned in place of ``df`` (same rows).
    ``rows``, about how many there are, keeps segments small: a segment is sorted
    in one task, so a fixed number of them would hold ever more rows each.
    """
    sums = dict(sums or {})
    group, order, lags = list(group), list(order), list(lags)
    P = _parts(df, partitions, rows)
    sort_key = group + order
    narrow = list(dict.fromkeys(sort_key + lags + list(carry)))

    x = (df if scan_of is None else scan_of).select(*narrow, *[F.coalesce(e.cast("double"), F.lit(0.0)).alias(f"_v_{n}") for n, e in sums.items()])
    if lags:
        x = x.withColumn("_lagv", F.struct(*[F.col(c) for c in lags]))
    # A segment stays a partition of its own: dealt by a hash of its number, several would meet in one task, and Spark
    # would join small partitions by their compressed bytes, which for sorted events hides many rows.
    x = x.repartitionByRange(P, *sort_key).withColumn("_seg", F.spark_partition_id()).repartitionById(P, "_seg")
    gkey = F.struct(*[F.col(c) for c in group]) if group else F.lit(0)
    x = x.withColumn("_g", gkey)
    # The segment's own window comes first: its sort also serves the groups inside the segment.
    whole = Window.partitionBy("_seg").orderBy(*group, *order)
    x = x.withColumns({"_head": F.lag(F.lit(1)).over(whole).isNull(), "_tail": F.lead(F.lit(1)).over(whole).isNull(),
                       "_first": F.col("_g").eqNullSafe(F.first("_g").over(whole))})
    w = Window.partitionBy("_seg", "_g").orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    scans = {"_rn": F.row_number().over(w) - 1}
    scans |= {f"_in_{n}": F.coalesce(F.sum(f"_v_{n}").over(before), F.lit(0.0)) for n in sums}
    if lags:
        scans["_lag_in"] = F.lag("_lagv").over(w)
    # The segment id comes from one range exchange whose bounds are sampled
    # when it runs; every consumer below must see the same assignment, so the
    # segmented rows are written once.
    x = written(x.withColumns(scans), "scan")
    x = x.join(F.broadcast(_carried(x, list(sums), bool(lags))), "_seg", "left")

    def from_before(inside: Column, carried: str, zero) -> Column:
        return inside + F.when(F.col("_first"), F.col(carried)).otherwise(F.lit(zero))

    new = {f"{prefix}idx": from_before(F.col("_rn"), "_c_cnt", 0)}
    new |= {f"{prefix}{n}_before": from_before(F.col(f"_in_{n}"), f"_c_{n}", 0.0) for n in sums}
    if lags:
        prev = F.when(F.col("_rn") > 0, F.col("_lag_in")).when(F.col("_first"), F.col("_c_last"))
        new |= {f"{prefix}prev_{c}": prev[c] for c in lags}
    out = x.withColumns(new)
    produced = [f"{prefix}idx"] + [f"{prefix}{n}_before" for n in sums] + [f"{prefix}prev_{c}" for c in lags]
    if all(c in narrow for c in df.columns):
        return out.select(*df.columns, *produced)
    keyed = out.select(*[F.col(c).alias(f"_ok{i}") for i, c in enumerate(sort_key)], *produced)
    cond = [df[c].eqNullSafe(keyed[f"_ok{i}"]) for i, c in enumerate(sort_key)]
    return df.join(keyed, cond, "inner").drop(*[f"_ok{i}" for i in range(len(sort_key))])


def _carried(x: DataFrame, sums: Sequence[str], lagged: bool) -> DataFrame:
    """Segment table: what earlier segments hold of the group that a segment
    begins with.  It has one row per range partition, and the driver sees only
    the first and last row of each partition (narrow columns) to make it."""
    picked = [F.col("_rn") + 1, *[F.col(f"_in_{n}") + F.col(f"_v_{n}") for n in sums]]
    picked += [F.col("_lagv")] if lagged else []
    names = ["_c_cnt", *[f"_c_{n}" for n in sums], *(["_c_last"] if lagged else [])]
    edges = x.where(F.col("_head") | F.col("_tail")).select(
        "_seg", "_g", "_head", "_tail", "_first", *[c.alias(n) for c, n in zip(picked, names)])
    rows, held_group, held = [], None, [0, *[0.0 for _ in sums], *([None] if lagged else [])]
    empty = list(held)
    for r in sorted(edges.collect(), key=lambda r: (r["_seg"], not r["_head"])):
        g = repr(r["_g"])
        if r["_head"]:
            if g != held_group:
                held = list(empty)
            rows.append((r["_seg"], *held))
        if r["_tail"]:
            last = [r[n] for n in names]
            if r["_first"]:  # the whole segment is one group: it adds to what was before
                n = 1 + len(sums)
                last[:n] = [a + b for a, b in zip(held[:n], last[:n])]
            held_group, held = g, last
    schema = StructType([StructField("_seg", IntegerType())] + [StructField(n, edges.schema[n].dataType) for n in names])
    return x.sparkSession.createDataFrame(rows, schema)


# --------------------------------------------------------------------------
# IAT (T2, T3)
# --------------------------------------------------------------------------

def inter_arrival(df: DataFrame, mode: str = "delta_diff", keys: Sequence[str] = (),
                  us: str = "us", tiebreak: str = "event_id", out: str = "iat",
                  partitions: int | None = None, index_out: str | None = None,
                  scan_of: DataFrame | None = None) -> DataFrame:
    """Inter-arrival time in seconds; first row (and null) -> 0.

    ``delta_diff``: difference of consecutive ``tcp_time_delta`` (the batch
    reference whenever that column exists); ``ts_gap``: timestamp gap.
    ``index_out`` also keeps the row position from the same scan (R1).
    ``scan_of`` names a cheaper frame with the same rows to scan, where ``df``
    adds columns to it.
    """
    if mode == "delta_diff" and "tcp_time_delta" not in df.columns:
        mode = "ts_gap"
    lagc = "tcp_time_delta" if mode == "delta_diff" else us
    x = ordered_scan(df, order=[us, tiebreak], group=keys, lags=[lagc],
                     partitions=partitions, prefix="_os_", scan_of=scan_of,
                     rows=scan_of.count() if scan_of is not None else None)
    if mode == "delta_diff":
        v = F.col("tcp_time_delta") - F.col(f"_os_prev_{lagc}")
    else:
        v = (F.col(us) - F.col(f"_os_prev_{lagc}")) / F.lit(float(MICROS))
    x = x.withColumn(out, F.coalesce(v.cast("double"), F.lit(0.0))).drop(f"_os_prev_{lagc}")
    if index_out:
        return x.withColumnRenamed("_os_idx", index_out)
    return x.drop("_os_idx")


# --------------------------------------------------------------------------
# Sliding windows
# --------------------------------------------------------------------------

def _collapse(rows: DataFrame, keys: Sequence[str], us: str) -> DataFrame:
    """One row per (key, microsecond): count, sum and sum of squares of the
    value ``_x`` around ``_m``, the rounded mean of the row's bucket ``_b``.
    ``_next_m`` is that of the bucket after it (null where that is empty).  For
    whole-number values (payload lengths) every sum stays a whole number, so
    differences of running sums are exact."""
    means = rows.groupBy(*keys, "_b").agg(F.round(F.avg("_x")).alias("_m"))
    after = means.select(*keys, (F.col("_b") - 1).alias("_b"), F.col("_m").alias("_next_m"))
    off = F.col("_x") - F.col("_m")
    return (rows.join(means, [*keys, "_b"]).join(after, [*keys, "_b"], "left").groupBy(*keys, us, "_b")
            .agg(F.max("_m").alias("_m"), F.max("_next_m").alias("_next_m"), F.count(F.lit(1)).alias("_n"),
                 F.sum(off).alias("_s"), F.sum(off * off).alias("_ss")))


def _finish(n: Column, s: Column, ss: Column, centre: Column, w: int, rate: str, mean: str, std: str):
    mean_v = F.when(n > 0, centre + s / n).otherwise(F.lit(0.0))
    var = F.when(n > 1, F.greatest(ss / n - (s / n) * (s / n), F.lit(0.0))).otherwise(F.lit(0.0))
    return [(n.cast("double") / F.lit(float(w))).alias(rate), mean_v.alias(mean), F.sqrt(var).alias(std)]


def window_stats(df: DataFrame, windows: Sequence[int] = S.DEFAULT_WINDOWS,
                 value: str = "mqtt_payload_len", keys: Sequence[str] = (),
                 us: str = "us", tiebreak: str = "event_id",
                 include_current: bool = True, partitions: int | None = None) -> DataFrame:
    """T4-T7 (T8 with ``keys``): per packet and window w (seconds)

    * ``msg_rate_{w}s``: rows with ``t - w <= t' <= t`` divided by w,
    * ``rolling_mean_payload_{w}s``, ``rolling_std_payload_{w}s``: mean and
      population std of the payload (null counts as 0) over the same rows.

    ``include_current=True`` is the batch form (the row itself and all rows
    with the same timestamp count).  ``False`` is the streaming form: only rows
    earlier in ``(us, tiebreak)`` order; an empty frame gives 0.
    """
    windows = [int(w) for w in windows]
    keys = list(keys)
    wmax = max(windows) * MICROS
    # The input is read once for the windows and once for the join of their results: everything between works on
    # narrow written tables.
    rows = written(df.where(F.col(us).isNotNull()).select(
        *dict.fromkeys([*keys, us, *([] if include_current else [tiebreak])]),
        F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("_x"), bucket_of(F.col(us), wmax).alias("_b")), "window-rows")
    d = written(_collapse(rows, keys, us), "window-collapsed")

    # Events of a bucket: its rows, those of the bucket before around its
    # mean, and a probe per row and window, which sorts before a row of its time.
    shift = F.col("_m") - F.col("_next_m")
    none = F.lit(None)
    own = d.select(*keys, "_b", F.col(us).alias("_t"), F.lit(1).alias("_w"), F.col(us).alias("_own"), "_m", "_n", "_s", "_ss")
    context = d.where(F.col("_next_m").isNotNull()).select(
        *keys, (F.col("_b") + 1).alias("_b"), F.col(us).alias("_t"), F.lit(1).alias("_w"),
        none.cast("bigint").alias("_own"), none.cast("double").alias("_m"), "_n", (F.col("_s") + F.col("_n") * shift).alias("_s"),
        (F.col("_ss") + 2 * shift * F.col("_s") + F.col("_n") * shift * shift).alias("_ss"))
    probes = d.withColumn("_w", F.explode(F.array(*[F.lit(-w) for w in windows]))).select(
        *keys, "_b", (F.col(us) + F.col("_w").cast("bigint") * MICROS).alias("_t"), "_w", F.col(us).alias("_own"),
        none.cast("double").alias("_m"), F.lit(0).cast("bigint").alias("_n"), F.lit(0.0).alias("_s"), F.lit(0.0).alias("_ss"))
    events = own.unionByName(context).unionByName(probes)
    n_events = (2 + len(windows)) * d.count()  # at most
    scan = ordered_scan(events, order=["_t", "_w"], group=[*keys, "_b"], carry=["_own", "_m", "_n", "_s", "_ss"],
                        sums={"n": F.col("_n"), "s": F.col("_s"), "ss": F.col("_ss")},
                        partitions=partitions, prefix="_w_", rows=n_events)
    sums = {c: F.col(f"_w_{c}_before") + (F.col(f"_{c}") if include_current else F.lit(0.0)) for c in ("n", "s", "ss")}
    picked = [F.max(F.when(F.col("_w") == 1, e)).alias(f"_at_{c}") for c, e in sums.items()]
    picked += [F.max(F.when(F.col("_w") == -w, F.col(f"_w_{c}_before"))).alias(f"_from_{c}{w}")
               for w in windows for c in ("n", "s", "ss")]
    frames = (scan.where(F.col("_own").isNotNull()).groupBy(*keys, "_b", F.col("_own").alias(us))
              .agg(F.max("_m").alias("_m"), *picked).drop("_b"))

    def frame(c: str, w: int) -> Column:
        return F.col(f"_at_{c}") - F.col(f"_from_{c}{w}")

    tie, on = {c: F.lit(0.0) for c in ("n", "s", "ss")}, [*keys, us]
    if not include_current:
        # Rows with the same timestamp that come earlier by the tie-breaker.
        frames = rows.join(frames, on).withColumn("_pv", F.col("_x") - F.col("_m")).drop("_x", "_b")
        frames = ordered_scan(frames, order=[tiebreak], group=on, carry=[c for c in frames.columns if c not in [*on, tiebreak]],
                              sums={"n": F.lit(1.0), "s": F.col("_pv"), "ss": F.col("_pv") * F.col("_pv")},
                              partitions=partitions, prefix="_tie_", rows=rows.count())
        tie, on = {c: F.col(f"_tie_{c}_before") for c in ("n", "s", "ss")}, [*on, tiebreak]
    out_cols = []
    for w in windows:
        out_cols += _finish(*[frame(c, w) + tie[c] for c in ("n", "s", "ss")], F.col("_m"), w,
                            S.rate_col(w), S.mean_col(w), S.std_col(w))
    found = df.join(frames.select(*on, *out_cols), on, "left")
    # a row without a timestamp is in no frame: no rate, mean and deviation 0
    return found.select(*df.columns, *[c for w in windows for c in (
        F.col(S.rate_col(w)), F.coalesce(S.mean_col(w), F.lit(0.0)).alias(S.mean_col(w)),
        F.coalesce(S.std_col(w), F.lit(0.0)).alias(S.std_col(w)))])


# --------------------------------------------------------------------------
# Global index, split
# --------------------------------------------------------------------------

def with_global_index(df: DataFrame, order: Sequence[str] = ("us", "event_id"),
                      out: str = "row_idx", partitions: int | None = None, rows: int | None = None) -> DataFrame:
    x = ordered_scan(df, order=list(order), partitions=partitions, prefix="_gi_", rows=rows)
    return x.withColumnRenamed("_gi_idx", out)


def time_split(df: DataFrame, train_ratio: float = 0.6, val_ratio: float = 0.2,
               order: Sequence[str] = ("us", "event_id"), partitions: int | None = None,
               total: int | None = None, index_col: str | None = None) -> DataFrame:
    """First ``int(n*train)`` rows by time are 'train', the next
    ``int(n*val)`` 'validation', the rest 'test'.  Adds ``split``.
    ``index_col`` reuses a position computed earlier in the same order."""
    if total is None:
        total = df.count()
    n_train = int(total * train_ratio)
    n_val = int(total * val_ratio)
    if index_col:
        x = df.withColumnRenamed(index_col, "_split_idx")
    else:
        x = with_global_index(df, order, out="_split_idx", partitions=partitions, rows=total)
    split = (F.when(F.col("_split_idx") < F.lit(n_train), F.lit("train"))
              .when(F.col("_split_idx") < F.lit(n_train + n_val), F.lit("validation"))
              .otherwise(F.lit("test")))
    return x.withColumn("split", split).drop("_split_idx")


def split_profile(split_df: DataFrame, us: str = "us") -> DataFrame:
    """R2: rows, share and time range per split."""
    total = F.sum("rows").over(Window.partitionBy())
    prof = split_df.groupBy("split").agg(F.count(F.lit(1)).alias("rows"),
                                         F.min(us).alias("min_us"), F.max(us).alias("max_us"))
    return prof.withColumn("share", F.round(F.col("rows") / total, 6))
