"""Statistics, capping and scaling.

Exact quantiles at scale
------------------------
``percentile`` keeps every distinct value of a group in one task, which does
not survive a global column of a hundred terabytes.  ``exact_quantiles``
counts each distinct value (partial aggregation, so ties collapse before the
shuffle), range-partitions the distinct values into bounded segments and finds
the segment of every needed rank from the segments' totals; only those
segments are scanned.  There is one path for every size and every
distribution.  The result equals linear-interpolation quantiles (pandas /
NumPy default, DuckDB ``quantile_cont``).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetspark import schema as S
from packetspark.session import written


def _finite(c: Column) -> Column:
    """NaN -> null, so that aggregates skip it as pandas skips NaN."""
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                    values_per_segment: int = 1_000_000) -> dict[str, list[float | None]]:
    """Exact linear-interpolation quantiles for several columns at once.

    The driver sees one row per column, one per (segment, column) and one per
    needed rank.  A column without a value gives nulls.
    """
    columns, probs = list(columns), [float(p) for p in probs]
    cells = F.array(*[F.struct(F.lit(i).alias("c"), _finite(F.col(c).cast("double")).alias("v"))
                      for i, c in enumerate(columns)])
    values = df.select(F.explode(cells).alias("x")).select("x.c", "x.v").where(F.col("v").isNotNull())
    distinct = written(values.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n")), "distinct-values")
    sizes = {r["c"]: (r["n"], r["d"]) for r in distinct.groupBy("c").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("d")).collect()}
    if not sizes:
        return {c: [None] * len(probs) for c in columns}
    segments = max(1, math.ceil(sum(d for _, d in sizes.values()) / values_per_segment))
    if segments == 1:  # all values are one segment as they are
        seg = distinct.withColumn("seg", F.lit(0))
    else:
        seg = written(distinct.repartitionByRange(segments, "c", "v").withColumn("seg", F.spark_partition_id()), "value-segments")
    totals = seg.groupBy("c", "seg").agg(F.sum("n").alias("n")).orderBy("c", "seg").collect()

    # The segment that holds each needed rank (0-based), and the rank inside it.
    need: list[tuple[int, int, int, int]] = []
    before: dict[int, int] = {}
    for r in totals:
        c, start = r["c"], before.get(r["c"], 0)
        before[c] = start + r["n"]
        ranks = {k for p in probs for k in (math.floor((sizes[c][0] - 1) * p), math.ceil((sizes[c][0] - 1) * p))}
        need += [(c, r["seg"], k, k - start) for k in sorted(ranks) if start <= k < start + r["n"]]
    wanted = df.sparkSession.createDataFrame(need, "c int, seg int, k long, local long")
    run = Window.partitionBy("c", "seg").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    cells_at = (seg.where(F.col("seg").isin(sorted({s for _, s, _, _ in need})))
                   .withColumn("before", F.coalesce(F.sum("n").over(run), F.lit(0)))
                   .join(F.broadcast(wanted), ["c", "seg"])
                   .where((F.col("local") >= F.col("before")) & (F.col("local") < F.col("before") + F.col("n"))))
    found = {(r["c"], r["k"]): r["v"] for r in cells_at.select("c", "k", "v").collect()}
    if len(found) != len(need):
        raise RuntimeError("a rank was not found in its segment")
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(columns):
        if i not in sizes:
            out[c] = [None] * len(probs)
            continue
        out[c] = []
        for p in probs:
            h = (sizes[i][0] - 1) * p
            a, b = found[i, math.floor(h)], found[i, math.ceil(h)]
            out[c].append(a + (h - math.floor(h)) * (b - a))
    return out


# --------------------------------------------------------------------------
# Capping
# --------------------------------------------------------------------------

def iqr_bounds(df: DataFrame, columns: Sequence[str], factor: float = S.IQR_FACTOR,
               **kw) -> dict[str, dict]:
    """N2 (fit): ``[q1 - f*IQR, q3 + f*IQR]`` for the columns present."""
    cols = [c for c in columns if c in df.columns]
    if not cols:
        return {}
    q = exact_quantiles(df, cols, [0.25, 0.75], **kw)
    out = {}
    for c in cols:
        q1, q3 = q[c]
        if q1 is None:
            continue
        iqr = q3 - q1
        out[c] = {"q1": q1, "q3": q3, "lower": q1 - factor * iqr, "upper": q3 + factor * iqr}
    return out


def clip(c: Column, lower: float, upper: float) -> Column:
    """Clip keeping null (``greatest`` / ``least`` alone would skip nulls)."""
    return F.when(c.isNull(), c).otherwise(F.least(F.greatest(c, F.lit(lower)), F.lit(upper)))


def apply_caps(df: DataFrame, bounds: dict[str, dict], targets: dict[str, str] | None = None) -> DataFrame:
    """N2 (transform) / N8: clip columns by fitted bounds.

    ``targets`` maps a bounds column to the column it is applied to
    (N8: ``tcp_len`` caps applied to ``frame_length``).
    """
    targets = targets or {c: c for c in bounds}
    new = {}
    for src, dst in targets.items():
        if src in bounds and dst in df.columns:
            b = bounds[src]
            new[dst] = clip(F.col(dst).cast("double"), b["lower"], b["upper"])
    return df.withColumns(new) if new else df


def cap_counts(df: DataFrame, bounds: dict[str, dict]) -> DataFrame:
    """Rows below / above the bounds per column (one aggregate)."""
    from functools import reduce
    parts = []
    for c, b in bounds.items():
        v = F.col(c).cast("double")
        parts.append(df.agg(F.lit(c).alias("column"),
                            F.count_if(v < F.lit(b["lower"])).alias("n_lower"),
                            F.count_if(v > F.lit(b["upper"])).alias("n_upper")))
    return reduce(DataFrame.unionByName, parts)


def iqr_cap(df: DataFrame, columns: Sequence[str], factor: float = S.IQR_FACTOR, **kw):
    """Fit + clip.  Returns (capped frame, bounds)."""
    b = iqr_bounds(df, columns, factor, **kw)
    return apply_caps(df, b), b


def zscore_fit(df: DataFrame, columns: Sequence[str]) -> dict[str, dict]:
    cols = [c for c in columns if c in df.columns]
    if not cols:
        return {}
    aggs = []
    for c in cols:
        v = _finite(F.col(c).cast("double"))
        aggs += [F.avg(v).alias(f"{c}__m"), F.stddev_samp(v).alias(f"{c}__s")]
    r = df.agg(*aggs).first()
    return {c: {"mean": r[f"{c}__m"], "std": r[f"{c}__s"]} for c in cols}


def zscore_cap(df: DataFrame, columns: Sequence[str], factor: float = 3.0):
    """Values with ``|x - mean| / std_samp > f`` move to
    ``sign(x - mean) * f * std + mean``; std 0 or null leaves x."""
    fit = zscore_fit(df, columns)
    new = {}
    for c, p in fit.items():
        m, s = p["mean"], p["std"]
        if m is None or s is None or s == 0 or (isinstance(s, float) and math.isnan(s)):
            continue
        v = F.col(c).cast("double")
        over = F.abs((v - F.lit(m)) / F.lit(s)) > F.lit(factor)
        new[c] = F.when(over, F.signum(v - F.lit(m)) * F.lit(factor * s) + F.lit(m)).otherwise(v)
    return (df.withColumns(new) if new else df), fit


def zscore_counts(df: DataFrame, fit: dict[str, dict], factor: float = 3.0) -> DataFrame:
    """N4 (z form): rows with ``|z| > f`` per column."""
    from functools import reduce
    parts = []
    for c, p in fit.items():
        m, s = p["mean"], p["std"]
        v = F.col(c).cast("double")
        cond = (F.abs((v - F.lit(m)) / F.lit(s)) > F.lit(factor)) if s else F.lit(False)
        parts.append(df.agg(F.lit(c).alias("column"), F.count_if(cond).alias("n_over")))
    return reduce(DataFrame.unionByName, parts)


# --------------------------------------------------------------------------
# Standardisation and persisted state
# --------------------------------------------------------------------------

def scaler_fit(df: DataFrame, columns: Sequence[str]) -> dict[str, dict]:
    """N5 (fit): mean and **population** std per column, nulls skipped."""
    cols = [c for c in columns if c in df.columns]
    if not cols:
        return {}
    aggs = []
    for c in cols:
        v = _finite(F.col(c).cast("double"))
        aggs += [F.avg(v).alias(f"{c}__m"), F.stddev_pop(v).alias(f"{c}__s")]
    r = df.agg(*aggs).first()
    return {c: {"mean": r[f"{c}__m"], "std_pop": r[f"{c}__s"]} for c in cols}


def scaler_transform(df: DataFrame, fit: dict[str, dict]) -> DataFrame:
    """N5 / N9 (transform): ``(x - mean) / std``; zero std divides by 1."""
    new = {}
    for c, p in fit.items():
        if c not in df.columns or p.get("mean") is None:
            continue
        s = p.get("std_pop") or 0.0
        s = s if s and not math.isnan(s) else 1.0
        new[c] = (F.col(c).cast("double") - F.lit(p["mean"])) / F.lit(s)
    return df.withColumns(new) if new else df


def standardise(df: DataFrame, columns: Sequence[str] = S.BATCH_SCALE_COLUMNS):
    fit = scaler_fit(df, columns)
    return scaler_transform(df, fit), fit


def state_table(spark, scaler: dict[str, dict], caps: dict[str, dict], fitted_on: str,
                fitted: tuple = (None, None, None)) -> DataFrame:
    """One row per column with scaler and cap statistics, the layout's
    version and what it was fitted on: rows, first and last time."""
    rows = []
    for c in sorted(set(scaler) | set(caps)):
        s, k = scaler.get(c, {}), caps.get(c, {})
        rows.append((c, s.get("mean"), s.get("std_pop"), k.get("q1"), k.get("q3"),
                     k.get("lower"), k.get("upper"), fitted_on, S.STATS_VERSION, *fitted))
    return spark.createDataFrame(rows, S.STATS)


def fit_state(df: DataFrame, scale_columns: Sequence[str] = S.SERVE_SCALE_COLUMNS,
              cap_columns: Sequence[str] = ("tcp_len", "mqtt_msg", "iat"),
              fitted_on: str = "train", factor: float = S.IQR_FACTOR) -> DataFrame:
    """Fit scaler + caps and return them as the stats table."""
    scaler = scaler_fit(df, scale_columns)
    caps = iqr_bounds(df, cap_columns, factor)
    us = F.col("us").cast("long") if "us" in df.columns else F.lit(None).cast("long")
    fitted = df.agg(F.count(F.lit(1)), F.min(us), F.max(us)).first()
    return state_table(df.sparkSession, scaler, caps, fitted_on, tuple(fitted))


def save_state(state: DataFrame, path: str) -> None:
    state.coalesce(1).write.mode("overwrite").parquet(path)


def load_state(spark, path: str | None = None, refit_from: DataFrame | None = None):
    """Saved stats table, else refit from ``refit_from``, else identity.  A
    table of another layout version counts as not saved.

    Returns ``(scaler, caps)`` dictionaries (empty = identity)."""
    state = None
    if path:
        try:
            saved = spark.read.schema(S.STATS).parquet(path)
            state = saved if saved.where(~F.col("version").eqNullSafe(S.STATS_VERSION)).isEmpty() else None
        except AnalysisException as e:  # nothing was saved there; any other failure to read is an error
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    if state is None and refit_from is not None:
        state = fit_state(refit_from)
    if state is None:
        return {}, {}
    rows = state.collect()  # one row per feature column: bounded by the schema
    scaler = {r["column"]: {"mean": r["mean"], "std_pop": r["std_pop"]}
              for r in rows if r["mean"] is not None}
    caps = {r["column"]: {"q1": r["q1"], "q3": r["q3"], "lower": r["lower"], "upper": r["upper"]}
            for r in rows if r["lower"] is not None}
    return scaler, caps


# Raw-column caps apply to the derived feature columns.
SERVE_CAP_TARGETS = {"tcp_len": "frame_length", "mqtt_msg": "mqtt_payload_len", "iat": "iat"}
