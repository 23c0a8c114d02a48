"""Metadata source and result sinks.

Results are DataFrames (one row per scenario / fold / class), written with
Spark writers; NaN becomes null so the JSON stays valid.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_metadata(spark: SparkSession, metadata_dir: str | None, required: bool = False) -> dict[str, DataFrame]:
    """Optional label and categorical encoding documents as small lookup
    tables (``name -> DataFrame``), from any file system that Spark reads.  A
    missing file is left out, or an error with ``required``."""
    out = {}
    if not metadata_dir:
        return out
    for name in ("label_encoding", "categorical_encoding"):
        try:
            out[name] = spark.read.option("multiLine", True).json(f"{metadata_dir.rstrip('/')}/{name}.json")
        except AnalysisException as e:
            if required or e.getCondition() != "PATH_NOT_FOUND":
                raise
    return out


def apply_encoding(df: DataFrame, column: str, encoding: DataFrame, out: str) -> tuple[DataFrame, DataFrame]:
    """S6 applied: a document ``{value: code, ...}`` as (value, code) rows joined
    to ``column``.  Returns the encoded rows and those whose value is unknown."""
    codes = encoding.select(F.explode(F.map_from_arrays(
        F.array(*[F.lit(c) for c in encoding.columns]), F.array(*[F.col(f"`{c}`").cast("long") for c in encoding.columns]))).alias("_value", out))
    known = df.join(F.broadcast(codes), df[column].cast("string") == F.col("_value"), "left")  # one row per value of the document
    return known.where(F.col(out).isNotNull()).drop("_value"), known.where(F.col(out).isNull()).drop("_value", out)


def nan_to_null(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.when(F.isnan(f.name), F.lit(None)).otherwise(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def write_results(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Result tables as JSON lines."""
    w = nan_to_null(df).write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.json(path)


def training_summary(spark: SparkSession, params: dict, cv: DataFrame | None, test_summary: DataFrame,
                     extra: dict | None = None) -> DataFrame:
    """One row with the chosen parameters, CV mean / 2*std per metric and
    the test metrics (all small aggregates already computed by Spark)."""
    p = spark.createDataFrame([tuple(str(v) for v in params.values())],
                              ", ".join(f"{k} string" for k in params) or "none string")
    row = p.withColumn("_k", F.lit(1))
    if cv is not None:
        row = row.join(cv.withColumn("_k", F.lit(1)), "_k")
    ts = test_summary.select(*[F.col(c).alias(f"test_{c}") for c in test_summary.columns]).withColumn("_k", F.lit(1))
    row = row.join(ts, "_k").drop("_k")
    for k, v in (extra or {}).items():
        row = row.withColumn(k, F.lit(v))
    return row


def write_importance(imp: DataFrame, path: str) -> None:
    """``feature, importance`` CSV, descending."""
    (imp.orderBy(F.desc("importance"), F.asc("feature")).coalesce(1)
        .write.mode("overwrite").option("header", True).csv(path))
