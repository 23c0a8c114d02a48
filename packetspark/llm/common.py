"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetspark.session import checkpoint_dir

#: ASCII white space: what separates words everywhere in this subpackage.
WHITE = " \t\n\x0b\f\r"
#: The same as a Java and DuckDB character class.
WHITE_CLASS = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(column, F.lit(""))


def ascii_lower(column: Column) -> Column:
    """Lower case for A-Z alone; other letters stay."""
    return F.translate(column, UPPER, LOWER)


def words_of(column: Column) -> Column:
    """Words of a text in order: maximal runs without ASCII white space."""
    return F.array_remove(F.split(text_of(column), f"{WHITE_CLASS}+"), "")


def bounded_batches(spark: SparkSession, limit: int = 16 << 20) -> None:
    """Bound the bytes of a batch of rows on its way to Python; rows of whole texts or sets would else fill an executor."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(limit))


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that all executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/packetspark-{name}-{uuid.uuid4().hex}"


def write_shared(df: DataFrame, name: str, **options) -> str:
    path = shared_path(df.sparkSession, name)
    df.write.options(compression="zstd", **options).parquet(path)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    The plan above starts from the files: a lost executor costs the tasks that read them, not the work that made
    them, and nothing is computed twice when the result is used more than once.
    """
    return df.sparkSession.read.schema(df.schema).parquet(write_shared(df, name))


def numbered(df: DataFrame, name: str, start: int = 0) -> DataFrame:
    """The rows, written, with ``at``: numbers from ``start`` without gaps, by a count per partition and the places inside."""
    named = cut(df.withColumn("_id", F.monotonically_increasing_id()), name)
    part = F.shiftright("_id", 33).cast("int")
    starts, before = [], start
    for p, n in sorted((r["_p"], r["count"]) for r in named.groupBy(part.alias("_p")).count().collect()):  # one row per partition
        starts.append((p, before))
        before += n
    of = df.sparkSession.createDataFrame(starts, "_part int, _start long")
    return named.withColumn("_part", part).join(F.broadcast(of), "_part").withColumn("at", F.col("_start") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_part", "_start", "_id")


def drop_shared(spark: SparkSession, path: str) -> None:
    """Remove a table that ``write_shared`` made, once what was derived from it is written."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def give_back() -> None:
    """Return memory that Arrow and the C library keep after arrays were freed, between groups of a Python worker."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` in a Python worker that first drops what tasks of other stages left in it (the tables of the encoders), and
    gives back what its own task took: workers and their memory outlive a stage."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import encoder

        encoder.cache_clear()
        give_back()
        yield from run(batches)
        give_back()
    return task


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Spark removes the shuffle files of each query that ends inside; for queries whose results are written tables."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def unit_draw(seed: int, *columns: Column) -> Column:
    """A uniform draw in (0, 1) that depends on the values alone: 52 bits of an md5, never 0 or 1."""
    key = F.concat_ws("\x1f", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    bits = F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 52)
