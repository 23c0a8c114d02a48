"""Whitening of embeddings with MLlib block matrices.

Components become whole numbers x, whose sums per dimension are exact.  The rows, centred by n * x - S over n, get a
dense index and become the blocks of a ``BlockMatrix``; its transpose times itself is the scatter, whose eigenvectors are
found on the driver (a matrix of dimension by dimension); the rows' blocks times the whitening matrix are the projections.
The product that gives the scatter is split along the rows, so that no task sees them all.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, numbered, table

#: Components returned, rows of a block.
COMPONENTS, BLOCK = 8, 1024
#: What a component is multiplied by and what is added to it.
SCALE, OFFSET = 1024, 100_000
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _times(a: BlockMatrix, b: BlockMatrix, splits: int, columns: int) -> BlockMatrix:
    """a * b, summed over ``splits`` parts of the inner dimension."""
    java = a._java_matrix_wrapper._java_model.multiply(b._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(java, a.rowsPerBlock, columns)


def _squares(x: Column, totals: list[int], n: int, wide: bool) -> Column:
    """Sum over the dimensions of (n * x - S) ^ 2, in decimals where it could pass 64 bits."""
    kind = "decimal(19,0)" if wide else "bigint"
    total = "decimal(38,0)" if wide else "bigint"
    off = F.zip_with(x, F.array(*[F.lit(s) for s in totals]), lambda v, s: (F.lit(n) * v - s).cast(kind))
    return F.aggregate(off, F.lit(0).cast(total), lambda acc, v: (acc + v * v).cast(total)).try_cast("bigint")


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null or empty or hold null or non-finite entries are left out, and so are those whose length is not
    the commonest (the longer of equally common ones).  Repeated ids and rows count and are returned each; a null id stays
    null.  A component without variance has a null projection and does not count for the error; a deviation beyond 64 bits
    is null.  An empty table gives an empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    c = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    fine = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    x = F.transform(c, lambda v: F.floor(v * SCALE) + OFFSET)
    rows = cut(vectors.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)).where(fine).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")), "whitening-vectors")
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return spark.createDataFrame([], SCHEMA)
    d, n = lengths["d"], lengths["count"]
    rows = rows.where(F.size("x") == d)
    per = rows.select(F.posexplode("x").alias("j", "v")).groupBy("j").agg(F.sum("v").alias("s"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("j").collect()  # one row per dimension
    totals = [r["s"] for r in per]
    farthest = max(max(abs(n * r["low"] - r["s"]), abs(n * r["high"] - r["s"])) for r in per)
    wide = d * farthest ** 2 >= 1 << 63
    centred = F.zip_with("x", F.array(*[F.lit(s) for s in totals]), lambda v, s: (F.lit(n) * v - s).cast("double") / F.lit(float(n)))
    indexed = cut(numbered(rows.select("vec_id", _squares(F.col("x"), totals, n, wide).alias("deviation"), centred.alias("y")), "whitening-rows"), "whitening-centred")

    feed = MLUtils.convertVectorColumnsFromML(indexed.select(F.col("at").alias("index"), array_to_vector("y").alias("vector")), "vector")
    blocks = IndexedRowMatrix(feed, n, d).toBlockMatrix(BLOCK, d)
    splits = max(1, min(-(-n // BLOCK), 4 * spark.sparkContext.defaultParallelism))
    scatter = _times(blocks.transpose(), blocks, splits, d).toLocalMatrix().toArray()  # dimension by dimension
    covariance = (scatter + scatter.T) / (2 * n)
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(components, d)
    there = values[:k] > max(values[0], 0.0) * d * np.finfo(float).eps
    matrix = axes[:, :k] * np.where(there, 1 / np.sqrt(np.where(there, values[:k], 1.0)), 0.0)
    w = BlockMatrix(spark.sparkContext.parallelize([((0, 0), DenseMatrix(d, k, matrix.flatten("F").tolist()))], 1), d, k, d, k)
    projected = blocks.multiply(w).toIndexedRowMatrix()
    # the rows of the matrix as a table, without a detour through Python objects
    found = callMLlibFunc("getIndexedRows", projected._java_matrix_wrapper._java_model)
    found = cut(found.select(F.col("index").alias("at"), vector_to_array("vector").alias("w")), "whitening-projected")
    pairs = [(i, j) for i in range(k) for j in range(i, k) if there[i] and there[j]]
    error = 0.0
    if pairs:
        cov = found.agg(*[F.covar_pop(F.get("w", F.lit(i)), F.get("w", F.lit(j))).alias(f"c{i}_{j}") for i, j in pairs]).first()
        error = max(abs(cov[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    trace = float(np.trace(covariance))
    explained = [float(v / trace) if trace > 0 else 0.0 for v in values[:k]]
    each = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("component"), (F.get("w", F.lit(i)) if there[i] else F.lit(None).cast("double")).alias("whitened"), F.lit(explained[i]).alias("explained"))
                               for i in range(k)])).alias("c")
    return (indexed.select("at", "vec_id", "deviation").join(found, "at").select("vec_id", "deviation", each)
            .select("vec_id", "c.component", F.lit(n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained", F.lit(float(error)).alias("identity_error")))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
