"""Approximate nearest neighbours by learned partitions.

A nearest-neighbour graph of a bounded sample is cut into balanced parts so that few neighbours are separated; a small
classifier learns which part a vector belongs to.  Every vector is indexed under its most probable part.  A query looks
into its most probable parts and ranks what it finds there by exact cosine.  The vectors of a part that share a
neighbourhood are then compared with few queries, and a query with few vectors.

Parts are never held whole: a part's vectors are cut into blocks, its queries too, and each pair of blocks is one group of
bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, cut, table

#: The index is fitted on at most so many vectors, drawn by the hash of their ids; every vector is indexed.
FIT_ROWS = 6_000
#: Parts, and how many of them a query looks into.
PARTS, PROBES = 48, 32
#: Neighbours of a vector in the graph, passes of the balanced cut, and a part's room over the mean size.
GRAPH, PASSES, ROOM = 10, 12, 1.1
#: Steps and hidden units of the classifier.
STEPS, HIDDEN = 400, 64
#: Vectors and queries in a block.
BLOCK, QUERIES = 4_096, 512
#: Fixed values of the registered query.
NEAREST, QUERY_EVERY = 5, 50


def balanced_parts(x: np.ndarray, parts: int = PARTS, k: int = GRAPH, passes: int = PASSES, seed: int = 5) -> np.ndarray:
    """Part of each unit vector: a balanced cut of the k-nearest-neighbour graph.

    Parts grow from spread-out seeds by nearest centre within a size limit, and then every vector moves, while there is
    room, to the part that holds most of its neighbours.
    """
    n, rng = len(x), np.random.default_rng(seed)
    parts = min(parts, n)
    graph = np.empty((n, min(k, n - 1)), np.int64)
    for at in range(0, n, 1024):
        near = x[at:at + 1024] @ x.T
        near[np.arange(len(near)), np.arange(at, at + len(near))] = -2
        graph[at:at + 1024] = np.argpartition(-near, graph.shape[1] - 1, 1)[:, :graph.shape[1]] if graph.shape[1] else graph[at:at + 1024]
    centres = x[rng.choice(n, parts, replace=False)]
    limit = int(np.ceil(n / parts * ROOM))
    for _ in range(8):
        part = _fill(x @ centres.T, limit)
        centres = np.stack([x[part == p].mean(0) if (part == p).any() else x[rng.integers(n)] for p in range(parts)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    both = np.concatenate([np.stack([np.repeat(np.arange(n), graph.shape[1]), graph.ravel()]), np.stack([graph.ravel(), np.repeat(np.arange(n), graph.shape[1])])], 1)
    size = np.bincount(part, minlength=parts)
    for _ in range(passes):
        votes = np.zeros((n, parts), np.int32)
        np.add.at(votes, (both[0], part[both[1]]), 1)
        gain = votes.max(1) - votes[np.arange(n), part]
        moved = 0
        for i in np.argsort(-gain, kind="stable").tolist():
            if gain[i] <= 0:
                break
            to = int(votes[i].argmax())
            if size[to] < limit:
                size[part[i]] -= 1
                size[to] += 1
                part[i] = to
                moved += 1
        if not moved:
            break
    return part


def _fill(near: np.ndarray, limit: int) -> np.ndarray:
    """Parts by nearest centre, the surest first, none over the limit."""
    part, size = np.full(len(near), -1), np.zeros(near.shape[1], np.int64)
    order = np.argsort(-near, 1)
    for i in np.argsort(-(np.sort(near, 1)[:, -1]), kind="stable").tolist():
        for p in order[i].tolist():
            if size[p] < limit:
                part[i], size[p] = p, size[p] + 1
                break
    return part


class Router:
    """Probabilities of the parts for unit vectors: one hidden layer, trained by Adam on the sample's parts."""

    def __init__(self, x: np.ndarray, part: np.ndarray, hidden: int = HIDDEN, steps: int = STEPS, seed: int = 3):
        rng, parts = np.random.default_rng(seed), int(part.max()) + 1
        shapes = [(x.shape[1], hidden), (hidden,), (hidden, parts), (parts,)]
        self.w = [rng.normal(0, (2 / max(1, s[0])) ** 0.5, s) if len(s) > 1 else np.zeros(s) for s in shapes]
        m, v = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
        for step in range(1, steps + 1):
            at = rng.integers(0, len(x), min(512, len(x)))
            a, h, p = x[at], *self._forward(x[at])
            p[np.arange(len(at)), part[at]] -= 1
            p /= len(at)
            back = (p @ self.w[2].T) * (h > 0)
            for i, g in enumerate((a.T @ back, back.sum(0), h.T @ p, p.sum(0))):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                self.w[i] -= 0.01 * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.999 ** step)) + 1e-8)

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.maximum(x @ self.w[0] + self.w[1], 0)
        z = h @ self.w[2] + self.w[3]
        e = np.exp(z - z.max(1, keepdims=True))
        return h, e / e.sum(1, keepdims=True)

    def best(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n most probable parts, most probable first."""
        p = self._forward(x)[1]
        return np.argsort(-p, 1, kind="stable")[:, :min(n, p.shape[1])]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector of doubles) of rows with an id and a finite, non-zero vector."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector")).where("vec_id is not null and vector is not null")
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(fine & F.exists("vector", lambda x: x != 0))


def _routed(router: Router, every: int, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([np.array(v, np.float64) for v in batch.column("vector").to_pylist()])
            best = router.best(_unit(x), probes)
            ids = batch.column("vec_id").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vector"), pa.array(best[:, 0], pa.int32()),
                                              pa.array([b.tolist() if i % every == 0 else None for i, b in zip(ids, best)], pa.list_(pa.int32()))],
                                             names=["vec_id", "vector", "part", "probes"])
    return run


def _scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Cosines of pairs of rows, each computed alone: equal vectors give equal scores wherever they lie."""
    dot = np.einsum("ij,ij->i", queries, vectors)
    return dot / (np.sqrt(np.einsum("ij,ij->i", queries, queries)) * np.sqrt(np.einsum("ij,ij->i", vectors, vectors)))


def _search(nearest: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        asked, held = rows[rows["query"]], rows[~rows["query"]]
        out = []
        if len(asked) and len(held):
            q, x = np.stack(asked["vector"].to_list()).astype(np.float64), np.stack(held["vector"].to_list()).astype(np.float64)
            ids = held["vec_id"].to_numpy()
            rough = _unit(q) @ _unit(x).T
            rough[asked["vec_id"].to_numpy()[:, None] == ids[None, :]] = -9
            last = np.partition(rough, max(0, len(ids) - nearest), 1)[:, max(0, len(ids) - nearest)]
            a, b = np.nonzero((rough >= last[:, None] - 1e-9) & (rough > -8))  # all that may be among the nearest, ties included
            score = _scores(q[a], x[b])
            order = np.lexsort((ids[b], -score, a))
            a, b, score = a[order], b[order], score[order]
            rank = np.arange(len(a)) - np.searchsorted(a, a)
            first = rank < nearest
            out = [asked["vec_id"].to_numpy()[a[first]], ids[b[first]], score[first]]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), out or ([], [], [])))).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
    return run


def search(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", nearest: int = NEAREST, query_every: int = QUERY_EVERY, parts: int = PARTS,
           probes: int = PROBES, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's nearest found, best first, ties to the smaller id.

    Queries are the rows whose id is divisible by ``query_every``; candidates are all rows with another id.  Rows without an id, or with a
    vector that is null, zero or holds null or non-finite components, take no part; of rows with equal ids and vectors
    one does; all vectors have one length.  Fewer candidates give fewer rows; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    schema = "query_id long, rank int, vec_id long, score double"
    rows = usable(vectors, id_col, vector_col).dropDuplicates(["vec_id", "vector"])
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(fit_rows).collect()  # bounded by the parameter
    if len(sample) < 2:
        return spark.createDataFrame([], schema)
    x = _unit(np.array([r["vector"] for r in sample], np.float64))
    router = Router(x, balanced_parts(x, parts))
    routed = cut(rows.mapInArrow(_routed(router, query_every, probes), "vec_id long, vector array<double>, part int, probes array<int>"), "ann-index")
    asked = routed.where("probes is not null").select("vec_id", "vector", F.explode("probes").alias("part"))
    blocks = {r["part"]: r["n"] for r in routed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per part
    askers = {r["part"]: r["n"] for r in asked.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    cells = [(p, -(-n // BLOCK), -(-askers[p] // QUERIES)) for p, n in blocks.items() if askers.get(p)]
    grid = F.broadcast(spark.createDataFrame(cells, "part int, blocks int, askers int"))
    own = lambda n: F.pmod(F.xxhash64("vec_id"), n).cast("int")
    held = routed.join(grid, "part").select("part", own(F.col("blocks")).alias("block"), F.explode(F.sequence(F.lit(0), F.col("askers") - 1)).alias("asker"), F.lit(False).alias("query"), "vec_id", "vector")
    asking = asked.join(grid, "part").select("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), own(F.col("askers")).alias("asker"), F.lit(True).alias("query"), "vec_id", "vector")
    found = held.unionByName(asking).groupBy("part", "block", "asker").applyInPandas(_search(nearest), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def op4_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
