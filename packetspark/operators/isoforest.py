"""Isolation forest (A1-A9), built from the published algorithm
(Liu, Ting, Zhou, "Isolation Forest", ICDM 2008) as Spark jobs.

* Subsampling (A2): one cheap hash per row keeps a uniform *pool* of about
  ``2 * T * psi`` rows (a bound independent of the data size); every tree then
  draws its own ``psi`` rows without replacement from the pool by per-tree
  hash order.
* Fit (A2): ``groupBy('tree_id').applyInPandas`` grows one tree per group; a
  group holds at most ``psi`` rows, so trees are the unit of parallelism.
  Splits are hash draws of (seed, tree, node).
* Score (A3): the tree table (``T * (2 psi - 1)`` nodes at most) is broadcast
  and an iterator pandas UDF walks all trees over Arrow batches.
* Offset, decision, threshold sweep (A4, A5, A7) are aggregates over scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetspark import schema as S
from packetspark.functions import draws as D
from packetspark.operators import metrics as M
from packetspark.operators.stats import exact_quantiles

TREE_SCHEMA = T.StructType([
    T.StructField("tree_id", T.IntegerType()),
    T.StructField("node_id", T.IntegerType()),
    T.StructField("feature", T.IntegerType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("left", T.IntegerType()),
    T.StructField("right", T.IntegerType()),
    T.StructField("n", T.IntegerType()),
    T.StructField("depth", T.IntegerType()),
])

EULER = 0.5772156649015329
#: Rows that walk all trees together.
ROWS = 2048


def c_factor(n) -> np.ndarray:
    """Average path length of an unsuccessful BST search over n points."""
    n = np.asarray(n, dtype="float64")
    out = np.zeros_like(n)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER) - 2.0 * (n[big] - 1.0) / n[big]
    out[n == 2] = 1.0
    return out


# ---------------------------------------------------------------- A1

def contamination(df: DataFrame, y: str = "y", flip: bool = True) -> dict:
    """A1: anomaly share (y == -1); above 0.5 the labels are flipped and the
    normal share is used.  Without ``flip`` (standalone use) the share is
    capped at 0.5 instead."""
    r = df.agg(F.avg((F.col(y) == -1).cast("double")).alias("a"), F.count(F.lit(1)).alias("n")).first()
    a = float(r["a"] or 0.0)
    flipped = flip and a > 0.5
    return {"anomaly_rate": a, "flipped": flipped, "contamination": (1.0 - a) if flipped else min(a, 0.5), "n": r["n"]}


# ---------------------------------------------------------------- A2

def _grow(X: np.ndarray, seed: int, tree_id: int, max_depth: int) -> list[tuple]:
    """Nodes ``(node, feature, threshold, left, right, n, depth)`` of one tree.

    The root is node 1, the children of ``k`` are ``2 k`` and ``2 k + 1``.  A
    node's feature and threshold are hash draws of (seed, tree, node), so a tree
    depends on its rows alone, not on their order, and SQL grows the same one."""
    nodes, open_nodes = [], [(1, np.arange(len(X)), 0)]
    while open_nodes:
        node, idx, depth = open_nodes.pop()
        sub = X[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if depth >= max_depth or not len(usable):
            nodes.append((node, -1, 0.0, -1, -1, len(idx), depth))
            continue
        f = int(usable[int(D.py_uniform([seed, tree_id, node, "feature"]) * len(usable))])
        thr = float(lo[f] + D.py_uniform([seed, tree_id, node, "threshold"]) * (hi[f] - lo[f]))
        if not thr > lo[f]:     # rounded down to the least value: both sides keep a row
            thr = float(hi[f])
        below = sub[:, f] < thr
        nodes.append((node, f, thr, 2 * node, 2 * node + 1, len(idx), depth))
        open_nodes += [(2 * node, idx[below], depth + 1), (2 * node + 1, idx[~below], depth + 1)]
    return nodes


def _tree_builder(features: Sequence[str], seed: int, max_depth: int):
    feats = list(features)

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        tree_id = int(pdf["tree_id"].iloc[0])
        nodes = _grow(pdf[feats].to_numpy(dtype="float64"), seed, tree_id, max_depth)
        out = pd.DataFrame(nodes, columns=["node_id", "feature", "threshold", "left", "right", "n", "depth"])
        out.insert(0, "tree_id", tree_id)
        return out
    return fn


def subsample(df: DataFrame, n_trees: int, psi: int, seed: int = 42, key: str = "event_id",
              n: int | None = None) -> DataFrame:
    """A2 sampling: ``(tree_id, row)`` pairs, ``psi`` distinct rows per tree."""
    n = n if n is not None else df.count()
    pool_p = min(1.0, 2.0 * n_trees * psi / max(n, 1))
    pool = df.where(D.uniform([seed, F.col(key), "pool"]) < F.lit(pool_p)) if pool_p < 1.0 else df
    m = max(1, int(round(n * pool_p)))
    tree_p = min(1.0, 3.0 * psi / m)
    x = pool.withColumn("tree_id", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))))
    u = D.uniform([seed, F.col("tree_id"), F.col(key), "tree"])
    x = x.withColumn("_u", u)
    if tree_p < 1.0:
        x = x.where(F.col("_u") < F.lit(tree_p))
    w = Window.partitionBy("tree_id").orderBy("_u", key)   # groups of ~3 psi rows
    return x.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= psi).drop("_u", "_rk")


@dataclass
class IsolationForestModel:
    trees: DataFrame            # tree table (TREE_SCHEMA)
    features: list
    psi: int
    n_trees: int
    offset: float | None = None
    threshold: float | None = None
    flipped: bool = False
    contamination: float | None = None

    def params_frame(self, spark) -> DataFrame:
        """One-row parameter table stored with the trees."""
        return spark.createDataFrame(
            [(self.psi, self.n_trees, self.offset, self.threshold, self.flipped, self.contamination,
              ",".join(self.features))],
            "psi int, n_trees int, offset double, threshold double, flipped boolean, "
            "contamination double, features string")

    def save(self, path: str) -> None:
        self.trees.write.mode("overwrite").parquet(f"{path}/trees")
        self.params_frame(self.trees.sparkSession).write.mode("overwrite").parquet(f"{path}/params")

    @staticmethod
    def load(spark, path: str) -> "IsolationForestModel":
        p = spark.read.parquet(f"{path}/params").first()
        return IsolationForestModel(spark.read.parquet(f"{path}/trees"), p["features"].split(","),
                                    p["psi"], p["n_trees"], p["offset"], p["threshold"], p["flipped"],
                                    p["contamination"])


def resolve_psi(max_samples, n: int) -> int:
    return min(256, n) if max_samples in (None, "auto") else min(int(max_samples), n)


def fit(df: DataFrame, features: Sequence[str] = S.FEATURES, n_trees: int = 100,
        max_samples="auto", seed: int = 42, key: str = "event_id", n: int | None = None) -> IsolationForestModel:
    """A2: T trees on psi-row subsamples, depth limit ceil(log2 psi)."""
    feats = [c for c in features if c in df.columns]
    n = n if n is not None else df.count()
    psi = resolve_psi(max_samples, n)
    rows = df.select(key, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in feats])
    sample = subsample(rows, n_trees, psi, seed, key, n)
    depth = max(1, int(math.ceil(math.log2(max(psi, 2)))))
    trees = sample.groupBy("tree_id").applyInPandas(_tree_builder(feats, seed, depth), TREE_SCHEMA)
    from packetspark.session import cut_lineage
    trees = cut_lineage(trees)      # small table; fixed once grown
    return IsolationForestModel(trees, feats, psi, n_trees)


# ---------------------------------------------------------------- A3-A5

def _tree_arrays(trees: DataFrame, max_trees: int | None = None):
    t = trees if max_trees is None else trees.where(F.col("tree_id") < max_trees)
    pdf = t.toPandas().sort_values(["tree_id", "node_id"])  # <= T * (2 psi - 1) rows
    out = []
    for _, g in pdf.groupby("tree_id"):
        # children as places among the tree's nodes in order of their numbers
        left, right = (np.searchsorted(g["node_id"].to_numpy(), g[c].to_numpy()) for c in ("left", "right"))
        feat, depth, at = g["feature"].to_numpy(), g["depth"].to_numpy(), np.arange(len(g))
        leaf = feat < 0
        # a leaf leads to itself: every row makes the same number of steps
        child = np.stack([np.where(leaf, at, left), np.where(leaf, at, right)], axis=1).reshape(-1)
        # node i is at place 2 i + 1 of feature and threshold; its children's places are at 2 i (left) and 2 i + 1 (right)
        out.append((np.repeat(np.where(leaf, 0, feat).astype(np.int64), 2), np.repeat(g["threshold"].to_numpy(), 2), 2 * child.astype(np.int64) + 1,
                    np.repeat(depth + c_factor(g["n"].to_numpy()), 2), int(depth.max() - depth.min())))
    return out


def _path_lengths(X: np.ndarray, tree) -> np.ndarray:
    feat, thr, child, length, steps = tree
    flat, base = X.reshape(-1), np.arange(len(X)) * X.shape[1]
    place = np.ones(len(X), dtype="int64")
    for _ in range(steps):
        cell = feat.take(place)
        cell += base
        place -= flat.take(cell) < thr.take(place)
        place = child.take(place)
    return length.take(place)


def score(model: IsolationForestModel, df: DataFrame, out: str = "score",
          tree_counts: Sequence[int] | None = None) -> DataFrame:
    """A3: ``-2^(-E[h(x)] / c(psi))`` in [-1, 0]; lower = more anomalous.

    ``tree_counts`` scores nested prefixes of the forest at once (A6):
    columns ``{out}_{k}`` for the first k trees."""
    spark = df.sparkSession
    arrays = _tree_arrays(model.trees)
    bc = spark.sparkContext.broadcast(arrays)
    feats = list(model.features)
    cpsi = float(c_factor([model.psi])[0]) or 1.0
    counts = list(tree_counts) if tree_counts else [len(arrays)]

    schema = T.StructType([T.StructField(f"s{k}", T.DoubleType()) for k in counts])

    @F.pandas_udf(schema)
    def _score(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees = bc.value
        for batch in it:
            whole = np.ascontiguousarray(batch.to_numpy(dtype="float64"))
            res = {f"s{k}": np.empty(len(whole)) for k in counts}
            for at in range(0, len(whole), ROWS):  # so many rows stay in the processor's cache for all trees
                X = whole[at:at + ROWS]
                acc = np.zeros(len(X))
                for i, tr in enumerate(trees):
                    acc += _path_lengths(X, tr)
                    k = i + 1
                    if k in counts:
                        res[f"s{k}"][at:at + ROWS] = -np.power(2.0, -(acc / k) / cpsi)
            yield pd.DataFrame(res)

    args = F.struct(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in feats])
    x = df.withColumn("_iscore", _score(args))
    if tree_counts:
        return x.select("*", *[F.col(f"_iscore.s{k}").alias(f"{out}_{k}") for k in counts]).drop("_iscore")
    return x.withColumn(out, F.col(f"_iscore.s{counts[0]}")).drop("_iscore")


def fit_offset(scores: DataFrame, contamination_rate: float, col: str = "score") -> float:
    """A4: offset = percentile of training scores at ``100 * contamination``."""
    return exact_quantiles(scores, [col], [contamination_rate])[col][0]


def predict(df: DataFrame, offset: float, col: str = "score", threshold: float | None = None,
            flipped: bool = False, out: str = "prediction") -> DataFrame:
    """Default rule ``score < offset -> -1``; with a tuned
    threshold ``score <= threshold -> -1``; flipped labels swap back."""
    if threshold is not None:
        p = F.when(F.col(col) <= F.lit(threshold), F.lit(-1)).otherwise(F.lit(1))
    else:
        p = F.when(F.col(col) < F.lit(offset), F.lit(-1)).otherwise(F.lit(1))
    if flipped:
        p = -p
    return df.withColumn("decision", F.col(col) - F.lit(offset)).withColumn(out, p.cast("int"))


# ---------------------------------------------------------------- A6, A7

# FIXED VALUES: threshold percentiles (1..9.5 step .5, 10..24 step 1, 25..49 step 2).
SWEEP_PERCENTILES = ([1 + 0.5 * i for i in range(18)] + [10.0 + i for i in range(15)]
                     + [25.0 + 2 * i for i in range(13)])
PSI_OPTIONS = ("auto", 256, 512, 1024, 2048)
TREE_OPTIONS = (100, 200, 300)


def threshold_sweep(scores: DataFrame, y: str = "y", col: str = "score", flipped: bool = False,
                    min_precision: float | None = 0.1,
                    percentiles: Sequence[float] = SWEEP_PERCENTILES) -> DataFrame:
    """Macro metrics for each percentile threshold in one pass.

    Each row is put in the bucket of the first threshold it does not exceed
    (a CASE over the sorted thresholds), bucket x label counts are summed
    cumulatively, and every threshold's confusion follows from them."""
    qs = exact_quantiles(scores, [col], [p / 100.0 for p in percentiles])[col]
    order = sorted(range(len(qs)), key=lambda i: qs[i])
    sorted_thr = [qs[i] for i in order]
    b = F.lit(len(sorted_thr))
    for j in reversed(range(len(sorted_thr))):
        b = F.when(F.col(col) <= F.lit(sorted_thr[j]), F.lit(j)).otherwise(b)
    counts = (scores.withColumn("_b", b).groupBy("_b")
                    .agg(F.count_if(F.col(y) == -1).alias("an"), F.count_if(F.col(y) == 1).alias("no"))
                    .collect())   # <= 47 rows
    per_b = {r["_b"]: (r["an"], r["no"]) for r in counts}
    tot_an = sum(v[0] for v in per_b.values())
    tot_no = sum(v[1] for v in per_b.values())
    rows = []
    cum_an = cum_no = 0
    cum_at = {}
    for j in range(len(sorted_thr)):
        a, nn = per_b.get(j, (0, 0))
        cum_an += a
        cum_no += nn
        cum_at[j] = (cum_an, cum_no)
    for pos, i in enumerate(range(len(qs))):
        j = order.index(i)
        # rows with score <= threshold_i are those in buckets <= last j with equal threshold
        jj = max(k for k in range(len(sorted_thr)) if sorted_thr[k] == qs[i])
        le_an, le_no = cum_at[jj]
        gt_an, gt_no = tot_an - le_an, tot_no - le_no
        if flipped:   # predictions swap: score <= thr -> normal
            pred_an = (gt_an, gt_no)
        else:
            pred_an = (le_an, le_no)
        tp_a, fp_a = pred_an                      # predicted anomaly: true anomaly / true normal
        fn_a = tot_an - tp_a
        tn_a = tot_no - fp_a
        def prf(tp, fp, fn):
            p = tp / (tp + fp) if tp + fp else 0.0
            r = tp / (tp + fn) if tp + fn else 0.0
            f = 2 * p * r / (p + r) if p + r else 0.0
            return p, r, f
        pa, ra, fa = prf(tp_a, fp_a, fn_a)
        pn, rn, fn_ = prf(tn_a, fn_a, fp_a)
        rows.append((pos, float(percentiles[i]), float(qs[i]), (pa + pn) / 2, (ra + rn) / 2, (fa + fn_) / 2))
    spark = scores.sparkSession
    sw = spark.createDataFrame(rows, "pos int, percentile double, threshold double, "
                                     "precision_macro double, recall_macro double, f1_macro double")
    ok = F.lit(True) if min_precision is None else (F.col("precision_macro") >= F.lit(min_precision))
    best = Window.orderBy(F.desc("f1_macro"), F.asc("pos"))
    sw = sw.withColumn("eligible", ok)
    ranked = sw.where("eligible").withColumn("_r", F.row_number().over(best)).select("pos", "_r")
    return (sw.join(ranked, "pos", "left")
              .withColumn("selected", F.coalesce(F.col("_r") == 1, F.lit(False))).drop("_r"))


def search(train: DataFrame, val: DataFrame, y: str = "y", features: Sequence[str] = S.FEATURES,
           psi_options=PSI_OPTIONS, tree_options=TREE_OPTIONS, seed: int = 42,
           contamination_rate: float = 0.1, key: str = "event_id", flipped: bool = False) -> DataFrame:
    """One forest of max(trees) per psi; prefixes give the smaller tree
    counts.  Validation macro F1 per (psi, trees); first best wins.  With
    ``flipped`` labels the predictions are swapped back before the metrics, as
    ``predict`` does (A8)."""
    anomaly = 1 if flipped else -1
    n = train.count()
    seen, rows = set(), []
    for opt in psi_options:
        psi = resolve_psi(opt, n)
        if (opt != "auto" and int(opt) > n) or psi in seen:
            continue
        seen.add(psi)
        model = fit(train, features, max(tree_options), psi, seed, key, n)
        cols = [f"score_{t}" for t in tree_options]
        # Scores feed several passes (offsets, metrics): compute them once.
        tr = score(model, train.select(key, *model.features), tree_counts=tree_options) \
            .select(*cols).persist(StorageLevel.MEMORY_AND_DISK)
        va = score(model, val.select(key, y, *model.features), tree_counts=tree_options) \
            .select(y, *cols).persist(StorageLevel.MEMORY_AND_DISK)
        offsets = exact_quantiles(tr, cols, [contamination_rate])
        preds = va.select(y, *[F.when(F.col(f"score_{t}") < F.lit(offsets[f"score_{t}"][0]), anomaly).otherwise(-anomaly)
                               .alias(f"p_{t}") for t in tree_options])
        # One confusion table for every tree count (grouped), not one job each.
        long = preds.select(y, F.explode(F.array(*[F.struct(F.lit(t).alias("n_trees"), F.col(f"p_{t}").alias("prediction"))
                                                   for t in tree_options])).alias("_p")) \
                    .select(y, "_p.n_trees", "_p.prediction")
        conf = M.confusion(long, y, "prediction", group=["n_trees"])
        m = (M.summary_metrics(conf, ["n_trees"]).withColumn("max_samples", F.lit(str(opt)))
             .withColumn("psi", F.lit(psi)))
        m = m.select("max_samples", "psi", "n_trees", "accuracy", "n", "precision_macro", "recall_macro",
                     "f1_macro").toPandas()   # <= len(tree_options) rows
        rows.extend(m.itertuples(index=False, name=None))
        tr.unpersist()
        va.unpersist()
    spark = train.sparkSession
    res = spark.createDataFrame(rows, "max_samples string, psi int, n_trees int, accuracy double, n long, "
                                      "precision_macro double, recall_macro double, f1_macro double")
    w = Window.orderBy(F.desc("f1_macro"), F.asc("psi"), F.asc("n_trees"))
    return res.withColumn("rank", F.row_number().over(w))
