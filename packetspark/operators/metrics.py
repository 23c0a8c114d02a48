"""Evaluation metrics (E1-E14) and small summaries.

All label metrics come from one ``groupBy(group, label, prediction).count()``
with map-side partial aggregation; the confusion table has at most C^2 rows
per group, so everything after it is tiny.  Ranking metrics (AUC, AP) group
rows by distinct score first and run an ``ordered_scan`` over the distinct
scores, so there is no single-task global sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetspark import schema as S
from packetspark.functions.mapping import class_name
from packetspark.operators.timeline import ordered_scan


def _safe_div(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def _join_on(a: DataFrame, b: DataFrame, group: list[str]) -> DataFrame:
    """Join two per-group aggregates; without groups both have one row."""
    if group:
        return a.join(b, group)
    return a.withColumn("_k", F.lit(1)).join(b.withColumn("_k", F.lit(1)), "_k").drop("_k")


# ---------------------------------------------------------------- E1, E11

def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction",
              group: Sequence[str] = ()) -> DataFrame:
    """Long-form confusion ``(group..., label, prediction, n)`` over the
    full grid of the union of true and predicted labels (zeros included).

    The counting is one distributed aggregate with map-side partial
    aggregation.  Its result has at most ``groups x classes^2`` rows, so it is
    materialised as a small local table: every metric below reads it several
    times, and re-planning the aggregate each time costs more than the data."""
    group = list(group)
    counts = df.groupBy(*group, F.col(label).alias("label"),
                        F.col(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))
    rows = counts.collect()   # bounded: groups x classes^2
    by_group: dict = {}
    for r in rows:
        g = tuple(r[c] for c in group)
        by_group.setdefault(g, {})[(r["label"], r["prediction"])] = r["n"]
    out = []
    order = lambda v: (v is None, v)
    for g, cells in by_group.items():
        labs = sorted({a for a, _ in cells} | {b for _, b in cells}, key=order)
        for a in labs:
            for b in labs:
                out.append((*g, a, b, int(cells.get((a, b), 0))))
    schema = T.StructType([*[counts.schema[c] for c in group],
                           T.StructField("label", counts.schema["label"].dataType),
                           T.StructField("prediction", counts.schema["prediction"].dataType),
                           T.StructField("n", T.LongType(), False)])
    return df.sparkSession.createDataFrame(out, schema)


def confusion_wide(conf: DataFrame, labels: Sequence[int], group: Sequence[str] = ()) -> DataFrame:
    """E1 wide form: one row per true label, one column per predicted label."""
    return (conf.groupBy(*group, "label").pivot("prediction", list(labels))
                .agg(F.sum("n")).na.fill(0))


def confusion_normalised(conf: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Count / row sum (0 for an empty row)."""
    w = Window.partitionBy(*group, "label")
    return conf.withColumn("share", _safe_div(F.col("n").cast("double"), F.sum("n").over(w)))


# ---------------------------------------------------------------- E2-E6

def class_metrics(conf: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Per class precision, recall, F1 and support; zero denominators 0."""
    group = list(group)
    true = conf.groupBy(*group, F.col("label").alias("class_label")).agg(F.sum("n").alias("support"))
    pred = conf.groupBy(*group, F.col("prediction").alias("class_label")).agg(F.sum("n").alias("predicted"))
    tp = (conf.where(F.col("label") == F.col("prediction"))
              .select(*group, F.col("label").alias("class_label"), F.col("n").alias("tp")))
    m = true.join(pred, group + ["class_label"], "full").join(tp, group + ["class_label"], "left")
    m = m.na.fill(0, ["support", "predicted", "tp"])
    p = _safe_div(F.col("tp").cast("double"), F.col("predicted"))
    rc = _safe_div(F.col("tp").cast("double"), F.col("support"))
    m = m.withColumn("precision", p).withColumn("recall", rc)
    m = m.withColumn("f1_score", _safe_div(2 * F.col("precision") * F.col("recall"),
                                           F.col("precision") + F.col("recall")))
    return m.select(*group, "class_label", class_name(F.col("class_label")).alias("class_name"),
                    "precision", "recall", "f1_score", F.col("support").cast("bigint").alias("support"))


def summary_metrics(conf: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """E2 + E4: accuracy and macro P/R/F1 (mean over the union of labels)."""
    group = list(group)
    cm = class_metrics(conf, group)
    macro = cm.groupBy(*group).agg(F.avg("precision").alias("precision_macro"),
                                   F.avg("recall").alias("recall_macro"),
                                   F.avg("f1_score").alias("f1_macro"))
    acc = conf.groupBy(*group).agg(
        _safe_div(F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)).cast("double"),
                  F.sum("n")).alias("accuracy"),
        F.sum("n").alias("n"))
    return _join_on(acc, macro, group)


def binary_metrics(conf: DataFrame, positive: int = 1, group: Sequence[str] = ()) -> DataFrame:
    """E5: precision / recall / F1 of one positive label, zeros where it does not occur."""
    cm = class_metrics(conf, group)
    of = lambda c: F.coalesce(F.max(F.when(F.col("class_label") == positive, F.col(c))), F.lit(0.0))
    return cm.groupBy(*group).agg(of("precision").alias("precision_binary"), of("recall").alias("recall_binary"),
                                  of("f1_score").alias("f1_binary"))


def classification_report(conf: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Per-class rows, then accuracy, macro and support-weighted averages."""
    group = list(group)
    cm = class_metrics(conf, group)
    per = cm.select(*group, F.col("class_name").alias("row"), F.col("class_label").cast("int").alias("pos"),
                    "precision", "recall", "f1_score", "support")
    tot = cm.groupBy(*group).agg(
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1_score").alias("mf"),
        _safe_div(F.sum(F.col("precision") * F.col("support")), F.sum("support")).alias("wp"),
        _safe_div(F.sum(F.col("recall") * F.col("support")), F.sum("support")).alias("wr"),
        _safe_div(F.sum(F.col("f1_score") * F.col("support")), F.sum("support")).alias("wf"),
        F.sum("support").alias("support"))
    acc = conf.groupBy(*group).agg(_safe_div(
        F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)).cast("double"),
        F.sum("n")).alias("acc"))
    tot = _join_on(tot, acc, group)
    rows = [
        tot.select(*group, F.lit("accuracy").alias("row"), F.lit(1000).alias("pos"),
                   F.lit(None).cast("double").alias("precision"), F.lit(None).cast("double").alias("recall"),
                   F.col("acc").alias("f1_score"), "support"),
        tot.select(*group, F.lit("macro avg").alias("row"), F.lit(1001).alias("pos"),
                   F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                   F.col("mf").alias("f1_score"), "support"),
        tot.select(*group, F.lit("weighted avg").alias("row"), F.lit(1002).alias("pos"),
                   F.col("wp").alias("precision"), F.col("wr").alias("recall"),
                   F.col("wf").alias("f1_score"), "support"),
    ]
    out = per
    for x in rows:
        out = out.unionByName(x)
    return out


def binary_counts(conf: DataFrame, compat: bool = False, group: Sequence[str] = ()) -> DataFrame:
    """TP/TN/FP/FN with the anomaly (-1) as positive.

    ``compat=True`` gives the reference's names: sklearn's ravel over labels
    [-1, 1] makes 1 (normal) the positive (SURVEY Q9)."""
    def cell(y, p):
        return F.sum(F.when((F.col("label") == y) & (F.col("prediction") == p), F.col("n")).otherwise(0)).cast("bigint")
    if compat:
        return conf.groupBy(*group).agg(cell(-1, -1).alias("tn"), cell(-1, 1).alias("fp"),
                                        cell(1, -1).alias("fn"), cell(1, 1).alias("tp"))
    return conf.groupBy(*group).agg(cell(-1, -1).alias("tp"), cell(-1, 1).alias("fn"),
                                    cell(1, -1).alias("fp"), cell(1, 1).alias("tn"))


def metrics_chart(conf: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Per-class P/R/F1 in label order with display names."""
    cm = class_metrics(conf, group)
    known = F.col("class_label").isin(list(S.CLASS_NAMES))
    name = F.when(known, F.initcap(F.col("class_name"))).otherwise(
        F.concat(F.lit("Class_"), F.col("class_label").cast("string")))
    return cm.select(*group, "class_label", name.alias("display_name"), "precision", "recall", "f1_score")


# ---------------------------------------------------------------- E7-E10

def _score_groups(df: DataFrame, y: str, score: str, group: Sequence[str]) -> DataFrame:
    return (df.groupBy(*group, F.col(score).alias("_s"))
              .agg(F.count_if(F.col(y) == 1).alias("_pos"), F.count_if(F.col(y) != 1).alias("_neg")))


def roc_auc(df: DataFrame, y: str = "y01", score: str = "score",
            group: Sequence[str] = ()) -> DataFrame:
    """Exact binary ROC-AUC, ties count half; ``y`` is 1 for positive.
    Null when one class is absent."""
    group = list(group)
    g = _score_groups(df, y, score, group)
    g = ordered_scan(g, order=["_s"], group=group, sums={"neg": F.col("_neg")}, prefix="_r_")
    contrib = F.col("_pos") * (F.col("_r_neg_before") + 0.5 * F.col("_neg"))   # double
    agg = g.groupBy(*group).agg(F.sum(contrib).alias("_u"), F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n"))
    auc = F.when((F.col("_p") > 0) & (F.col("_n") > 0), F.col("_u") / F.col("_p").cast("double") / F.col("_n").cast("double"))
    return agg.select(*group, auc.alias("roc_auc"))


def average_precision(df: DataFrame, y: str = "y01", score: str = "score",
                      group: Sequence[str] = ()) -> DataFrame:
    """Step-wise AP = sum over thresholds (descending) of
    (R_i - R_{i-1}) * P_i; null when there is no positive."""
    group = list(group)
    g = _score_groups(df, y, score, group).withColumn("_neg_s", -F.col("_s"))
    g = ordered_scan(g, order=["_neg_s"], group=group,
                     sums={"pos": F.col("_pos"), "all": F.col("_pos") + F.col("_neg")}, prefix="_a_")
    tp = F.col("_a_pos_before") + F.col("_pos")
    allc = F.col("_a_all_before") + F.col("_pos") + F.col("_neg")
    agg = g.groupBy(*group).agg(F.sum(F.col("_pos") * tp / allc).alias("_num"), F.sum("_pos").alias("_p"))
    return agg.select(*group, F.when(F.col("_p") > 0, F.col("_num") / F.col("_p")).alias("average_precision"))


def roc_auc_ovr(df: DataFrame, label: str = "label", probability: str = "probability",
                group: Sequence[str] = ()) -> DataFrame:
    """One-vs-rest macro ROC-AUC over the classes that occur as labels, of an
    array column of class probabilities indexed by class; null when no class
    has both positives and negatives."""
    group = list(group)
    x = df.select(*group, label, F.posexplode(probability).alias("_cls", "_p"))
    x = x.withColumn("_y", (F.col(label) == F.col("_cls")).cast("int"))
    per = roc_auc(x, "_y", "_p", group + ["_cls"])
    return per.groupBy(*group).agg(F.avg("roc_auc").alias("roc_auc_ovr"))   # null where a class never occurs


def minmax_scale_scores(df: DataFrame, score: str = "score", out: str = "score_scaled") -> DataFrame:
    """``(-s - min) / (max - min + 1e-10)`` of the negated score."""
    neg = -F.col(score)
    mm = df.agg(F.min(neg).alias("mn"), F.max(neg).alias("mx")).first()
    if mm["mn"] is None:
        return df.withColumn(out, F.lit(None).cast("double"))
    return df.withColumn(out, (neg - F.lit(mm["mn"])) / F.lit(mm["mx"] - mm["mn"] + 1e-10))


# ---------------------------------------------------------------- R4, R5, R8-R10

def class_distribution(df: DataFrame, label: str = "target") -> DataFrame:
    """Rows and percent of total per label."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))


def label_set(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Sorted union of true and predicted labels."""
    return (df.select(F.col(label).alias("class_label"))
              .union(df.select(F.col(prediction).alias("class_label")))
              .distinct().orderBy("class_label"))


def importance_cumulative(imp: DataFrame) -> DataFrame:
    """Running importance (descending) and its percent of the total."""
    w = Window.orderBy(F.desc("importance"), F.asc("feature"))
    total = F.sum("importance").over(Window.partitionBy())
    x = imp.withColumn("cumulative", F.sum("importance").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.withColumn("cumulative_pct", F.col("cumulative") * 100.0 / total)


def importance_summary(imp: DataFrame, top: int = 5) -> DataFrame:
    """Count, total, max, mean, median and the share of the top ``top``."""
    w = Window.orderBy(F.desc("importance"), F.asc("feature"))
    x = imp.withColumn("_rk", F.row_number().over(w))
    return x.agg(F.count(F.lit(1)).alias("n_features"), F.sum("importance").alias("total"),
                 F.max("importance").alias("max_importance"), F.avg("importance").alias("mean_importance"),
                 F.percentile("importance", 0.5).alias("median_importance"),
                 (F.sum(F.when(F.col("_rk") <= top, F.col("importance")).otherwise(0.0)) * 100.0
                  / F.sum("importance")).alias("top_share_pct"))


def top_k(imp: DataFrame, k: int = 20, value: str = "importance", name: str = "feature") -> DataFrame:
    """K largest (TakeOrdered: each task keeps k rows)."""
    return imp.orderBy(F.desc(value), F.asc(name)).limit(k)


def stream_summary(pred: DataFrame, label: str = "predicted_label", conf: str = "confidence") -> DataFrame:
    """Count, mean confidence, sorted distinct labels."""
    return pred.agg(F.count(F.lit(1)).alias("n"), F.avg(conf).alias("mean_confidence"),
                    F.array_sort(F.collect_set(label)).alias("labels"))
