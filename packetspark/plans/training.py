"""Training jobs (3.2): classifier and anomaly detector on the preprocessed
feature table (one dataset with a ``split`` column)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetspark import schema as S
from packetspark.functions.mapping import binary_relabel
from packetspark.operators import classify as C
from packetspark.operators import isoforest as IF
from packetspark.operators import metrics as M


def train_val(features: DataFrame) -> DataFrame:
    """Training + validation rows (the split column makes the union a filter)."""
    return features.where(F.col("split").isin("train", "validation"))


def split_rows(features: DataFrame, name: str) -> DataFrame:
    return features.where(F.col("split") == name)


def evaluate_predictions(pred: DataFrame, label: str = S.LABEL, group=()) -> dict:
    """E1-E6 + E8 from one scored frame; small tables only are returned."""
    conf = M.confusion(pred.select(*group, F.col(label).cast("int").alias("label"),
                                   F.col("prediction").cast("int").alias("prediction")), group=group)
    out = {"confusion": conf, "class_metrics": M.class_metrics(conf, group),
           "summary": M.summary_metrics(conf, group), "report": M.classification_report(conf, group)}
    if "probability_arr" in pred.columns:
        out["roc_auc_ovr"] = M.roc_auc_ovr(pred.select(*group, F.col(label).cast("int").alias("label"),
                                                       "probability_arr"), "label", "probability_arr", group)
    return out


@dataclass
class ForestRun:
    model: object
    importance: DataFrame
    test: dict
    validation: dict
    cv: DataFrame | None = None
    search: DataFrame | None = None
    params: dict = field(default_factory=dict)


def run_forest(features: DataFrame, tuning: str | None = "randomized", n_iter: int = 10, cv: int = 5,
               seed: int = 42, do_cv: bool = True, space: dict | None = None, **fit_kw) -> ForestRun:
    """3.2: tune -> cross-validate -> refit -> evaluate test -> importance.

    Validation metrics are computed on rows that were in the fit set
    (reference behaviour, reported as in-sample)."""
    tv = train_val(features)
    search = None
    if tuning:
        best, search = C.search_forest(tv, method=tuning, n_iter=n_iter, cv=cv, seed=seed,
                                       space=space or C.SEARCH_SPACE)
        p = best.runs[0].setting
        fit_kw = dict(num_trees=p.trees, max_depth=p.max_depth or None, min_instances=p.min_leaf, min_split=p.min_split,
                      feature_subset=p.subset, bootstrap=p.bootstrap, balanced=p.balanced)
    cvres = C.cross_validate(tv, cv=cv, seed=seed, **fit_kw) if do_cv else None
    model = best if tuning else C.fit_forest(tv, seed=seed, **fit_kw)
    test = evaluate_predictions(C.score(model, split_rows(features, "test")))
    val = evaluate_predictions(C.score(model, split_rows(features, "validation")))
    return ForestRun(model, C.feature_importance(model), test, val, cvres, search, fit_kw)


@dataclass
class IsolationRun:
    model: IF.IsolationForestModel
    contamination: dict
    sweep: DataFrame | None
    test: dict
    validation: dict
    search: DataFrame | None = None


def run_isolation(features: DataFrame, normal_class: int = S.NORMAL_CLASS, seed: int = 42,
                  do_search: bool = True, n_trees: int = 100, max_samples="auto",
                  min_precision: float = 0.1, psi_options=IF.PSI_OPTIONS,
                  tree_options=IF.TREE_OPTIONS) -> IsolationRun:
    """3.2 (anomaly): contamination + flip -> psi / tree search -> fit ->
    threshold sweep on validation -> evaluate validation and test."""
    x = features.withColumn("y", binary_relabel(F.col(S.LABEL), normal_class))
    tv = train_val(x)
    cont = IF.contamination(tv, "y")
    search = None
    if do_search:
        search = IF.search(tv, split_rows(x, "validation"), "y", seed=seed,
                           contamination_rate=cont["contamination"], psi_options=psi_options,
                           tree_options=tree_options, flipped=cont["flipped"]).cache()
        best = search.where("rank = 1").first()
        n_trees, max_samples = best["n_trees"], best["psi"]
    model = IF.fit(tv, n_trees=n_trees, max_samples=max_samples, seed=seed)
    tr_scores = IF.score(model, tv.select("event_id", *model.features)).select("score") \
        .persist(StorageLevel.MEMORY_AND_DISK)
    model.offset = IF.fit_offset(tr_scores, cont["contamination"])
    tr_scores.unpersist()
    model.flipped = cont["flipped"]
    model.contamination = cont["contamination"]
    val_scores = IF.score(model, split_rows(x, "validation")).select("y", "score") \
        .persist(StorageLevel.MEMORY_AND_DISK)
    sweep = IF.threshold_sweep(val_scores, "y", "score", flipped=cont["flipped"],
                               min_precision=min_precision).cache()
    sel = sweep.where("selected").first()
    model.threshold = sel["threshold"] if sel else None

    def ev(df):
        p = IF.predict(IF.score(model, df), model.offset, threshold=model.threshold, flipped=model.flipped) \
            .select("y", "score", "prediction").persist(StorageLevel.MEMORY_AND_DISK)
        conf = M.confusion(p.select(F.col("y").alias("label"), "prediction"))
        b = M.minmax_scale_scores(p, "score", "score_scaled").withColumn("y01", (F.col("y") == -1).cast("int"))
        return {"confusion": conf, "class_metrics": M.class_metrics(conf), "summary": M.summary_metrics(conf),
                "counts": M.binary_counts(conf), "roc_auc": M.roc_auc(b, "y01", "score_scaled"),
                "average_precision": M.average_precision(b, "y01", "score_scaled")}
    return IsolationRun(model, cont, sweep, ev(split_rows(x, "test")), ev(split_rows(x, "validation")), search)
