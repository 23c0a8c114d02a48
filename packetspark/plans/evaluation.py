"""Fault evaluation job (3.4, E13, F6): one job scores every fault scenario
on the test split and computes all metrics grouped by scenario."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetspark import schema as S
from packetspark.functions.mapping import binary_relabel
from packetspark.operators import classify as C
from packetspark.operators import faults as FI
from packetspark.operators import isoforest as IF
from packetspark.operators import metrics as M
from packetspark.session import written


def faulted_test_set(features: DataFrame, scenarios: Sequence[FI.FaultConfig],
                     include_clean: bool = True) -> DataFrame:
    """F6 over the test rows, plus the untouched rows as scenario ``clean``."""
    test = features.where(F.col("split") == "test")
    x = FI.sweep(test, list(scenarios))
    if include_clean:
        clean = test.withColumn("scenario_id", F.lit("clean")).withColumn("_affected", F.lit(False))
        clean = clean.withColumns({c: F.col(c).cast("double") for c in FI.numeric_features(
            test, (S.LABEL, "event_id", "us", "device_id"))})
        x = x.unionByName(clean.select(*x.columns))
    return x


def evaluate_faults(model, kind: str, features: DataFrame, scenarios: Sequence[FI.FaultConfig],
                    normal_class: int = S.NORMAL_CLASS) -> dict:
    """Inject -> predict -> metrics, all scenarios in one grouped pass.

    ``kind`` is ``forest`` (multi-class) or ``iforest`` (binary, 1 normal /
    -1 anomaly)."""
    x = faulted_test_set(features, scenarios)
    g = ["scenario_id"]
    if kind == "forest":
        # scored once: every metric below reads the written scores
        lab = written(C.score(model, x).select("scenario_id", F.col(S.LABEL).cast("int").alias("label"), "prediction", "probability_arr"), "fault-scores")
        out = {"ovr": M.roc_auc_ovr(lab, "label", "probability_arr", g)}
    else:
        s = IF.score(model, x.withColumn("y", binary_relabel(F.col(S.LABEL), normal_class)))
        p = IF.predict(s, model.offset or 0.0, threshold=model.threshold, flipped=model.flipped)
        p = written(p.select("scenario_id", "y", "prediction", "score"), "fault-scores")
        lab = p.select("scenario_id", F.col("y").alias("label"), "prediction", "score")
        b = M.minmax_scale_scores(p, "score", "score_scaled").withColumn("y01", (F.col("y") == -1).cast("int"))
        out = {"roc_auc": M.roc_auc(b, "y01", "score_scaled", g),
               "average_precision": M.average_precision(b, "y01", "score_scaled", g)}
    conf = M.confusion(lab, "label", "prediction", g)
    out.update({"confusion": conf, "class_metrics": M.class_metrics(conf, g),
                "summary": M.summary_metrics(conf, g), "report": M.classification_report(conf, g)})
    return out


def scenario_table(spark, scenarios: Sequence[FI.FaultConfig], base: str = "evaluation_results") -> DataFrame:
    """Scenario parameters with their run tag (S11) for partitioned results."""
    rows = [(s.scenario_id, s.enabled, s.corruption_rate, s.noise_std, s.payload_loss_rate, s.target)
            for s in scenarios]
    t = spark.createDataFrame(rows, "scenario_id string, enabled boolean, corruption_rate double, "
                                    "noise_std double, payload_loss_rate double, target string")
    return t.withColumn("run_tag", FI.run_tag_expr(base, F.col("enabled"), F.col("corruption_rate"),
                                                   F.col("noise_std"), F.col("payload_loss_rate"), F.col("target")))


def save_results(summary: DataFrame, scenarios: DataFrame, path: str) -> None:
    """Results partitioned by the scenario's parameters."""
    (summary.join(scenarios, "scenario_id", "left").write.mode("overwrite")
     .partitionBy("corruption_rate", "noise_std", "payload_loss_rate", "target").json(path))
