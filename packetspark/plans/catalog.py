"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Every query reads the given tables (``events`` through the packets view,
``embeddings``, ``labels``) so its work grows with them.  Doubles are rounded
to 6 decimals for the order-insensitive value comparison with DuckDB.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetspark import schema as S
from packetspark.functions.coerce import hex_int
from packetspark.functions.mapping import binary_relabel, map_features
from packetspark.operators import stats as ST
from packetspark.operators import timeline as TL
from packetspark.plans.preprocess import PreprocessOptions, preprocess
from packetspark.sources.packets import read_packets, read_table

WIDE = (60, 600, 3600)            # the test data's mean gap is ~259 s
DEVICE_WINDOWS = (3600, 86400, 604800)
R = 6


def r(c, name=None):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), R).alias(name) if name else F.round(c.cast("double"), R)


def mapped(spark, sf):
    return map_features(read_packets(spark, sf))


# ---------------------------------------------------------------- mapping

def q_packet_map(spark, sf):
    return mapped(spark, sf).select(
        "event_id", r("frame_length", "frame_length"), "protocol_flags", "mqtt_msgtype",
        "mqtt_qos", r("mqtt_payload_len", "mqtt_payload_len"), "mqtt_retain",
        "mqtt_client_id_hash", "target")


def q_hex_coerce(spark, sf):
    p = read_packets(spark, sf)
    ev = read_table(spark, sf, "events")
    x = p.join(ev.select("event_id", "props", "value"), "event_id")
    return x.select(
        "event_id", "tcp_flags",
        hex_int(F.col("tcp_flags")).alias("flags_parse"),
        hex_int(F.col("tcp_flags"), hex_mode="zero").alias("flags_zero"),
        hex_int(F.col("props")).alias("props_int"),
        hex_int(F.col("value").cast("string")).alias("value_int"))


def q_msgtype_hist(spark, sf):
    return (mapped(spark, sf).groupBy("mqtt_msgtype")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("mqtt_retain").alias("n_retain")))


def q_binary_relabel(spark, sf):
    return read_packets(spark, sf).select("event_id", "target", binary_relabel(F.col("target")).alias("y"))


# ---------------------------------------------------------------- timeline

def q_iat_gap(spark, sf):
    x = TL.inter_arrival(read_packets(spark, sf), "ts_gap")
    return x.select("event_id", r("iat", "iat"))


def q_iat_delta(spark, sf):
    x = TL.inter_arrival(read_packets(spark, sf), "delta_diff")
    return x.select("event_id", r("iat", "iat"))


def _windows(spark, sf, windows=WIDE, keys=(), include_current=True):
    return TL.window_stats(mapped(spark, sf), windows, keys=keys, include_current=include_current)


def q_msg_rate(spark, sf):
    x = _windows(spark, sf)
    return x.select("event_id", *[r(S.rate_col(w), S.rate_col(w)) for w in WIDE])


def q_rolling_payload(spark, sf):
    x = _windows(spark, sf)
    return x.select("event_id", *[r(f(w), f(w)) for w in WIDE for f in (S.mean_col, S.std_col)])


def q_rolling_exclusive(spark, sf):
    x = _windows(spark, sf, include_current=False)
    return x.select("event_id", *[r(f(w), f(w)) for w in WIDE
                                  for f in (S.rate_col, S.mean_col, S.std_col)])


def q_rolling_by_device(spark, sf):
    x = _windows(spark, sf, DEVICE_WINDOWS, keys=("device_id",))
    return x.select("event_id", "device_id", *[r(f(w), f(w)) for w in DEVICE_WINDOWS
                                               for f in (S.rate_col, S.mean_col, S.std_col)])


def q_time_split(spark, sf):
    return TL.time_split(read_packets(spark, sf)).select("event_id", "split")


def q_split_profile(spark, sf):
    return TL.split_profile(TL.time_split(read_packets(spark, sf)))


# ---------------------------------------------------------------- statistics

RAW = ["tcp_len", "mqtt_msg", "tcp_time_delta"]


def q_quantiles_ties(spark, sf):
    """Constant, heavily tied and plain columns of the events."""
    df = read_packets(spark, sf).select(F.lit(7.0).alias("constant"), "tcp_len",
                                        F.when(F.col("event_id") % 10 == 0, F.col("event_id").cast("double"))
                                         .otherwise(F.lit(0.0)).alias("ties"))
    cols = ["constant", "ties", "tcp_len"]
    q = ST.exact_quantiles(df, cols, [0.05, 0.5, 0.95])
    return spark.createDataFrame([(c, *q[c]) for c in cols], "column string, q05 double, median double, q95 double") \
        .select("column", *[r(c, c) for c in ("q05", "median", "q95")])


def q_quantiles(spark, sf):
    df = read_packets(spark, sf)
    q = ST.exact_quantiles(df, RAW, [0.25, 0.5, 0.75])
    rows = [(c, *q[c]) for c in RAW]
    return spark.createDataFrame(rows, "column string, q1 double, median double, q3 double") \
        .select("column", *[r(c, c) for c in ("q1", "median", "q3")])


def q_iqr_cap(spark, sf):
    df = read_packets(spark, sf)
    capped, _ = ST.iqr_cap(df, RAW, factor=1.0)
    return capped.select("event_id", *[r(c, c) for c in RAW])


def q_zscore_cap(spark, sf):
    df = read_packets(spark, sf)
    capped, _ = ST.zscore_cap(df, RAW, factor=1.5)
    return capped.select("event_id", *[r(c, c) for c in RAW])


def q_cap_counts(spark, sf):
    df = read_packets(spark, sf)
    b = ST.iqr_bounds(df, RAW, factor=1.0)
    return ST.cap_counts(df, b)


def q_standardise(spark, sf):
    df = read_packets(spark, sf)
    out, _ = ST.standardise(df, RAW)
    return out.select("event_id", *[r(c, c) for c in RAW])


def q_scaler_state(spark, sf):
    df = read_packets(spark, sf)
    st = ST.fit_state(df, scale_columns=RAW, cap_columns=RAW, fitted_on="all")
    return st.select("column", *[r(c, c) for c in ("mean", "std_pop", "q1", "q3", "lower", "upper")],
                     "fitted_on")


def q_preprocess_features(spark, sf):
    res = preprocess(read_packets(spark, sf), PreprocessOptions())
    f = res.features
    ints = {"protocol_flags", "mqtt_msgtype", "mqtt_qos", "mqtt_retain", "mqtt_client_id_hash"}
    cols = [F.col(c) if c in ints else r(c, c) for c in S.FEATURES]
    return f.select("event_id", *cols, "target", "split")


# ---------------------------------------------------------------- grouping

def q_class_distribution(spark, sf):
    from packetspark.operators.metrics import class_distribution
    return class_distribution(read_packets(spark, sf), "target") \
        .select("target", "n", r("pct", "pct"))


def q_class_weights(spark, sf):
    from packetspark.operators.classify import balanced_weights
    w = balanced_weights(read_packets(spark, sf), "target")
    return w.select("target", r("weight", "weight"))


def q_stratified_folds(spark, sf):
    from packetspark.operators.classify import stratified_folds
    return stratified_folds(read_packets(spark, sf), "target", k=5, seed=42).select("event_id", "target", "fold")


QUERIES = {
    "packet_map": q_packet_map,
    "hex_coerce": q_hex_coerce,
    "msgtype_hist": q_msgtype_hist,
    "binary_relabel": q_binary_relabel,
    "iat_gap": q_iat_gap,
    "iat_delta": q_iat_delta,
    "msg_rate": q_msg_rate,
    "rolling_payload": q_rolling_payload,
    "rolling_exclusive": q_rolling_exclusive,
    "rolling_by_device": q_rolling_by_device,
    "time_split": q_time_split,
    "split_profile": q_split_profile,
    "quantiles": q_quantiles,
    "quantiles_ties": q_quantiles_ties,
    "iqr_cap": q_iqr_cap,
    "zscore_cap": q_zscore_cap,
    "cap_counts": q_cap_counts,
    "standardise": q_standardise,
    "scaler_state": q_scaler_state,
    "preprocess_features": q_preprocess_features,
    "class_distribution": q_class_distribution,
    "class_weights": q_class_weights,
    "stratified_folds": q_stratified_folds,
}


# ---------------------------------------------------------------- evaluation

def metric_base(spark, sf) -> DataFrame:
    """Label, a deterministic prediction and a score with many ties, derived
    from ``event_id`` in both engines."""
    p = read_packets(spark, sf)
    eid = F.col("event_id")
    pred = F.when(eid % 7 == 0, (F.col("target") + 1) % 6).otherwise(F.col("target"))
    score = (-((eid * 7919) % 1000)).cast("double") / F.lit(1000.0)
    return p.select("event_id", F.col("target").alias("label"), pred.alias("prediction"),
                    score.alias("score"), "us")


def _binary(df):
    return df.select("event_id", binary_relabel(F.col("label")).alias("label"),
                     binary_relabel(F.col("prediction")).alias("prediction"), "score", "us")


def q_confusion(spark, sf):
    from packetspark.operators import metrics as M
    return M.confusion(metric_base(spark, sf))


def q_confusion_normalised(spark, sf):
    from packetspark.operators import metrics as M
    return M.confusion_normalised(M.confusion(metric_base(spark, sf))) \
        .select("label", "prediction", "n", r("share", "share"))


def q_class_metrics(spark, sf):
    from packetspark.operators import metrics as M
    cm = M.class_metrics(M.confusion(metric_base(spark, sf)))
    return cm.select("class_label", "class_name", *[r(c, c) for c in ("precision", "recall", "f1_score")],
                     "support")


def q_macro_metrics(spark, sf):
    from packetspark.operators import metrics as M
    m = M.summary_metrics(M.confusion(metric_base(spark, sf)))
    return m.select(*[r(c, c) for c in ("accuracy", "precision_macro", "recall_macro", "f1_macro")], "n")


def q_classification_report(spark, sf):
    from packetspark.operators import metrics as M
    rep = M.classification_report(M.confusion(metric_base(spark, sf)))
    return rep.select("row", "pos", *[r(c, c) for c in ("precision", "recall", "f1_score")], "support")


def q_binary_counts(spark, sf):
    from packetspark.operators import metrics as M
    return M.binary_counts(M.confusion(_binary(metric_base(spark, sf))))


def q_binary_metrics(spark, sf):
    from packetspark.operators import metrics as M
    b = M.binary_metrics(M.confusion(_binary(metric_base(spark, sf))), positive=1)
    return b.select(*[r(c, c) for c in b.columns])


def q_metrics_chart(spark, sf):
    from packetspark.operators import metrics as M
    ch = M.metrics_chart(M.confusion(metric_base(spark, sf)))
    return ch.select("class_label", "display_name", *[r(c, c) for c in ("precision", "recall", "f1_score")])


def q_label_set(spark, sf):
    from packetspark.operators import metrics as M
    return M.label_set(metric_base(spark, sf))


def _anomaly_scores(spark, sf):
    from packetspark.operators import metrics as M
    b = metric_base(spark, sf).withColumn("y01", (F.col("label") != S.NORMAL_CLASS).cast("int"))
    return M.minmax_scale_scores(b, "score", "score_scaled")


def q_minmax_scores(spark, sf):
    return _anomaly_scores(spark, sf).select("event_id", r("score_scaled", "score_scaled"))


def q_roc_auc(spark, sf):
    from packetspark.operators import metrics as M
    return M.roc_auc(_anomaly_scores(spark, sf), "y01", "score_scaled").select(r("roc_auc", "roc_auc"))


def q_average_precision(spark, sf):
    from packetspark.operators import metrics as M
    return M.average_precision(_anomaly_scores(spark, sf), "y01", "score_scaled") \
        .select(r("average_precision", "average_precision"))


def q_roc_auc_ovr(spark, sf):
    from packetspark.operators import metrics as M
    p = read_packets(spark, sf)
    eid = F.col("event_id")
    probs = F.array(*[((eid * (2 * c + 3) + c) % 10).cast("double") / F.lit(10.0) for c in range(6)])
    x = p.select((eid % 6).cast("int").alias("label"), probs.alias("probability"))
    return M.roc_auc_ovr(x, "label", "probability").select(r("roc_auc_ovr", "roc_auc_ovr"))


# ---------------------------------------------------------------- anomaly

def q_contamination(spark, sf):
    from packetspark.operators.isoforest import contamination
    s = TL.time_split(read_packets(spark, sf)).where(F.col("split").isin("train", "validation"))
    c = contamination(s.select(binary_relabel(F.col("target")).alias("y")), "y")
    return spark.createDataFrame([(float(c["anomaly_rate"]), bool(c["flipped"]), float(c["contamination"]))],
                                 "anomaly_rate double, flipped boolean, contamination double") \
        .select(r("anomaly_rate", "anomaly_rate"), "flipped", r("contamination", "contamination"))


def q_threshold_sweep(spark, sf):
    from packetspark.operators.isoforest import threshold_sweep
    b = _binary(metric_base(spark, sf)).select(F.col("label").alias("y"), "score")
    sw = threshold_sweep(b, "y", "score", flipped=False, min_precision=0.1)
    return sw.select("pos", r("percentile", "percentile"), r("threshold", "threshold"),
                     *[r(c, c) for c in ("precision_macro", "recall_macro", "f1_macro")], "eligible", "selected")


# ---------------------------------------------------------------- importance tables

IMP_COLS = ["tcp_len", "mqtt_msg", "tcp_time_delta", "mqtt_hdrflags", "mqtt_conflags",
            "mqtt_conack_flags", "mqtt_qos"]


def importance_proxy(spark, sf) -> DataFrame:
    """(feature, importance): |corr(x, target)| normalised to sum 1."""
    p = read_packets(spark, sf)
    row = p.agg(*[F.abs(F.corr(F.col(c).cast("double"), F.col("target").cast("double"))).alias(c)
                  for c in IMP_COLS])
    long = row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("v"))
                                          for c in IMP_COLS])).alias("x")).select("x.*")
    return long.select("feature", (F.col("v") / F.sum("v").over(Window.partitionBy())).alias("importance"))


def q_topk(spark, sf):
    from packetspark.operators.metrics import top_k
    return top_k(importance_proxy(spark, sf), 3).select("feature", r("importance", "importance"))


def q_importance_summary(spark, sf):
    from packetspark.operators.metrics import importance_summary
    s = importance_summary(importance_proxy(spark, sf), top=5)
    return s.select("n_features", *[r(c, c) for c in ("total", "max_importance", "mean_importance",
                                                       "median_importance", "top_share_pct")])


def q_importance_cumulative(spark, sf):
    from packetspark.operators.metrics import importance_cumulative
    x = importance_cumulative(importance_proxy(spark, sf))
    return x.select("feature", *[r(c, c) for c in ("importance", "cumulative", "cumulative_pct")])


# ---------------------------------------------------------------- faults (F1-F8)

FAULT_FEATURES = ["frame_length", "protocol_flags", "mqtt_msgtype", "mqtt_qos", "mqtt_payload_len",
                  "mqtt_retain", "mqtt_client_id_hash"]


def fault_base(spark, sf, with_split=False) -> DataFrame:
    m = mapped(spark, sf)
    if with_split:
        m = TL.time_split(m)
    cols = ["event_id", *FAULT_FEATURES, "target"] + (["split"] if with_split else [])
    return m.select(*cols)


def _fault_out(df, extra=()):
    return df.select("event_id", *extra, *[r(c, c) for c in FAULT_FEATURES])


def q_feature_corruption(spark, sf):
    from packetspark.operators.faults import FaultConfig, corrupt_features
    cfg = FaultConfig(corruption_rate=0.3, noise_std=0.3)
    x, _ = corrupt_features(fault_base(spark, sf), cfg)
    return _fault_out(x)


def q_payload_loss(spark, sf):
    from packetspark.operators.faults import FaultConfig, payload_loss
    cfg = FaultConfig(payload_loss_rate=0.3, drop_features=["mqtt_qos"])
    x, _ = payload_loss(fault_base(spark, sf), cfg)
    return _fault_out(x, ["_affected"]).withColumnRenamed("_affected", "affected")


def q_combined_faults(spark, sf):
    from packetspark.operators.faults import FaultConfig, combined_faults
    x, _ = combined_faults(fault_base(spark, sf), FaultConfig())
    return _fault_out(x, ["_affected"]).withColumnRenamed("_affected", "affected")


def q_fault_target(spark, sf):
    from packetspark.operators.faults import FaultConfig, apply_to_target
    x, _ = apply_to_target(fault_base(spark, sf, with_split=True), FaultConfig(target="test"))
    return _fault_out(x, ["split", "_affected"]).withColumnRenamed("_affected", "affected")


SWEEP = [("s1", 0.1, 0.1, 0.05), ("s2", 0.2, 0.1, 0.15), ("s3", 0.3, 0.3, 0.3)]


def q_fault_sweep(spark, sf):
    from packetspark.operators.faults import FaultConfig, sweep
    scen = [FaultConfig(corruption_rate=a, noise_std=b, payload_loss_rate=c, scenario_id=i)
            for i, a, b, c in SWEEP]
    x = sweep(fault_base(spark, sf), scen)
    return x.select("scenario_id", "event_id", F.col("_affected").alias("affected"),
                    *[r(c, c) for c in FAULT_FEATURES])


def q_fault_report(spark, sf):
    from packetspark.operators.faults import FaultConfig, combined_faults, fault_report_frame
    cfg = FaultConfig()
    x, rep = combined_faults(fault_base(spark, sf), cfg)
    f = fault_report_frame(spark, x, rep, cfg)
    return f.select(*[r(c, c) if c in ("corruption_rate", "noise_std", "sample_rate") else c for c in f.columns])


QUERIES.update({
    "confusion": q_confusion,
    "confusion_normalised": q_confusion_normalised,
    "class_metrics": q_class_metrics,
    "macro_metrics": q_macro_metrics,
    "classification_report": q_classification_report,
    "binary_counts": q_binary_counts,
    "binary_metrics": q_binary_metrics,
    "metrics_chart": q_metrics_chart,
    "label_set": q_label_set,
    "minmax_scores": q_minmax_scores,
    "roc_auc": q_roc_auc,
    "average_precision": q_average_precision,
    "roc_auc_ovr": q_roc_auc_ovr,
    "contamination": q_contamination,
    "threshold_sweep": q_threshold_sweep,
    "topk": q_topk,
    "importance_summary": q_importance_summary,
    "importance_cumulative": q_importance_cumulative,
    "feature_corruption": q_feature_corruption,
    "payload_loss": q_payload_loss,
    "combined_faults": q_combined_faults,
    "fault_target": q_fault_target,
    "fault_sweep": q_fault_sweep,
    "fault_report": q_fault_report,
})


# ---------------------------------------------------------------- models (C1-C10, A2-A9) and E13

# the reference's forest and its search
RF_QUERY = dict(num_trees=100, max_depth=None)
RF_SEARCH = dict(method="randomized", n_iter=10, cv=5)


def _features(spark, sf):
    from packetspark.session import written
    res = preprocess(read_packets(spark, sf), PreprocessOptions())
    return written(res.features, "features")


def q_rf_fit_predict(spark, sf):
    from packetspark.operators import classify as C
    from packetspark.plans.training import split_rows, train_val
    f = _features(spark, sf)
    model = C.fit_forest(train_val(f), **RF_QUERY)
    p = C.score(model, split_rows(f, "test"))
    return p.select("event_id", F.col("target").cast("int").alias("target"), "prediction", r("confidence", "confidence"))


def q_rf_importance(spark, sf):
    from packetspark.operators import classify as C
    from packetspark.plans.training import train_val
    model = C.fit_forest(train_val(_features(spark, sf)), **RF_QUERY)
    return C.feature_importance(model)


def q_rf_search(spark, sf):
    from packetspark.operators import classify as C
    from packetspark.plans.training import train_val
    _, res = C.search_forest(train_val(_features(spark, sf)), space=C.SEARCH_SPACE, refit=False, **RF_SEARCH)
    return res


def q_rf_cv(spark, sf):
    from packetspark.operators import classify as C
    from packetspark.plans.training import train_val
    return C.cross_validate(train_val(_features(spark, sf)), cv=RF_SEARCH["cv"], **RF_QUERY)


def q_iforest_fit_score(spark, sf):
    from packetspark.plans.training import run_isolation
    from packetspark.operators import isoforest as IF
    f = _features(spark, sf)
    run = run_isolation(f, do_search=False, n_trees=100)
    t = f.where(F.col("split") == "test").withColumn("y", binary_relabel(F.col("target")))
    p = IF.predict(IF.score(run.model, t), run.model.offset, threshold=run.model.threshold,
                   flipped=run.model.flipped)
    return p.select("event_id", "y", r("score", "score"), "prediction")


def q_iforest_search(spark, sf):
    from packetspark.operators import isoforest as IF
    from packetspark.plans.training import split_rows, train_val
    f = _features(spark, sf).withColumn("y", binary_relabel(F.col("target")))
    c = IF.contamination(train_val(f), "y")
    return IF.search(train_val(f), split_rows(f, "validation"), "y", contamination_rate=c["contamination"],
                     flipped=c["flipped"])


def q_fault_evaluation(spark, sf):
    from packetspark.operators import classify as C
    from packetspark.operators.faults import FaultConfig
    from packetspark.plans.evaluation import evaluate_faults
    from packetspark.plans.training import train_val
    f = _features(spark, sf)
    model = C.fit_forest(train_val(f), **RF_QUERY)
    scen = [FaultConfig(corruption_rate=a, noise_std=b, payload_loss_rate=c, scenario_id=i) for i, a, b, c in SWEEP]
    return evaluate_faults(model, "forest", f, scen)["summary"]


def q_rf_embeddings(spark, sf):
    """Second classifier fit: 64-dim embeddings, labels 0..9."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector
    from packetspark.functions import draws as D
    e = read_table(spark, sf, "embeddings")
    e = e.withColumn("features", array_to_vector(F.col("embedding").cast("array<double>"))) \
         .withColumn("_u", D.uniform([42, F.col("vec_id"), "split"]))
    rf = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=50, seed=42)
    m = rf.fit(e.where(F.col("_u") < 0.8).withColumn("label", F.col("label").cast("double")))
    p = m.transform(e.where(F.col("_u") >= 0.8).withColumn("label", F.col("label").cast("double")))
    return p.select("vec_id", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"))


def q_label_imbalance(spark, sf):
    from packetspark.operators.classify import balanced_weights
    from packetspark.operators.metrics import class_distribution
    lab = read_table(spark, sf, "labels")
    d = class_distribution(lab, "toxic")
    w = balanced_weights(lab, "toxic")
    return d.join(w, "toxic").select("toxic", "n", r("pct", "pct"), r("weight", "weight"))


# ---------------------------------------------------------------- streaming (ST1-ST10)

def _stream_run(spark, sf, bad_every=None, model=None, kind="label", windows=WIDE, scaler=None, caps=None,
                temporal_only=False):
    from packetspark.operators.forest import BROADCAST_BYTES, size_of
    from packetspark.streaming import scorer as SC
    src = SC.scratch(spark, "stream-src")
    SC.stage_records(SC.records_from_packets(read_packets(spark, sf), bad_every), src)
    parsed = SC.parse_records(SC.read_stream(spark, src))
    if temporal_only:
        st = SC.temporal_stream(parsed, windows, key="device_id", watermark="3650 days")
        out = SC.scratch(spark, "stream-out")
        SC.run_to_sink(st, out, SC.scratch(spark, "stream-ckpt"))
    else:
        # a forest that is too large for every worker meets the micro-batches as a table
        large = kind == "forest" and size_of(model) > BROADCAST_BYTES
        st = SC.score_stream(parsed, windows, key="device_id", watermark="3650 days", scaler=scaler, caps=caps,
                             model=None if large else model, model_kind=kind)
        out, ckpt = SC.scratch(spark, "stream-out"), SC.scratch(spark, "stream-ckpt")
        if large:
            SC.run_scored(st, model, out, ckpt, kind)
        else:
            SC.run_to_sink(st, out, ckpt)
    return spark.read.parquet(out)


def q_stream_replay_window(spark, sf):
    x = _stream_run(spark, sf, temporal_only=True)
    return x.select("event_id", "device_id", r("iat", "iat"),
                    *[r(f(w), f(w)) for w in WIDE for f in (S.rate_col, S.mean_col, S.std_col)])


def q_stream_dead_letter(spark, sf):
    x = _stream_run(spark, sf, bad_every=97, windows=S.DEFAULT_WINDOWS)
    return x.where(F.col("status") == "bad").select("event_id", "status")


def q_stream_predict(spark, sf):
    from packetspark.operators import classify as C
    from packetspark.plans.training import train_val
    from packetspark.session import written
    # the model sees features as the stream makes them: per device, timestamp gaps, capped copies, one scaler
    opts = PreprocessOptions(iat_mode="ts_gap", keys=("device_id",), cap_derived=True,
                             scale_columns=tuple(S.SERVE_SCALE_COLUMNS))
    res = preprocess(read_packets(spark, sf), opts)
    model = C.fit_forest(train_val(written(res.features, "features")), **RF_QUERY)
    x = _stream_run(spark, sf, model=model, kind="forest", windows=S.DEFAULT_WINDOWS, scaler=res.scaler, caps=res.caps)
    return x.select("event_id", "device_id", "status", "predicted_label", r("confidence", "confidence"))


QUERIES.update({
    "rf_fit_predict": q_rf_fit_predict,
    "rf_importance": q_rf_importance,
    "rf_search": q_rf_search,
    "rf_cv": q_rf_cv,
    "rf_embeddings": q_rf_embeddings,
    "label_imbalance": q_label_imbalance,
    "iforest_fit_score": q_iforest_fit_score,
    "iforest_search": q_iforest_search,
    "fault_evaluation": q_fault_evaluation,
    "stream_replay_window": q_stream_replay_window,
    "stream_dead_letter": q_stream_dead_letter,
    "stream_predict": q_stream_predict,
})


def q_tumbling_rate(spark, sf):
    from packetspark.streaming.scorer import tumbling_rates
    m = mapped(spark, sf).withColumn("ts", F.timestamp_micros("us"))
    t = tumbling_rates(m, "1 hour", watermark=None)
    return t.select("device_id", "window_start_us", "n", r("mean_payload", "mean_payload"))


QUERIES["tumbling_rate"] = q_tumbling_rate


# ---------------------------------------------------------------- streams in several micro-batches (ST3, ST5, ST10, R7)

def _arrivals(spark, sf, bad_every=None):
    """Records in four micro-batches: quarters of the time range, one event in fifty held back to the last."""
    from packetspark.streaming import scorer as SC
    p = read_packets(spark, sf)
    lo, hi = p.agg(F.min("us"), F.max("us")).first()
    quarter = F.floor((F.col("us") - F.lit(lo)) * 4 / F.lit(hi - lo + 1)).cast("int")
    p = p.withColumn("batch", F.when(F.col("event_id") % 50 == 7, F.lit(3)).otherwise(quarter))
    return [SC.records_from_packets(p.where(F.col("batch") == b), bad_every) for b in range(4)]


def q_stream_late(spark, sf):
    """ST3 / ST5: rows that come out of order, and late ones behind a watermark of an hour."""
    from packetspark.streaming import scorer as SC
    out = SC.scratch(spark, "stream-out")
    SC.run_in_batches(_arrivals(spark, sf), lambda x: SC.temporal_stream(x, (3600, 10 ** 9), key="device_id", watermark="1 hour"),
                      SC.scratch(spark, "stream-src"), out, SC.scratch(spark, "stream-ckpt"))
    return spark.read.parquet(out).select("event_id", "device_id", "status", r("msg_rate_3600s", "msg_rate_3600s"),
                                          r("rolling_mean_payload_3600s", "rolling_mean_payload_3600s"))


def q_tumbling_stream(spark, sf):
    """ST10 as a stream: append mode; windows that the watermark has not closed stay in the state."""
    from packetspark.streaming import scorer as SC
    out = SC.scratch(spark, "stream-out")
    SC.run_in_batches(_arrivals(spark, sf), lambda x: SC.tumbling_rates(x.withColumn("ts", F.timestamp_micros("us")), "1 hour", watermark="1 hour"),
                      SC.scratch(spark, "stream-src"), out, SC.scratch(spark, "stream-ckpt"))
    return spark.read.parquet(out).select("device_id", "window_start_us", "n", r("mean_payload", "mean_payload"))


def q_stream_limit(spark, sf):
    """A stream that stops after a third of the records were successes, over restarts."""
    from packetspark.streaming import scorer as SC
    src, out, ckpt = (SC.scratch(spark, f"stream-{n}") for n in ("src", "out", "ckpt"))
    limit = read_packets(spark, sf).count() // 3
    for records in _arrivals(spark, sf, bad_every=97):
        SC.stage_records(records, src, mode="append")
        scored = SC.score_stream(SC.parse_records(SC.read_stream(spark, src)), (60,), key="device_id", watermark="3650 days")
        SC.run_until(scored, out, ckpt, limit)
    return spark.read.parquet(out).select("event_id", "status")


QUERIES.update({"stream_late": q_stream_late, "tumbling_stream": q_tumbling_stream, "stream_limit": q_stream_limit})


def q_fault_evaluation_anomaly(spark, sf):
    """E13 for the anomaly model: every scenario scored by one isolation forest."""
    from packetspark.operators.faults import FaultConfig
    from packetspark.plans.evaluation import evaluate_faults
    from packetspark.plans.training import run_isolation
    f = _features(spark, sf)
    model = run_isolation(f, do_search=False, n_trees=100).model
    scen = [FaultConfig(corruption_rate=a, noise_std=b, payload_loss_rate=c, scenario_id=i) for i, a, b, c in SWEEP]
    return evaluate_faults(model, "iforest", f, scen)["summary"]


QUERIES["fault_evaluation_anomaly"] = q_fault_evaluation_anomaly


def q_run_tags(spark, sf):
    """The output name of a scenario for every event's parameters."""
    from packetspark.operators.faults import run_tag_expr
    e, none = F.col("event_id"), F.lit(None).cast("double")
    def rate(k, gap):
        return F.when(e % gap != 0, (e * k % 101) / F.lit(100.0)).otherwise(none)
    target = F.when(e % 11 != 0, F.element_at(F.array(*[F.lit(t) for t in ("train", "validation", "test", "all")]), (e % 4 + 1).cast("int")))
    return read_table(spark, sf, "events").select("event_id", run_tag_expr("models", e % 3 != 0, rate(7, 5), rate(13, 6), rate(29, 7), target).alias("run_tag"))


QUERIES["run_tags"] = q_run_tags


# ---------------------------------------------------------------- isolation trees by hash draws

# features that both engines hold exactly
IFOREST_FEATURES = ["frame_length", "protocol_flags", "mqtt_msgtype", "mqtt_qos", "mqtt_payload_len", "mqtt_retain",
                    "mqtt_client_id_hash", "tcp_time_delta"]


def _isolation(spark, sf):
    from packetspark.operators import isoforest as IF
    from packetspark.session import written
    m = written(mapped(spark, sf).select("event_id", binary_relabel(F.col("target")).alias("y"), *IFOREST_FEATURES), "packets")
    return m, IF.fit(m, IFOREST_FEATURES, n_trees=100)


def q_iforest_trees(spark, sf):
    """A2: every node of the forest."""
    _, model = _isolation(spark, sf)
    return model.trees.select("tree_id", "node_id", "feature", r("threshold", "threshold"), "n", "depth")


def q_iforest_scores(spark, sf):
    """All packets scored by the forest as saved and loaded again."""
    from packetspark.operators import isoforest as IF
    from packetspark.streaming.scorer import scratch
    m, model = _isolation(spark, sf)
    c = IF.contamination(m, "y")
    model.flipped, model.contamination = c["flipped"], c["contamination"]
    model.offset = IF.fit_offset(IF.score(model, m), c["contamination"])
    path = scratch(spark, "iforest")
    model.save(path)
    saved = IF.IsolationForestModel.load(spark, path)
    p = IF.predict(IF.score(saved, m), saved.offset, flipped=saved.flipped)
    return p.select("event_id", r("score", "score"), r("decision", "decision"), "prediction")


QUERIES.update({"iforest_trees": q_iforest_trees, "iforest_scores": q_iforest_scores})


# ---------------------------------------------------------------- metadata, scenarios and saved state

def q_metadata_encode(spark, sf):
    """A label document in a metadata folder applied to all events; values that it does not hold are routed aside."""
    from packetspark.sources.sinks import apply_encoding, read_metadata
    from packetspark.streaming.scorer import scratch
    e = read_table(spark, sf, "events").select("event_id", "event_type")
    # a document of all types but one: one row per type
    types = e.where(F.col("event_type") != "error").select("event_type").distinct()
    codes = types.withColumn("code", F.row_number().over(Window.orderBy("event_type")) - 1)
    folder = scratch(spark, "metadata")
    codes.groupBy().pivot("event_type").agg(F.first("code")).write.json(f"{folder}/label_encoding.json")
    known, unknown = apply_encoding(e, "event_type", read_metadata(spark, folder)["label_encoding"], "code")
    return known.withColumn("status", F.lit("ok")).unionByName(
        unknown.select("*", F.lit(-1).cast("long").alias("code"), F.lit("unknown").alias("status")))


def q_scenario_table(spark, sf):
    """A scenario document per event, read, checked and tagged; bad ones keep the reason."""
    from packetspark.operators.faults import read_scenarios, validate_scenarios
    from packetspark.streaming.scorer import scratch
    e = F.col("event_id")
    def rate(k, modulus):
        return (e * k % modulus) / F.lit(100.0)
    def but(gap, value):
        return F.when(e % gap != 0, value)
    docs = read_table(spark, sf, "events").select(
        F.concat(F.lit("e"), e.cast("string")).alias("scenario_id"),
        but(13, e % 3 != 0).alias("enabled"),
        F.struct(rate(7, 131).alias("rate"), but(17, rate(13, 101)).alias("noise_std")).alias("corruption"),
        F.struct(rate(29, 113).alias("rate"), but(19, F.lit("mqtt_payload_len")).alias("payload_feature")).alias("payload_loss"),
        but(23, F.element_at(F.array(*[F.lit(t) for t in ("train", "validation", "test", "all", "live")]), (e % 5 + 1).cast("int"))).alias("target"))
    path = scratch(spark, "scenarios")
    docs.write.json(path)
    return validate_scenarios(read_scenarios(spark, path, multi_line=False)).select("scenario_id", "reason", "run_tag")


def q_apply_saved_state(spark, sf):
    """Caps and scaler saved, loaded in a new session and applied to raw packets."""
    from packetspark.streaming.scorer import scratch
    path = scratch(spark, "state")
    ST.save_state(ST.fit_state(read_packets(spark, sf), scale_columns=RAW, cap_columns=RAW, fitted_on="all"), path)
    other = spark.newSession()
    scaler, caps = ST.load_state(other, path)
    fitted = other.read.parquet(path).select("version", "n_rows", "from_us", "to_us").distinct().first()
    x = ST.scaler_transform(ST.apply_caps(read_packets(spark, sf), caps), scaler)
    return x.select("event_id", *[r(c, c) for c in RAW], *[F.lit(v).alias(k) for k, v in fitted.asDict().items()])


QUERIES.update({"metadata_encode": q_metadata_encode, "scenario_table": q_scenario_table, "apply_saved_state": q_apply_saved_state})


def q_stream_idle(spark, sf):
    """ST3 / ST4: devices silent for a day behind the watermark leave the state, with a row that says so; they begin anew after."""
    from packetspark.streaming import scorer as SC
    out = SC.scratch(spark, "stream-out")
    with SC.one_stateful_operator(spark):
        SC.run_in_batches(_arrivals(spark, sf), lambda x: SC.temporal_stream(x, (60,), key="device_id", watermark="1 hour", idle=86400),
                          SC.scratch(spark, "stream-src"), out, SC.scratch(spark, "stream-ckpt"))
    x = spark.read.parquet(out)
    return x.select(F.coalesce("event_id", F.lit(-1)).alias("event_id"), "device_id", "us", r(F.coalesce(F.col("iat"), F.lit(0.0)), "iat"), "status")


QUERIES["stream_idle"] = q_stream_idle
