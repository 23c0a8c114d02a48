import os

import pytest
from pyspark.sql import functions as F

from packetspark import schema as S
from packetspark.functions.mapping import feature_map, feature_map_text
from packetspark.operators import isoforest as IF
from packetspark.operators.faults import FaultConfig
from packetspark.plans import catalog as CAT
from packetspark.plans.evaluation import evaluate_faults, scenario_table
from packetspark.plans.preprocess import preprocess, read_split, write_splits
from packetspark.plans.training import run_forest, run_isolation
from packetspark.sources.packets import read_packets, read_packets_csv
from packetspark.sources.sinks import training_summary, write_importance, write_results
from packetspark.streaming.scorer import limit_successes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def features(spark):
    return preprocess(read_packets(spark, SF)).features.cache()


def test_forest_job(spark, features, tmp_path):
    space = {"n_estimators": [5, 10], "max_depth": [3, 5], "min_samples_split": [2], "min_samples_leaf": [1, 2],
             "max_features": ["sqrt"], "bootstrap": [True], "class_weight": ["balanced"]}
    run = run_forest(features, tuning="randomized", n_iter=2, cv=2, space=space)
    s = run.test["summary"].first()
    assert 0 <= s["accuracy"] <= 1 and s["n"] == features.where("split = 'test'").count()
    assert run.importance.count() == 17 and run.search.count() == 2
    assert run.cv.count() == 1
    summ = training_summary(spark, run.params, run.cv, run.test["summary"], {"in_sample_validation": True})
    write_results(summ, str(tmp_path / "summary"))
    write_importance(run.importance, str(tmp_path / "imp"))
    assert spark.read.json(str(tmp_path / "summary")).count() == 1
    assert spark.read.option("header", True).csv(str(tmp_path / "imp")).count() == 17


def test_isolation_job_and_bundle(spark, features, tmp_path):
    run = run_isolation(features, do_search=True, n_trees=20, psi_options=("auto", 512), tree_options=(10, 20))
    assert run.search.where("rank = 1").count() == 1
    assert run.sweep.where("selected").count() <= 1
    c = run.test["counts"].first()
    assert sum(c) == features.where("split = 'test'").count()
    path = str(tmp_path / "iforest")
    run.model.save(path)
    m2 = IF.IsolationForestModel.load(spark, path)
    assert (m2.psi, m2.n_trees, m2.flipped) == (run.model.psi, run.model.n_trees, run.model.flipped)
    ev = evaluate_faults(m2, "iforest", features, [FaultConfig(scenario_id="a"), FaultConfig(scenario_id="b", corruption_rate=.3)])
    assert {r["scenario_id"] for r in ev["summary"].collect()} == {"a", "b", "clean"}
    tags = {r["scenario_id"]: r["run_tag"] for r in scenario_table(spark, [FaultConfig(scenario_id="a")]).collect()}
    assert tags["a"] == "evaluation_results_corruption0.2_noise0.1_payload0.15_test"


def test_split_sink_roundtrip(spark, features, tmp_path):
    out = str(tmp_path / "splits")
    write_splits(features, out)
    assert read_split(spark, out, "validation").count() == features.where("split = 'validation'").count()


def test_csv_source_and_timestamp_forms(spark, tmp_path):
    p = tmp_path / "p.csv"
    p.write_text("timestamp,tcp_len,tcp_flags,tcp_time_delta,mqtt_msg,mqtt_hdrflags,mqtt_conflags,"
                 "mqtt_conack_flags,mqtt_qos,Target\n"
                 "2024-01-01 00:00:01,60,0x18,0.1,12,48,0,1,1,3\n"
                 "1704067202.5,60,24,0.2,,0x30,2,,,1\n"
                 "19723,60,24,0.2,5,48,0,0,0,0\n"
                 "garbage,x,y,z\n")
    df = read_packets_csv(spark, str(p))
    times = [r["us"] for r in df.orderBy(F.col("us").asc_nulls_last()).collect()]
    assert times == [1704067201000000, 1704067202500000, None, None]   # a small number in text is no timestamp
    assert S.LABEL in df.columns and "Target" not in df.columns
    again = read_packets_csv(spark, str(p)).repartition(5)
    assert {r["event_id"] for r in df.collect()} == {r["event_id"] for r in again.collect()}


def test_feature_map_text(spark):
    df = spark.createDataFrame([(1.0, 2.5)], "b double, a double")
    txt = df.select(feature_map_text(feature_map(["b", "a"]))).first()[0]
    assert txt == "a:2.500000|b:1.000000"


def test_limit_successes(spark):
    df = spark.createDataFrame([(i, i, "bad" if i % 3 == 0 else "ok") for i in range(10)],
                               "event_id long, us long, status string")
    kept = limit_successes(df, 4).orderBy("event_id").collect()
    assert [r["event_id"] for r in kept] == [0, 1, 2, 3, 4, 5]
    assert limit_successes(df, 0).count() == 10
    # a bad record has no time; one that lies behind the limit is never reached
    late = spark.createDataFrame([(0, 10, "ok"), (1, 20, "ok"), (2, 30, "ok"), (3, None, "bad")],
                                 "event_id long, us long, status string")
    assert [r["event_id"] for r in limit_successes(late, 2).orderBy("event_id").collect()] == [0, 1]


def test_registered_queries_smoke(spark):
    for name in ("packet_map", "confusion", "fault_report", "label_imbalance", "tumbling_rate"):
        assert CAT.QUERIES[name](spark, SF).count() > 0


def test_metadata_from_any_file_system(spark, tmp_path):
    from packetspark.sources.sinks import apply_encoding, read_metadata
    assert read_metadata(spark, str(tmp_path)) == {}
    with pytest.raises(Exception):
        read_metadata(spark, str(tmp_path), required=True)
    (tmp_path / "label_encoding.json").write_text('{"dos": 0, "normal": 3}')
    found = read_metadata(spark, f"file://{tmp_path}")
    assert list(found) == ["label_encoding"]
    df = spark.createDataFrame([("dos",), ("normal",), ("other",), (None,)], "name string")
    good, unknown = apply_encoding(df, "name", found["label_encoding"], "code")
    assert {(r["name"], r["code"]) for r in good.collect()} == {("dos", 0), ("normal", 3)}
    assert {r["name"] for r in unknown.collect()} == {"other", None}
