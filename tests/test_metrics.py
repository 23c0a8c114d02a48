import pytest

from packetspark.operators import metrics as M


def pairs(spark, y, p):
    return spark.createDataFrame(list(zip(y, p)), "label int, prediction int")


def test_multiclass_with_absent_predicted_class(spark):
    y = [0, 0, 0, 1, 1, 3, 3, 3, 3, 4]
    p = [0, 0, 1, 1, 3, 3, 3, 3, 5, 4]
    conf = M.confusion(pairs(spark, y, p))
    assert conf.count() == 25
    cm = {r["class_label"]: r for r in M.class_metrics(conf).collect()}
    assert [cm[c]["precision"] for c in (0, 1, 3, 4, 5)] == pytest.approx([1, .5, .75, 1, 0])
    assert [cm[c]["recall"] for c in (0, 1, 3, 4, 5)] == pytest.approx([2 / 3, .5, .75, 1, 0])
    assert [cm[c]["f1_score"] for c in (0, 1, 3, 4, 5)] == pytest.approx([.8, .5, .75, 1, 0])
    s = M.summary_metrics(conf).first()
    assert (s["precision_macro"], s["recall_macro"], s["f1_macro"], s["accuracy"]) == \
        pytest.approx((.65, .58333, .61, .7), abs=1e-4)


def test_binary_matrix_and_names(spark):
    conf = M.confusion(pairs(spark, [-1, -1, -1, 1, 1], [-1, 1, -1, 1, -1]))
    c = {(r["label"], r["prediction"]): r["n"] for r in conf.collect()}
    assert c == {(-1, -1): 2, (-1, 1): 1, (1, -1): 1, (1, 1): 1}
    cm = {r["class_label"]: r for r in M.class_metrics(conf).collect()}
    assert cm[-1]["precision"] == pytest.approx(2 / 3) and cm[1]["recall"] == pytest.approx(.5)
    b = M.binary_counts(conf).first()
    assert (b["tp"], b["fn"], b["fp"], b["tn"]) == (2, 1, 1, 1)
    compat = M.binary_counts(conf, compat=True).first()
    assert (compat["tn"], compat["tp"]) == (2, 1)


def test_all_normal_gives_full_grid(spark):
    conf = M.confusion(pairs(spark, [1, 1], [1, 1]))
    assert conf.count() == 1   # union of labels is {1}
    b = M.binary_counts(conf).first()
    assert (b["tp"], b["fn"], b["fp"], b["tn"]) == (0, 0, 0, 2)


def test_ranking_with_ties(spark):
    df = spark.createDataFrame(list(zip([.9, .8, .8, .4, .3, .3, .1], [1, 1, 0, 1, 0, 1, 0])), "score double, y01 int")
    assert M.roc_auc(df).first()[0] == pytest.approx(.75)
    assert M.average_precision(df).first()[0] == pytest.approx(.770833, abs=1e-6)


def test_micro_recall_equals_accuracy(spark):
    conf = M.confusion(pairs(spark, [0, 1, 2, 2, 1], [0, 2, 2, 1, 1]))
    rep = {r["row"]: r for r in M.classification_report(conf).collect()}
    acc = rep["accuracy"]["f1_score"]
    w = rep["weighted avg"]["recall"]
    assert acc == pytest.approx(w)


def test_stream_summary(spark):
    df = spark.createDataFrame([(3, 0.9), (1, 0.5), (3, 0.7)], "predicted_label int, confidence double")
    r = M.stream_summary(df).first()
    assert r["n"] == 3 and r["mean_confidence"] == pytest.approx(0.7) and list(r["labels"]) == [1, 3]
