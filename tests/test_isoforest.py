import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from packetspark.operators import isoforest as IF


def test_c_factor():
    assert IF.c_factor([1, 2])[0] == 0 and IF.c_factor([2])[0] == 1
    assert IF.c_factor([256])[0] == pytest.approx(2 * (np.log(255) + 0.5772156649) - 2 * 255 / 256)


def test_fixed_tree_path_length(spark):
    # root splits feature 0 at 0.5; left is a leaf of 1, right a leaf of 3 rows
    trees = spark.createDataFrame([(0, 0, 0, 0.5, 1, 2, 4, 0), (0, 1, -1, 0.0, -1, -1, 1, 1),
                                   (0, 2, -1, 0.0, -1, -1, 3, 1)], IF.TREE_SCHEMA)
    m = IF.IsolationForestModel(trees, ["a"], psi=4, n_trees=1)
    df = spark.createDataFrame([(0, 0.1), (1, 0.9)], "event_id long, a double")
    s = {r["event_id"]: r["score"] for r in IF.score(m, df).collect()}
    c4 = IF.c_factor([4])[0]
    assert s[0] == pytest.approx(-2 ** (-1.0 / c4))
    assert s[1] == pytest.approx(-2 ** (-(1.0 + IF.c_factor([3])[0]) / c4))


def test_planted_outliers_score_lowest(spark):
    rng = np.random.default_rng(1)
    n = 3000
    x = rng.normal(size=(n, 3))
    x[:15] += 12
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(event_id=np.arange(n))
    df = spark.createDataFrame(pdf)
    m = IF.fit(df, ["a", "b", "c"], n_trees=50, seed=42)
    assert m.psi == 256 and m.trees.select("tree_id").distinct().count() == 50
    assert m.trees.groupBy("tree_id").agg(F.max("n")).first()[1] <= 256
    low = IF.score(m, df).orderBy("score").limit(15).select("event_id").collect()
    assert {r[0] for r in low} == set(range(15))


def test_contamination_flip(spark):
    df = spark.createDataFrame([(-1,)] * 6 + [(1,)] * 4, "y int")
    c = IF.contamination(df)
    assert c["flipped"] and c["contamination"] == pytest.approx(.4)


def test_threshold_sweep_picks_best(spark):
    rows = [(-1, -0.9 + i * 0.001) for i in range(50)] + [(1, -0.3 + i * 0.001) for i in range(450)]
    df = spark.createDataFrame(rows, "y int, score double")
    sw = IF.threshold_sweep(df, "y", "score", min_precision=0.1)
    assert sw.count() == 46
    best = sw.where("selected").first()
    assert best["percentile"] == 10.0 and best["f1_macro"] == pytest.approx(1.0)


def test_trees_do_not_depend_on_order_or_partitions(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame(rng.integers(0, 9, (400, 3)), columns=["a", "b", "c"]).assign(event_id=np.arange(400))
    trees = [IF.fit(spark.createDataFrame(rows).repartition(parts), ["a", "b", "c"], n_trees=5, max_samples=64).trees.toPandas()
             .sort_values(["tree_id", "node_id"]).reset_index(drop=True)
             for rows, parts in ((pdf, 1), (pdf.iloc[::-1], 7))]
    pd.testing.assert_frame_equal(*trees)
    inner = trees[0][trees[0].feature >= 0]
    sizes = trees[0].set_index(["tree_id", "node_id"]).n
    for t in inner.itertuples():
        assert sizes[t.tree_id, 2 * t.node_id] + sizes[t.tree_id, 2 * t.node_id + 1] == t.n
        assert sizes[t.tree_id, 2 * t.node_id] > 0 and sizes[t.tree_id, 2 * t.node_id + 1] > 0


def test_rows_walk_the_trees_as_in_a_loop():
    """iforest_search, fault_evaluation_anomaly: leaves of any depth, missing values, a tree that is one leaf."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 4))
    x[3, 1] = np.nan
    nodes = []
    for t, (n, depth) in enumerate(((64, 6), (200, 3), (1, 8))):
        nodes += [(t, *node) for node in IF._grow(x[10:10 + n], 5, t, depth)]
    pdf = pd.DataFrame(nodes, columns=["tree_id", "node_id", "feature", "threshold", "left", "right", "n", "depth"])

    class Trees:
        def toPandas(self):
            return pdf
    arrays = IF._tree_arrays(Trees())
    assert len(arrays) == 3 and all(len(tree) == 5 for tree in arrays)
    for t, tree in enumerate(arrays):
        at = {r.node_id: r for r in pdf[pdf.tree_id == t].itertuples()}
        want = []
        for row in x:
            r = at[1]
            while r.feature >= 0:
                r = at[r.left if row[r.feature] < r.threshold else r.right]
            want.append(r.depth + IF.c_factor([r.n])[0])
        assert IF._path_lengths(x, tree).tolist() == want
