"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, component): the smallest node reachable, for every node of an edge.

    Each step tells every node the smallest label among its neighbours and itself and hangs the old label below the new
    one, so chains halve.  All steps are joins and grouped minima; nothing is collected but the number of changes.
    """
    both = edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = cut(both, "links")
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("component")).withColumnRenamed("a", "node"), "labels")
    while True:
        far = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(far, F.col("node") == F.col("a")).select("node", F.least("component", "near").alias("component"), F.col("component").alias("old"))
        # the old label, itself a node, learns of the smaller one; then every node takes its label's label
        told = step.groupBy(F.col("old").alias("root")).agg(F.min("component").alias("to"))
        hung = step.join(told, F.col("node") == F.col("root"), "left").select("node", F.least("component", "to").alias("component"), "old")
        hung = cut(hung, "labels")
        up = hung.select(F.col("node").alias("root"), F.col("component").alias("to"))
        done = hung.join(up, F.col("component") == F.col("root"), "left").select("node", F.least("component", "to").alias("component"), "old")
        done = cut(done, "labels")
        labels = done.select("node", "component")
        if done.where("component <> old").isEmpty():
            return labels
