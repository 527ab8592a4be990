"""Connected components of an edge table, in Spark: smallest label of the neighbours, then pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark_tools import forget, hot_keys, looked_up, written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node in edges (a, b): label is the smallest node that can be reached.

    Each round halves the depth of the label trees, so rounds grow with the logarithm of a component's diameter. Labels
    are written to the shared folder in each round, and those of the last one are deleted. A node's neighbours are reduced by
    min before the shuffle; nodes with very many links and labels of very many nodes are looked up apart (`looked_up`), so
    neither is a hot group."""
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    hubs = hot_keys(both, ["b"])
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = looked_up(both, labels.select(F.col("node").alias("b"), "label"), ["b"], hubs).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = written(labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was")), "lower")
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        new = written(looked_up(lower, up, ["label"], hot_keys(lower, ["label"]), "left").select("node", F.least("label", "above").alias("label"), "was"), "labels")
        forget(labels)
        forget(lower)
        if new.where("label <> was").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")
        labels.written_to = new.written_to
