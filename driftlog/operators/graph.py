"""Connected groups of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import kept


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b: long): the least node reachable. Each round takes the least label among a node and its neighbours and then
    the label of that label, so labels travel twice as far from round to round; only minima are gathered."""
    both = kept(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = kept(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels.toDF("b", "near"), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        least = kept(labels.join(near, "node").select("node", F.least("label", "near").alias("to")))
        new = kept(least.join(least.toDF("to", "label"), "to").select("node", "label"))
        changed = new.join(labels.toDF("node", "before"), "node").where("label <> before").limit(1).count()
        labels = new
        if not changed:
            return labels
