"""Connected components of a link table, in Spark rounds over tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from each node of links (a, b); both directions count.

    Each round gives every node the least label among its neighbours and then
    follows labels once (a label is itself a node), so that chains halve.
    """
    edges = materialise(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = materialise(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("component")))
    while True:
        near = edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        hop = labels.join(near, F.col("node") == F.col("a"), "left").select("node", "component", F.least("component", "near").alias("next"))
        ahead = labels.select(F.col("node").alias("at"), F.col("component").alias("ahead"))
        new = materialise(hop.join(ahead, F.col("next") == F.col("at"), "left").select("node", F.least("next", "ahead").alias("component"), (F.least("next", "ahead") != F.col("component")).alias("moved")))
        done = new.where("moved").isEmpty()
        discard(labels)
        labels = new.drop("moved")
        if done:
            discard(edges)
            return labels
