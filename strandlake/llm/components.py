"""Connected components of an edge table by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``label`` (smallest node reachable) for every node of ``edges``.

    Each round takes the smallest label among a node's neighbours and then the label of that label,
    so chains shorten by halves; a node's neighbours are reduced before the shuffle, so a hub is no hot key.
    """
    both = materialize(edges.select(F.col(a).alias("s"), F.col(b).alias("t")).union(edges.select(F.col(b), F.col(a))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("s").alias("node")).agg(F.least(F.min("s"), F.min("t")).alias("label")), "labels")
    while True:
        around = both.join(labels, both["t"] == labels["node"]).groupBy("s").agg(F.min("label").alias("near"))
        nearer = labels.join(around, labels["node"] == around["s"]).select("node", F.least("label", "near").alias("low"), F.col("label").alias("old"))
        jump = nearer.select(F.col("node").alias("at"), F.col("low").alias("next"))
        new = nearer.join(jump, nearer["low"] == jump["at"]).select("node", F.least("low", "next").alias("label"), "old")
        new = materialize(new, "labels")
        if not new.filter("label != old").limit(1).count():
            return new.select("node", "label")
        labels = new.select("node", "label")
