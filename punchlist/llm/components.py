"""Connected components of an edge table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) for every node of ``edges``; ``comp`` is the smallest node that is reachable.

    Each round hands every node the smallest label of its neighbours, then follows labels of labels, so that long chains
    take a number of rounds that grows with the logarithm of their length. Every round is a written table: no lineage grows,
    nothing but a count of changes reaches the driver. Joins have two stored sides, so that AQE can split a node with very
    many neighbours. Rows whose ends are equal or null say nothing.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = written(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))), "edges")
    labels = written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("comp")), "labels")
    while True:  # labels only get smaller, so it ends
        near = both.join(labels, both.u == labels.node).groupBy("v").agg(F.min("comp").alias("near"))
        lower = labels.join(near, labels.node == near.v, "left").select("node", F.col("comp").alias("was"), F.least("comp", F.coalesce("near", "comp")).alias("comp"))
        lower = written(lower, "labels")
        jump = lower.select(F.col("node").alias("at"), F.col("comp").alias("further"))
        labels = written(lower.join(jump, lower.comp == jump["at"], "left").select("node", "was", F.least("comp", F.coalesce("further", "comp")).alias("comp")), "labels")
        if labels.where("comp <> was").isEmpty():
            return labels.select("node", "comp")
        labels = labels.select("node", "comp")
