"""Connected components of edge lists, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import checkpointed


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b): component is the smallest node reachable.

    Each round points every node to its smallest neighbour, follows pointers
    to their roots by doubling, and replaces nodes by roots; at least half of
    the nodes that still have edges go each time. All steps are joins and
    partial aggregations of edge lists.
    """
    edges = checkpointed(edges.select("a", "b").filter("a <> b").distinct())
    labels = None
    while not edges.isEmpty():
        up = _both_ways(edges).groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root"))
        up = checkpointed(up)
        while True:
            nxt = up.select(F.col("node").alias("root"), F.col("root").alias("far"))
            jumped = checkpointed(up.join(nxt, "root").select("node", F.col("far").alias("root"), (F.col("far") != F.col("root")).alias("moved")))
            up = jumped.drop("moved")
            if jumped.filter("moved").isEmpty():
                break
        if labels is None:
            labels = up
        else:
            new = up.select(F.col("node").alias("root"), F.col("root").alias("far"))
            labels = checkpointed(labels.join(new, "root", "left").select("node", F.coalesce("far", "root").alias("root")))
        at_a, at_b = up.select(F.col("node").alias("a"), F.col("root").alias("ra")), up.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = edges.join(at_a, "a").join(at_b, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")).filter("a <> b")
        edges = checkpointed(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels.select("node", F.col("root").alias("component"))
