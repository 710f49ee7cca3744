"""Connected components of a graph whose edges are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioweave.llm.common import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """(a, b) long pairs -> (node, comp), comp being the smallest node reachable.

    Every node points to its smallest neighbour (an aggregate, combined before the
    shuffle, so a hub costs one row per task); pointers are followed to their ends,
    doubling their reach each time; then the nodes of one end become one node and only
    edges between ends remain. Each round at least halves the nodes that have edges.
    Nodes without an edge are not returned; loops, repeated and null edges do no
    harm. Steps are cut by checkpoint(); the driver sees one number per step.
    """
    def ordered(a: str, b: str) -> list:
        return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]

    e = checkpointed(edges.where("a is not null and b is not null and a != b").select(*ordered("a", "b")).distinct())
    labels = None
    while e.limit(1).count():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = checkpointed(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")))
        moved = True
        while moved:
            hop = near.select(F.col("node").alias("root"), F.col("root").alias("next"))
            step = checkpointed(near.join(hop, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
            near, moved = step.select("node", "root"), step.where("moved").limit(1).count()
        first, second = near.toDF("a", "x"), near.toDF("b", "y")
        e = checkpointed(e.join(first, "a").join(second, "b").where("x != y").select(*ordered("x", "y")).distinct())
        labels = near.toDF("node", "comp") if labels is None else checkpointed(
            labels.join(near.toDF("comp", "root"), "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")))
    return labels if labels is not None else e.toDF("node", "comp")
