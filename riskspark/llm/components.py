"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def stars(edges: DataFrame) -> DataFrame:
    """Edges (a, b), a > b, such that every node hangs directly on the least node of its component.

    Alternates large-star and small-star steps: neighbours above a node are hung on the least of its neighbourhood, then
    those below. Each step is a minimum for each node, written to the shared folder, and a join of edges with it; a node with very
    many edges is met in a join only, whose large partitions Spark can split. The tables grow with the graph and hold few distinct values, so that their
    files are far smaller than their rows: by its size a file would still be broadcast where its rows don't fit the driver. Hence joins by merging.
    """

    def hung(pairs: DataFrame, tag: str) -> DataFrame:
        """Of pairs (u, v): each v, and u, on the least of v and u for that u."""
        least = saved(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{tag}-least")
        moved = pairs.join(least.hint("merge"), "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        own = least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        return moved.unionByName(own).where("a > b").distinct()

    before = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = saved(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "large-least")
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = saved(large, "large")
        edges = saved(hung(large.select(F.col("a").alias("u"), F.col("b").alias("v")), "small"), "small")
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            return edges
        before = state


def with_component(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes, which have a column node, with root: the least node of the component. edges: (a, b) with a > b, saved; may be empty."""
    if edges.isEmpty():
        return nodes.withColumn("root", F.col("node"))
    hung = stars(edges)
    return nodes.join(hung.select(F.col("a").alias("node"), F.col("b").alias("root")).hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
