"""Connected components by alternating stars, as joins and aggregates over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leakloom.llm import common


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _least(edges: DataFrame, name: str) -> DataFrame:
    """The smallest neighbour of each node, or the node itself."""
    return edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias(name))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around."""
    near = _both_ways(edges)
    joined = near.join(_least(near, "m"), "a").where("b > a")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _least(down, "m")
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select("a", F.col("m").alias("b"))
    return moved.union(own).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """a, root for each node of the edges (a, b) but the roots: root is its component's smallest node.

    Each round shrinks every component's depth; rounds end when the edges are the stars
    that they were before. Neighbours are never gathered: a hub's edges meet its minimum in
    a join, which Spark splits if it is skewed. Every round is a table in the shared folder.
    """
    now = common.saved(edges.where("a <> b").distinct(), "edges")
    mark = None
    while True:
        found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(found) == mark:
            return now.select("a", F.col("b").alias("root"))
        mark = tuple(found)
        after = common.saved(_small_star(_large_star(now)), "edges")
        common.discard(now)
        now = after
