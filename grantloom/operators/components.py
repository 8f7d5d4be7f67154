"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantloom.session import settled


def _star(edges: DataFrame) -> DataFrame:
    """Points every neighbour above a node, and the node itself, at the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _fold(edges: DataFrame) -> DataFrame:
    """Points every neighbour below a node, and the node itself, at the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    below = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return below.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _figures(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, label``: the least node of the component of every node.

    ``nodes`` has ``node``; ``edges`` has ``(a, b)``. A round hangs the upper neighbours of each node at its least
    neighbour and then the lower ones; edges stay as many as there were, minima are combined before the shuffle, and a
    node with very many neighbours is a key of a join that can be split. Every round is checkpointed. The rounds end
    when nothing moves, after about the logarithm of the longest path.
    """
    now = edges.where("a is not null and b is not null and a <> b")
    now = settled(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    figures = _figures(now)
    while figures[0]:
        now = settled(_fold(_star(now)))
        moved = _figures(now)
        if moved == figures:
            break
        figures = moved
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
