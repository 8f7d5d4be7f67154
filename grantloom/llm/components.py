"""Connected components of an edge table by alternating stars, with each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantloom.llm.common import stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``a, b``; the root is the least node of the component.

    A round points the larger neighbours of every node at its least neighbour (large star), then the smaller ones (small
    star). Edges never become more than nodes plus edges; a node with very many neighbours is only a key of a partial
    minimum and of a join that can be split. Rounds go on until nothing changes, about the logarithm of the diameter.
    """
    now = edges.where("a is not null and b is not null and a <> b")
    now = stored(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        floor = large.groupBy("a").agg(F.min("b").alias("m"))
        inner = large.join(floor, "a")
        small = inner.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(floor.select("a", F.col("m").alias("b"))).distinct()
        now = stored(small, "edges")
        after = _state(now)
        if after == state:
            break
        state = after
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
