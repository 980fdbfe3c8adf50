"""Connected components of a table of links, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .common import join_groups

MAX_ROUNDS = 60


def star(edges: DataFrame, large: bool) -> DataFrame:
    """Links every neighbour of a node, and the node, to the least of them.

    The large step moves the greater neighbours of each node, the small step the
    others. A hub's neighbours are joined with its minimum, never gathered.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sided = durable(both if large else both.where("b < a"))
    least = sided.groupBy("a").agg(F.min("b").alias("_least"), F.count(F.lit(1)).alias("_n"))
    least = least.select("a", F.least("a", "_least").alias("_least"), "_n")
    joined = join_groups(sided, least, "a", "_n", sided.count())
    moved = joined.where("b > a" if large else "true").select(
        F.greatest("b", "_least").alias("b"), F.least("b", "_least").alias("a"))
    if not large:
        moved = moved.unionByName(least.select(F.col("a").alias("b"), F.col("_least").alias("a")))
    return moved.where("a <> b").select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the least node it can reach.

    Each round is written down, so a lost executor costs a part of one round. The
    rounds grow with the logarithm of the longest chain.
    """
    current = durable(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                      .where("a <> b").distinct())
    before = None
    for _ in range(MAX_ROUNDS):
        mark = current.select(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        current = durable(star(durable(star(current, True)), False))
    else:
        raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
    return current.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        current.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
