"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import checkpoint


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    linked = down.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node on an edge but the roots themselves; root is the smallest node reachable.

    ``edges`` has long columns a and b, in any order, with repeats and loops allowed. Every round is a few grouped
    minima and joins, checkpointed; a star of any size is pre-aggregated before its shuffle, and adaptive execution
    splits the join on a large centre. Rounds grow with the logarithm of the longest path.
    """
    now = checkpoint(edges.select("a", "b").where("a != b").distinct())
    before = None
    while (mark := _mark(now)) != before:
        before = mark
        now = checkpoint(_small(_large(now)))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
