"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from squadlake.llm.shared import Scratch

MAX_ROUNDS = 60  # rounds grow with the logarithm of the longest chain


def _linked_to_least(neighbours: DataFrame, larger: bool) -> DataFrame:
    """Connect each node's neighbours (all, or those that are larger) with its least
    neighbour.  The least one is aggregated and joined back, so a node with very
    many neighbours is a skewed join's key, not one task's group."""
    least = neighbours.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = neighbours.join(least, "u")
    if larger:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) for every node of ``edges`` (u, v: long): the least node it reaches."""
    down = scratch.keep(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    for _ in range(MAX_ROUNDS):
        both = down.union(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = scratch.keep(_linked_to_least(both, True).where("u <> v").distinct(), "large")
        down = scratch.keep(_linked_to_least(large, False).where("u <> v").distinct(), "small")
        now = down.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return down.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
        down.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
