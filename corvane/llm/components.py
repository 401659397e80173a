"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's least neighbour."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.where("u != v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) for each node of an edge (u, v); root is the least node of its component.

    Each round is written to the shared folder; only a count and a checksum
    come to the driver. A node alone, or tied to itself only, is not returned.
    """
    now = scratch.cut(edges.select("u", "v").where("u != v").distinct(), f"{name}0")
    state, step = None, 0
    while True:
        step += 1
        after = scratch.cut(_small_star(_large_star(now)), f"{name}{step}")
        told = after.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == tuple(told):
            return after.select(F.col("u").alias("node"), F.col("v").alias("root"))
        if step > 1:
            scratch.drop(f"{name}{step - 1}")
        now, state = after, tuple(told)
