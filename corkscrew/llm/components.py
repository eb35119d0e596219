"""Connected components of an edge table by alternating star contraction.

Each round is two joins and two aggregations over the edges; nothing is
collected. Rounds end when the edges are a forest of stars. Hubs are hot join
keys: both sides of these joins are plain shuffles, which adaptive execution
splits, and minima are pre-aggregated before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark import settle


def _large_star(e: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of its neighbourhood."""
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(e: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    low = e.groupBy("a").agg(F.min("b").alias("m"))
    hang = e.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hang.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def _state(e: DataFrame) -> tuple:
    h = F.xxhash64("a", "b")
    row = e.agg(F.count(F.lit(1)).alias("n"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("s"), F.bit_xor(h).alias("x")).first()
    return tuple(row)


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b; long) that is not
    its component's smallest node. Self-loops, nulls and repeated edges are allowed.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = settle(e, "cc-edges")
    state = _state(e)
    for _ in range(max_rounds):
        if not state[0]:
            break
        e = settle(_small_star(_large_star(e)), "cc-round")
        now = _state(e)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components: no convergence")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
