"""Connected components by alternating large and small stars, as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


#: Edges of a partition at least; fewer than that need no exchange at all.
_EDGES = 250_000


def _stars(edges: DataFrame, large: bool, parts: int) -> DataFrame:
    """One step: every node joins its neighbours to its smallest one.

    Large: the neighbours above the node. Small: those below it, and the node itself.
    """
    both = edges.select(F.col("u").alias("n"), F.col("v").alias("w")).unionAll(edges.select(F.col("v"), F.col("u"))).coalesce(parts)
    least = both.groupBy("n").agg(F.least("n", F.min("w")).alias("m"))
    side = both.filter("w > n" if large else "w < n").join(least, "n").select(F.col("w").alias("u"), F.col("m").alias("v"))
    if not large:
        side = side.unionAll(least.select(F.col("n").alias("u"), F.col("m").alias("v")))
    return side.filter("u <> v").coalesce(parts).distinct()


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """node, component (the smallest node that it reaches) for every node of ``edges`` (u, v)."""
    edges = cut(edges.select("u", "v").filter("u <> v").distinct())
    parts = -(-edges.count() // _EDGES) or 1
    state = None
    for _ in range(most_rounds):
        edges = cut(_stars(_stars(edges, True, parts), False, parts))
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            # every edge now joins a node to its component's smallest
            edges = edges.coalesce(parts)
            roots = edges.select(F.col("v").alias("node")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots.withColumn("component", F.col("node")))
        state = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
