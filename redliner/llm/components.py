"""Connected components of a distributed edge list by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redliner.session import durable


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction of (u, v) edges; ``large`` joins every larger neighbour to the least one, else the smaller ones.

    Only the least neighbour of each node is aggregated and joined back, so the
    edges of a hub are never gathered.
    """
    # each node with the neighbours that count: all of them, or only the smaller ones
    near = edges.union(edges.select("v", "u")).toDF("u", "v") if large else edges
    # written, so that the join below is one that Spark can split at a hub
    least = durable(near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("center"), F.least("u", "m").alias("m")))
    met = near.join(least, near["u"] == least["center"])
    if large:
        return met.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    # v hangs below m, and so does u itself
    down = met.select("v", "m").toDF("u", "v")
    return down.union(least.select("center", "m").toDF("u", "v"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one other, which hangs on none."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(
        edges.select("v", F.lit(0), F.lit(1)))
    node = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return node.filter((F.col("below") > 1) | ((F.col("below") > 0) & (F.col("above") > 0))).isEmpty()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): for every node of the edges the least node that it can reach.

    Edges may repeat, point either way, loop or hold nulls (such edges count
    for nothing). Every round halves the depth of the trees, and each round's
    edges are written to the shared folder. The loop ends when all edges are
    stars around the least node of their component.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    state = durable(pairs)
    while not _are_stars(state):
        # both contractions keep (u, v) with u > v after orientation
        turned = _star(state, large=True).filter("u <> v").distinct()
        turned = _star(turned, large=False).filter("u <> v").distinct()
        state = durable(turned)
    roots = state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
