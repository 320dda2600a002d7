"""Shortest paths by repeated edge relaxation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redliner.session import durable


def shortest_to_sources(
    edges: DataFrame, sources: DataFrame, sheet: Sequence[str]
) -> DataFrame:
    """Distance of every node to its nearest source, per sheet.

    ``edges`` has the sheet keys, ``a``, ``b`` and ``length``, read in both
    directions; ``sources`` has the sheet keys and ``node``. Only nodes that
    improved in the last round are relaxed again, each round is checkpointed,
    and the loop ends when nothing improves, however long the paths are. That
    happens for lengths that are not negative; a negative one is an error.
    Unreachable nodes do not appear.
    """
    sheet = list(sheet)
    both = edges.select(*sheet, "a", "b", "length").unionByName(
        edges.select(*sheet, F.col("b").alias("a"), F.col("a").alias("b"), "length")
    )
    # read by every round, so it is computed once
    steps = durable(both.groupBy(*sheet, "a", "b").agg(F.min("length").alias("length")))
    best = durable(
        sources.select(*sheet, "node").distinct().withColumn("distance", F.lit(0.0)).withColumn("fresh", F.lit(True))
    )
    if not steps.filter("length < 0").isEmpty():
        raise ValueError("edge lengths must not be negative")
    while True:
        moved = best.filter("fresh").join(steps.withColumnRenamed("a", "node"), [*sheet, "node"], "inner").select(
            *sheet, F.col("b").alias("node"), (F.col("distance") + F.col("length")).alias("distance"), F.lit(None).cast("double").alias("old")
        )
        # one aggregation keeps the shortest of the old distance and all offers
        both = best.select(*sheet, "node", "distance", F.col("distance").alias("old")).unionByName(moved)
        shortest = both.groupBy(*sheet, "node").agg(F.min("distance").alias("distance"), F.min("old").alias("old"))
        best = durable(shortest.withColumn("fresh", F.col("old").isNull() | (F.col("distance") < F.col("old"))).drop("old"))
        if best.filter("fresh").isEmpty():
            return best.drop("fresh")
