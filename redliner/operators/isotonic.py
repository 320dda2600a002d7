"""Isotonic regression of 0/1 outcomes, by lower convex hulls that merge.

The fit at a point is the slope of the greatest convex minorant of the running
sums (weight, outcomes). Corners of a union are corners of its parts, so every
task reduces its points to its own lower hull, the hulls meet in a few parts, and
one last task turns the remaining corners into slopes. Sums of 0/1 outcomes lie on
a lattice, where a convex chain over n outcomes has at most about n^(2/3) corners:
that, and not the number of points, is what the last task reads.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redliner.operators.scan import following, last_value, ordered_scan, running_sum
from redliner.session import durable

#: parts in which the hulls of tasks meet before they meet all together
PARTS = 16
_POINTS = "c double, wu long, su long"


def lower_corners(weights: list[int], sums: list[int]) -> list[int]:
    """Places of the corners of the lower hull of points sorted by weight; exact, points on an edge are left out."""
    chain: list[int] = []
    for i, (w, s) in enumerate(zip(weights, sums, strict=True)):
        while len(chain) > 1:
            a, b = chain[-2], chain[-1]
            if (weights[b] - weights[a]) * (s - sums[a]) - (sums[b] - sums[a]) * (w - weights[a]) > 0:
                break
            chain.pop()
        chain.append(i)
    return chain


def _hull(tables: list[pa.Table]) -> pa.Table:
    """Corners of the lower hull of all rows, in order of weight."""
    rows = pa.concat_tables(tables).sort_by("wu")
    return rows.take(pa.array(lower_corners(rows["wu"].to_pylist(), rows["su"].to_pylist()), pa.int64()))


def _held(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """The hull of a task's rows; batches are folded in one by one."""
    held = None
    for batch in batches:
        if batch.num_rows:
            held = _hull([pa.Table.from_batches([batch]), *([held] if held is not None else [])])
    return held


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if (held := _held(batches)) is not None:
        yield from held.to_batches()


def _slopes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if (held := _held(batches)) is not None:
        origin = pa.table([pa.array([None], pa.float64()), pa.array([0], pa.int64()), pa.array([0], pa.int64())], schema=held.schema)
        held = _hull([origin, held])
        fit = np.diff(held["su"].to_numpy()) / np.diff(held["wu"].to_numpy())
        for batch in pa.table([held["c"].slice(1), pa.array(fit)], names=["c", "fit"]).to_batches():
            yield batch


def isotonic_fit(outcomes: DataFrame, confidence: str = "confidence", kept: str = "kept") -> DataFrame:
    """(confidence, fitted, outcomes) per different confidence; ``fitted`` never decreases.

    ``kept`` is 0 or 1. Rows without confidence or outcome, or with a confidence
    that is no number, take no part; no rows give no fit. A confidence that holds
    most rows is one point after a partial aggregation.
    """
    c = F.col(confidence).cast("double")
    known = outcomes.filter(c.isNotNull() & ~F.isnan(c) & F.col(kept).isNotNull())
    points = known.groupBy(c.alias("c")).agg(F.count(F.lit(1)).alias("w"), F.sum(F.col(kept).cast("long")).alias("s"))
    sums = durable(ordered_scan(points, [], [F.col("c")], None, {"wu": running_sum(F.col("w")), "su": running_sum(F.col("s"))}))
    local = sums.select("c", "wu", "su").mapInArrow(_partial, _POINTS)
    corners = local.repartition(PARTS).mapInArrow(_partial, _POINTS).repartition(1).mapInArrow(_slopes, "c double, fit double")
    marked = sums.select("c", "w").join(corners, "c", "left")
    fitted = ordered_scan(marked, [], [F.col("c")], None, {"later": following(F.col("fit"))})
    return fitted.select(F.col("c").alias("confidence"), F.coalesce("fit", "later").alias("fitted"), F.col("w").alias("outcomes"))


def isotonic_values(df: DataFrame, fit: DataFrame, confidence: str = "confidence", name: str = "prediction") -> DataFrame:
    """``df`` with the fitted value of its confidence in ``name``.

    Between two fitted confidences the value is interpolated, outside of all it
    is that of the nearest; null without a confidence. Each different confidence
    goes through the scan once.
    """
    key = f"__{name}_at"
    asked = df.select(F.col(confidence).cast("double").alias("c")).filter("c is not null and not isnan(c)").distinct().withColumn("f", F.lit(None).cast("double"))
    axis = fit.select(F.col("confidence").alias("c"), F.col("fitted").alias("f")).unionByName(asked).groupBy("c").agg(F.max("f").alias("f"))
    known = F.when(F.col("f").isNotNull(), F.struct("c", "f"))
    scanned = ordered_scan(axis, [], [F.col("c")], None, {"low": last_value(known, inclusive=False), "high": following(known)})
    share = (F.col("c") - F.col("low.c")) / (F.col("high.c") - F.col("low.c"))
    between = F.col("low.f") + share * (F.col("high.f") - F.col("low.f"))
    values = scanned.select(F.col("c").alias(key), F.coalesce("f", between, "low.f", "high.f").alias(name))
    return df.withColumn(key, F.col(confidence).cast("double")).join(values, key, "left").drop(key)
