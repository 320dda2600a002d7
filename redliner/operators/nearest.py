"""Nearest of many places for every point, on grids whose cells double.

The first grid of a sheet has about one place a cell. A point sees the nine
cells around it; what it finds is its nearest place for certain if no farther away
than a cell is wide. Only the points for which that does not hold look again, on
cells of twice the width. Points far from all places begin with cells as wide as
they are away, so that the rounds grow with the logarithm of what is left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redliner.operators.validate import union_all
from redliner.session import durable, growing

#: most places of a cell that one row holds
LOT = 64


def _cell(c: str, level: str = "level") -> Column:
    return F.floor(F.col(c) / (F.col("__size") * F.pow(F.lit(2.0), F.col(level)))).cast("long")


def nearest_place(points: DataFrame, places: DataFrame, sheet: Sequence[str], point_id: str, place_id: str) -> DataFrame:
    """Every point (sheet keys, ``point_id``, x, y) with ``place_id`` and ``distance`` of its nearest place on the sheet.

    Ties go to the smallest ``place_id``. Points of a sheet without places, or
    with a null coordinate, stay with nulls; places with one do not count. Rows
    that share a ``point_id`` on a sheet are one point, answered by the nearest
    of its positions. No sheet is gathered: points meet places by cell.
    """
    sheet = list(sheet)
    known = F.col("x").isNotNull() & F.col("y").isNotNull()
    at = places.filter(known).select(*sheet, F.col(place_id).alias("__place"), F.col("x").cast("double").alias("__px"), F.col("y").cast("double").alias("__py"))
    grid = durable(at.groupBy(*sheet).agg(
        *[f(f"__p{c}").alias(f"__{n}{c}") for c in "xy" for f, n in ((F.min, "lo"), (F.max, "hi"))], F.count("*").alias("__n")
    ).withColumn("__width", F.greatest(F.col("__hix") - F.col("__lox"), F.col("__hiy") - F.col("__loy"))).withColumn(
        "__size", F.when(F.col("__width") > 0, F.col("__width") / F.sqrt("__n")).otherwise(1.0)))
    at = durable(at.join(grid.select(*sheet, "__size"), sheet))
    # at least this far from all places
    away = [F.greatest(F.col(f"__lo{c}") - F.col(c), F.col(c) - F.col(f"__hi{c}"), F.lit(0.0)) for c in "xy"]
    gap = F.sqrt(away[0] * away[0] + away[1] * away[1])
    start = F.greatest(F.ceil(F.log2(F.greatest(gap, F.col("__size")) / F.col("__size"))), F.lit(0)).cast("int")
    kind = at.schema["__place"].dataType
    none = F.lit(None).cast(f"struct<d:double,place:{kind.simpleString()}>")
    own = points.select(*sheet, F.col(point_id), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).join(grid, sheet, "left")
    lost = F.col("__size").isNull() | ~known
    answers = [own.filter(lost).select(*sheet, point_id, none.alias("best"))]
    looking = own.filter(~lost).select(*sheet, point_id, "x", "y", "__size", start.alias("level"), none.alias("best"))
    steps = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    while not looking.isEmpty():
        # the few places go into the nine cells from which they are seen, so a point looks into its own cell alone
        levels = looking.select(*sheet, "level").distinct()
        around = at.join(levels, sheet).withColumn("__dx", F.explode(steps)).withColumn("__dy", F.explode(steps)).select(
            *sheet, "level", (_cell("__px") + F.col("__dx")).alias("__cx"), (_cell("__py") + F.col("__dy")).alias("__cy"), "__place", "__px", "__py")
        cell = [*sheet, "level", "__cx", "__cy"]
        # a crowded cell is several rows, each of which a point meets as one
        nth = F.row_number().over(Window.partitionBy(*cell).orderBy("__place"))
        lots = around.withColumn("__lot", F.floor((nth - 1) / LOT)).groupBy(*cell, "__lot").agg(F.collect_list(F.struct("__place", "__px", "__py")).alias("__lots"))
        both = looking.withColumns({"__cx": _cell("x"), "__cy": _cell("y")}).join(growing(lots), cell, "left")

        def distance(p: Column) -> Column:
            dx, dy = F.col("x") - p["__px"], F.col("y") - p["__py"]
            return F.struct(F.sqrt(dx * dx + dy * dy).alias("d"), p["__place"].alias("place"))

        found = F.array_min(F.transform("__lots", distance))
        # grouped by cell too: the rows lie by it already
        seen = durable(both.groupBy(*cell, point_id, "x", "y", "__size").agg(F.least(F.min("best"), F.min(found)).alias("best")).drop("__cx", "__cy"))
        safe = F.coalesce(F.col("best.d") <= F.col("__size") * F.pow(F.lit(2.0), F.col("level")), F.lit(False))
        answers.append(seen.filter(safe).select(*sheet, point_id, "best"))
        looking = seen.filter(~safe).withColumn("level", F.col("level") + 1)
    nearest = union_all(answers).groupBy(*sheet, point_id).agg(F.min("best").alias("best"))
    return nearest.select(*sheet, point_id, F.col("best.place").alias(place_id), F.col("best.d").alias("distance"))
