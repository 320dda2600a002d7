"""Dyadic cells: a range of whole numbers as few aligned power-of-two cells, a number as the cells around it.

Level k has cells of 2^k numbers. A range is the disjoint union of at most two
cells a level; a number lies in exactly one cell of each level. So a number lies
in a range exactly if one of its cells is one of the range's, which makes a range
join an equality join without a row that does not match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _size(level: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), level)


def cover(df: DataFrame, low: Column, high: Column) -> DataFrame:
    """One row per cell (``level``, ``cell``) of those that tile ``[low, high)``; none for an empty range.

    Numbers are whole and at least 0. A cell is at most as large as the range,
    so a row becomes 2 log2(high - low) + 2 rows at most.
    """
    levels = df.withColumns({"__low": low.cast("long"), "__high": high.cast("long")}).filter("__low < __high").withColumn(
        "level", F.explode(F.sequence(F.lit(0), F.floor(F.log2(F.col("__high") - F.col("__low"))).cast("int"))))
    size = _size(F.col("level"))
    # whole cells of this level within the range; those in an even pair belong to a larger cell
    left, right = F.expr("(__low + __size - 1) div __size"), F.expr("__high div __size")
    ends = levels.withColumn("__size", size).withColumns({"__left": left, "__right": right})
    first = F.when((F.col("__left") % 2 == 1) & (F.col("__left") < F.col("__right")), F.col("__left"))
    last = F.when((F.col("__right") % 2 == 1) & (F.col("__left") + F.col("__left") % 2 < F.col("__right")), F.col("__right") - 1)
    return ends.withColumn("cell", F.explode(F.array(first, last))).filter("cell is not null").drop("__low", "__high", "__size", "__left", "__right")


def around(df: DataFrame, number: Column, levels: int | Column, lowest: int | Column = 0) -> DataFrame:
    """One row per cell (``level``, ``cell``) that holds ``number``, from level ``lowest`` to ``levels``; none if that is empty."""
    top, start = (x if isinstance(x, Column) else F.lit(x) for x in (levels, lowest))
    steps = F.when(start <= top, F.sequence(start.cast("int"), top.cast("int")))
    return df.withColumn("__at", number.cast("long")).withColumn("level", F.explode(steps)).withColumn(
        "cell", F.call_function("shiftright", F.col("__at"), F.col("level"))).drop("__at")


def partly(df: DataFrame, low: Column, high: Column, levels: int) -> DataFrame:
    """One row per cell (``level``, ``cell``) that ``[low, high)`` fills in part: the cells around those of ``cover``.

    At most two a level, and each once.
    """
    steps = df.withColumns({"__low": low.cast("long"), "__high": high.cast("long")}).filter("__low < __high").withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    k = F.col("level")
    ends = F.array_distinct(F.array(F.call_function("shiftright", F.col("__low"), k), F.call_function("shiftright", F.col("__high") - 1, k)))
    cells = steps.withColumn("cell", F.explode(ends)).withColumn("__size", _size(k))
    return cells.filter("cell * __size < __low or (cell + 1) * __size > __high").drop("__low", "__high", "__size")
