"""Values at most a few edits apart, by the values that deletions leave.

If one text becomes another by d edits, then d deletions at most on either side
leave a text that both share. So both sides are indexed by all texts that up to d
deletions leave, meet by equality, and only what meets is measured. Work grows with
the different values and a power d of their length, not with pairs of values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _left_by_deletions(value: Column, distance: int) -> Column:
    """All texts that up to ``distance`` deletions leave of a text."""
    level = F.array(value)
    found = level
    for _ in range(distance):
        once = lambda w: F.transform(
            F.when(F.length(w) > 0, F.sequence(F.lit(1), F.length(w))).otherwise(F.array().cast("array<int>")),
            lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
        level = F.array_distinct(F.flatten(F.transform(level, once)))
        found = F.concat(found, level)
    return F.array_distinct(found)


def near_values(left: DataFrame, right: DataFrame, block: str, value: str, distance: int = 2) -> DataFrame:
    """(block, ``value``, near, edits): every two different-sided values of a block at most ``distance`` edits apart, equal ones included.

    Rows with a null block or value meet nothing; repeated rows count once.
    """
    def indexed(df: DataFrame, column: str, name: str) -> DataFrame:
        values = df.select(block, F.col(column).alias(name)).dropna().distinct()
        return values.withColumn("__left", F.explode(_left_by_deletions(F.col(name), distance)))

    met = indexed(left, value, value).join(indexed(right, value, "near"), [block, "__left"]).select(block, value, "near").distinct()
    return met.withColumn("edits", F.levenshtein(value, "near", distance)).filter(F.col("edits").between(0, distance))
