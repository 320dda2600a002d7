"""As-of and nearest joins without range joins.

Both sides are merged into one ordered stream per key and the latest right row
is carried forward, so the cost is a sort, never a product of the two sides.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redliner.operators.scan import following, last_value, ordered_scan


def _as_struct(df: DataFrame, names: Sequence[str]) -> Column:
    return F.struct(*[F.col(n) for n in names])


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_at: Column,
    right_at: Column,
    take: Sequence[str],
    chunk: Callable[[Column], Column],
    inclusive: bool = True,
) -> DataFrame:
    """Every left row with the columns ``take`` of the latest right row at or before it.

    Right rows that share a position resolve to the greatest ``take`` tuple.
    Left rows without a match keep nulls.
    """
    keys = list(keys)
    left_cols = left.columns
    empty_left = F.lit(None).cast(left.select(_as_struct(left, left_cols).alias("s")).schema["s"].dataType)
    right_type = right.select(_as_struct(right, take).alias("s")).schema["s"].dataType
    events = left.select(
        *keys,
        left_at.alias("__at"),
        F.lit(1 if inclusive else -1).alias("__side"),
        _as_struct(left, left_cols).alias("__left"),
        F.lit(None).cast(right_type).alias("__right"),
    ).unionByName(
        right.select(
            *keys,
            right_at.alias("__at"),
            F.lit(0).alias("__side"),
            empty_left.alias("__left"),
            _as_struct(right, take).alias("__right"),
        )
    )
    scanned = ordered_scan(
        events,
        keys,
        [F.col("__at"), F.col("__side"), F.col("__right")],
        chunk(F.col("__at")),
        {"__hit": last_value(F.col("__right"))},
    )
    found = scanned.filter(F.col("__left").isNotNull())
    return found.select(
        *[F.col("__left")[c].alias(c) for c in left_cols],
        *[F.col("__hit")[c].alias(c) for c in take],
    )


def validity_intervals(
    versions: DataFrame, keys: Sequence[str], start: str, chunk: Callable[[Column], Column]
) -> DataFrame:
    """Half-open validity ``[start, next start)`` per key, open-ended for the newest version.

    Several rows with one start date share their interval.
    """
    at = F.unix_timestamp(F.col(start).cast("timestamp"))
    starts = versions.select(*keys, F.col(start).alias("__start"), at.alias("__t")).distinct()
    # Walking backwards in time makes "next" the value seen last.
    backwards = ordered_scan(
        starts,
        keys,
        [-F.col("__t")],
        chunk(-F.col("__t")),
        {"valid_to": last_value(F.col("__start"), inclusive=False)},
    )
    ends = backwards.select(*keys, F.col("__start").alias(start), "valid_to")
    return versions.join(ends, [*keys, start], "left")


def neighbours_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_at: str,
    right_at: str,
    take: Sequence[str],
    width: float,
) -> DataFrame:
    """Every left row with the right rows next to it along one axis, as ``below`` and ``above``; null where there is none.

    Both are structs of ``take``. A right row at the place of a left one is
    ``below``; of those at one position the smallest tuple counts. Both sides go
    through one scan, forth and back.
    """
    keys = list(keys)
    # one row per position, the smallest tuple of those that share it
    marks = right.groupBy(*keys, F.col(right_at).alias("__at")).agg(F.min(F.struct(*[F.col(c) for c in take])).alias("__mark"))
    own = [c for c in left.columns if c not in keys and c != left_at]
    asked = left.select(*keys, F.col(left_at).alias("__at"), F.lit(1).alias("__side"), *own)
    events = asked.unionByName(marks.withColumn("__side", F.lit(0)), allowMissingColumns=True)
    scanned = ordered_scan(
        events, keys, [F.col("__at"), F.col("__side")], F.floor(F.col("__at") / width),
        {"below": last_value(F.col("__mark")), "above": following(F.col("__mark"))},
    )
    return scanned.filter("__side = 1").withColumnRenamed("__at", left_at).select(*left.columns, "below", "above")


def nearest_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_at: str,
    right_at: str,
    take: Sequence[str],
    width: float,
) -> DataFrame:
    """Every left row with the right row at the smallest distance along one axis.

    Ties go to the lower position, then to the smaller ``take`` tuple. ``take``
    must contain ``right_at``. Left rows need a unique row tuple.
    """
    both = neighbours_join(left, right, keys, left_at, right_at, take, width)
    below, above = F.col("below"), F.col("above")
    d_below = F.abs(F.col(left_at) - below[right_at])
    d_above = F.abs(above[right_at] - F.col(left_at))
    pick = (
        F.when(above.isNull(), below)
        .when(below.isNull(), above)
        .when(d_below <= d_above, below)
        .otherwise(above)
    )
    return both.select(*left.columns, pick.alias("__pick")).select(
        *left.columns, *[F.col("__pick")[c].alias(c) for c in take]
    )
