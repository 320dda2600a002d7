"""Stored sketches: a row per key and hour that any longer window is put together from.

Quantiles come from KLL sketches, whose rank is off by 2% of the rows at most here,
distinct counts from HyperLogLog sketches, off by some 2% of the count (both with
overwhelming probability, whatever the number of merged hours). Raw rows are read
once; a month is the union of its hours' few kilobytes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: stated errors: of a quantile's rank as part of the rows, of a distinct count as part of it
RANK_ERROR, COUNT_ERROR = 0.02, 0.05


def hourly(rows: DataFrame, keys: Sequence[str], ts: str, value: str, member: str) -> DataFrame:
    """(keys, hour, n, quantiles, members): sketches of a whole-number ``value`` and of different ``member`` per hour.

    Null values and members are not sketched; rows without a time stand under a
    null hour. Sketches of the same hour, say of a late batch, may stand in
    several rows.
    """
    return rows.groupBy(*keys, F.date_trunc("HOUR", ts).alias("hour")).agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_bigint(F.col(value).cast("long")).alias("quantiles"), F.hll_sketch_agg(F.col(member)).alias("members"))


def over(stored: DataFrame, keys: Sequence[str], window: Column, name: str = "window", quantiles: Sequence[float] = (0.5, 0.99)) -> DataFrame:
    """(keys, window, n, p.., distinct): any window over whole hours, from the stored sketches alone.

    A quantile of a window without values is null.
    """
    merged = stored.groupBy(*keys, window.alias(name)).agg(
        F.sum("n").alias("n"), F.kll_merge_agg_bigint("quantiles").alias("__q"), F.hll_union_agg("members").alias("__m"))
    some = F.kll_sketch_get_n_bigint("__q") > 0
    points = [F.when(some, F.kll_sketch_get_quantile_bigint("__q", F.lit(q))).alias(f"p{round(q * 100)}") for q in quantiles]
    return merged.select(*keys, name, "n", *points, F.hll_sketch_estimate("__m").alias("distinct"))
