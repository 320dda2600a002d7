"""Latest, first, majority and difference operators built on partial aggregation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], newest: Sequence[Column]) -> DataFrame:
    """One row per key: the greatest by ``newest``. Works map-side first, so a hot key is cheap."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in rest])
    best = df.groupBy(*keys).agg(F.max_by(row, F.struct(*newest)).alias("__best"))
    return best.select(*keys, *[F.col("__best")[c].alias(c) for c in rest]).select(*df.columns)


def first_copies(df: DataFrame, key: str, row_id: str) -> DataFrame:
    """Per key the smallest id and the number of copies."""
    return df.groupBy(key).agg(F.min(row_id).alias(f"first_{row_id}"), F.count(F.lit(1)).alias("copies"))


def new_rows(df: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not yet known."""
    return df.join(known.select(*keys).distinct(), list(keys), "left_anti")


def majority(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Most frequent value per key (ties: smallest value), its count and the group size."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(
        F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias("majority_value"),
        F.max("n").alias("majority_n"),
        F.sum("n").alias("total_n"),
    )


def outliers(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows whose value differs from the majority of their group."""
    top = majority(df, keys, value)
    return df.join(top, list(keys), "inner").filter(F.col(value) != F.col("majority_value"))


def changed(old: DataFrame, new: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys of either side with status added, removed, changed or same."""
    a = old.select(*keys, F.col(value).alias("old_value"), F.lit(True).alias("__in_old"))
    b = new.select(*keys, F.col(value).alias("new_value"), F.lit(True).alias("__in_new"))
    both = a.join(b, list(keys), "full_outer")
    status = (
        F.when(F.col("__in_old").isNull(), "added")
        .when(F.col("__in_new").isNull(), "removed")
        .when(F.col("old_value").eqNullSafe(F.col("new_value")), "same")
        .otherwise("changed")
    )
    return both.select(*keys, "old_value", "new_value", status.alias("status"))


def parsed(df: DataFrame, text: str, parser: Callable[[Column], Column], name: str) -> DataFrame:
    """``df`` with ``name``: the parser's value of ``text``, computed once per different text and joined back.

    For costly parsers over columns that repeat. Null texts get null.
    """
    values = df.filter(F.col(text).isNotNull()).select(F.col(text).alias("__text")).distinct()
    values = values.select("__text", parser(F.col("__text")).alias(name))
    return df.join(values, F.col(text) == F.col("__text"), "left").drop("__text")
