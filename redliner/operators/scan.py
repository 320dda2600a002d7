"""Ordered scans over groups of any size.

A plain window puts a whole group into one task. Here each group is cut into
chunks of its own ordering: windows run inside a chunk, one summary row per
chunk is built with partial aggregation, a second window runs over the few
summaries of a group, and its result is joined back as the chunk's offset.
Chunks are a function of the row alone, so a recomputed task gives the same
answer. Where no column spreads a hot group well, ``equi_depth`` cuts the whole
ordering into chunks of about equal size.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redliner.session import dense, durable, growing

#: chunk column of ``equi_depth``
DEPTH = "__depth"


@dataclass(frozen=True)
class Step:
    """One scanned output column."""

    kind: str
    value: Column | None = None
    inclusive: bool = True


def position() -> Step:
    """1-based position in the group."""
    return Step("position")


def running_sum(value: Column, inclusive: bool = True) -> Step:
    """Sum so far; 0 before the first row."""
    return Step("sum", value, inclusive)


def running_max(value: Column, inclusive: bool = True) -> Step:
    return Step("max", value, inclusive)


def last_value(value: Column, inclusive: bool = True) -> Step:
    """Latest non-null value so far."""
    return Step("last", value, inclusive)


def next_value(value: Column) -> Step:
    """Value of the row after this one; the value must not be null."""
    return Step("next", value, False)


def following(value: Column) -> Step:
    """First non-null value after this row."""
    return Step("following", value, False)


def every(column: Column, width: int) -> Column:
    """Chunk number for an integer or fractional ordering column."""
    return F.floor(column / width)


def by_day(column: Column) -> Column:
    return F.date_trunc("DAY", column)


def by_month(column: Column) -> Column:
    return F.date_trunc("MONTH", column)


def equi_depth(df: DataFrame, keys: Sequence[str], order: Sequence[Column], parts: int | None = None) -> DataFrame:
    """Rows with a chunk number in ``__depth`` that follows keys and order, in chunks of about equal size.

    Splitters come from Spark's own sample of the keys and the whole order, so
    rows of one key and day, or of one confidence, are cut apart by what orders
    them further. The result is written: its chunks stay what they are whoever
    reads it, and however often. ``parts``: number of chunks, by default that of
    the session's shuffle partitions, fewer for little data.
    """
    by = [*[F.col(k) for k in keys], *order]
    ranged = df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)
    return durable(ranged.withColumn(DEPTH, F.spark_partition_id()))


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    chunk: Column | None,
    steps: Mapping[str, Step],
) -> DataFrame:
    """Add one column per step, computed along ``order`` inside each group of ``keys``.

    ``chunk`` must not decrease along ``order``; keys and chunk must not be
    null. ``order`` is ascending and should be total. Without a chunk the rows
    are cut by ``equi_depth``.
    """
    keys = list(keys)
    if chunk is None:
        return ordered_scan(equi_depth(df, keys, order), keys, order, F.col(DEPTH), steps).drop(DEPTH)
    # said here and not left to the join below, so that both of its sides read one and the same exchange
    whole = F.lit(True)
    for k in [*keys, "__chunk"]:
        whole = whole & F.col(k).isNotNull()
    named = df.withColumn("__chunk", chunk).filter(whole)
    order_names = []
    for i, column in enumerate(order):
        named = named.withColumn(f"__o{i}", column)
        order_names.append(f"__o{i}")
    for name, step in steps.items():
        if step.value is not None:
            named = named.withColumn(f"__v_{name}", step.value)

    inside = Window.partitionBy(*keys, "__chunk").orderBy(*order_names)
    frames = {
        True: inside.rowsBetween(Window.unboundedPreceding, 0),
        False: inside.rowsBetween(Window.unboundedPreceding, -1),
    }
    backwards = Window.partitionBy(*keys, "__chunk").orderBy(*[F.desc(o) for o in order_names]).rowsBetween(Window.unboundedPreceding, -1)
    local, summary = {}, []
    for name, step in steps.items():
        value = F.col(f"__v_{name}")
        frame = frames[step.inclusive]
        if step.kind == "position":
            local[name] = F.row_number().over(inside).cast("long")
            summary.append(F.count(F.lit(1)).alias(f"__s_{name}"))
        elif step.kind == "sum":
            local[name] = F.coalesce(F.sum(value).over(frame), F.lit(0))
            summary.append(F.coalesce(F.sum(value), F.lit(0)).alias(f"__s_{name}"))
        elif step.kind == "max":
            local[name] = F.max(value).over(frame)
            summary.append(F.max(value).alias(f"__s_{name}"))
        elif step.kind == "last":
            local[name] = F.last(value, ignorenulls=True).over(frame)
            at = F.when(value.isNotNull(), F.struct(*order_names))
            summary.append(F.max_by(value, at).alias(f"__s_{name}"))
        elif step.kind == "next":
            local[name] = F.lead(value).over(inside)
            summary.append(F.min_by(value, F.struct(*order_names)).alias(f"__s_{name}"))
        elif step.kind == "following":
            # read backwards, where the frame only grows
            local[name] = F.last(value, ignorenulls=True).over(backwards)
            summary.append(F.min_by(value, F.when(value.isNotNull(), F.struct(*order_names))).alias(f"__s_{name}"))
        else:
            raise ValueError(step.kind)

    across = Window.partitionBy(*keys) if keys else Window.partitionBy()
    before = across.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = named.groupBy(*keys, "__chunk").agg(*summary)
    lifted = []
    for name, step in steps.items():
        s = F.col(f"__s_{name}")
        if step.kind in ("position", "sum"):
            lifted.append(F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"__f_{name}"))
        elif step.kind == "max":
            lifted.append(F.max(s).over(before).alias(f"__f_{name}"))
        elif step.kind == "next":
            lifted.append(F.lead(s).over(across.orderBy("__chunk")).alias(f"__f_{name}"))
        elif step.kind == "following":
            lifted.append(F.last(s, ignorenulls=True).over(across.orderBy(F.desc("__chunk")).rowsBetween(Window.unboundedPreceding, -1)).alias(f"__f_{name}"))
        else:
            lifted.append(F.last(s, ignorenulls=True).over(before).alias(f"__f_{name}"))
    offsets = offsets.select(*keys, "__chunk", *lifted)

    scanned = named.select("*", *[c.alias(f"__l_{n}") for n, c in local.items()])
    # the rows lie by keys and chunk already, so only the offsets move
    joined = scanned.join(growing(offsets), [*keys, "__chunk"], "inner")
    results = []
    for name, step in steps.items():
        here, offset = F.col(f"__l_{name}"), F.col(f"__f_{name}")
        if step.kind in ("position", "sum"):
            results.append((here + offset).alias(name))
        elif step.kind == "max":
            results.append(F.greatest(here, offset).alias(name))
        else:
            results.append(F.coalesce(here, offset).alias(name))
    kept = [c for c in df.columns if c not in steps]
    return joined.select(*kept, *results)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """``ordered_scan`` with one ``position`` and no chunk, for wide rows: they move once.

    Rows are range-partitioned and sorted by keys and order, numbered in passing
    and written. Only the first group of a partition can go on from the ones
    before, so what is joined back has at most a row for each partition.
    """
    keys, whole = list(keys), F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    by = [*[F.col(k) for k in keys], *order]
    rows = df.drop(name).filter(whole).repartitionByRange(*by).sortWithinPartitions(*by)
    # the counter starts anew with each group and sees nothing but the keys
    counted = rows.withColumn(DEPTH, F.spark_partition_id()).withColumn("__local", _counter(len(keys))(*keys))
    written = dense(counted)
    sizes = written.groupBy(*keys, DEPTH).agg(F.max("__local").alias("__n"))
    before = Window.partitionBy(*keys).orderBy(DEPTH).rowsBetween(Window.unboundedPreceding, -1)
    offsets = durable(sizes.select(*keys, DEPTH, F.sum("__n").over(before).alias("__before")).filter(F.col("__before").isNotNull()))
    joined = written.join(F.broadcast(offsets), [*keys, DEPTH], "left")
    return joined.select(*[c for c in df.columns if c != name], (F.col("__local") + F.coalesce("__before", F.lit(0))).alias(name))


def _counter(width: int):
    """Positions from 1 within runs of equal values of ``width`` columns, over all batches of a task."""

    def count(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        last, n = None, 0
        for batch in batches:
            if not len(batch[0]):
                yield pd.Series([], dtype="int64")
                continue
            starts = np.zeros(len(batch[0]), bool)
            for values in batch:
                values = values.to_numpy()
                starts[1:] |= (values[1:] != values[:-1]) & ~((values[1:] != values[1:]) & (values[:-1] != values[:-1]))
            first = tuple(values.iloc[0] for values in batch)
            starts[0] = last is None or any(a != b and (a == a or b == b) for a, b in zip(first, last, strict=True))
            at = np.arange(len(starts))
            begun = np.maximum.accumulate(np.where(starts, at, -1))
            position = np.where(begun < 0, n + at + 1, at - begun + 1)
            last, n = tuple(values.iloc[-1] for values in batch), int(position[-1])
            yield pd.Series(position)

    return F.pandas_udf(count, "long").asNondeterministic()


def paged(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    chunk: Column,
    item: Column,
    page_size: int = 500,
    name: str = "items",
) -> DataFrame:
    """Nest the rows of each group into arrays of at most ``page_size`` items.

    ``part``, from 1, is a key of every result, whatever the size of a group: a
    small group has part 1 only, a large one as many parts as it needs, so no
    row and no task grows with the group.
    """
    numbered = ordered_scan(df.withColumn("__item", item), keys, order, chunk, {"__n": position()})
    page = numbered.withColumn("part", F.floor((F.col("__n") - 1) / page_size) + 1)
    nested = page.groupBy(*keys, "part").agg(
        F.array_sort(F.collect_list(F.struct(F.col("__n").alias("n"), F.col("__item").alias("item")))).alias("__p")
    )
    return nested.select(*keys, "part", F.transform("__p", lambda x: x["item"]).alias(name))
