"""Fold arithmetic and bounded label samples shared by the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5
HELD_OUT = 0
CALIBRATION = 1


def fold(id: Column) -> Column:
    """crc32 of the id as text, modulo the number of folds; -1 for a null id."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % FOLDS, F.lit(-1)).cast("int")


def labelled(labels: DataFrame, label: str, id: str = "doc_id") -> DataFrame:
    """(id, label, fold) of all labelled ids outside of the held-out fold.

    Null ids and labels are left out; an id labelled twice counts once, with its largest label.
    """
    known = labels.select(F.col(id).cast("long").alias("id"), F.col(label).cast("int").alias("label")).dropna()
    known = known.groupBy("id").agg(F.max("label").alias("label")).withColumn("fold", fold(F.col("id")))
    return known.filter(F.col("fold") != HELD_OUT)


def label_sample(labels: DataFrame, label: str, limit: int, id: str = "doc_id") -> DataFrame:
    """At most ``limit`` rows of ``labelled``, in a fixed random order."""
    return labelled(labels, label, id).orderBy(F.xxhash64("id"), "id").limit(limit)


def one_per_id(rows: DataFrame, *payload: str) -> DataFrame:
    """(id, label, fold, payload): of every id the row of the least payload hash, ties to the least payload.

    A partial aggregation, so that an id with a third of all rows leaves one row per task.
    """
    return (rows.groupBy("id", "label", "fold").agg(F.min(F.struct(F.xxhash64(*payload).alias("__tie"), *payload)).alias("__row"))
            .select("id", "label", "fold", *[F.col("__row")[c].alias(c) for c in payload]))
