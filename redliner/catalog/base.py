"""Registry and table access for the query catalog."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from redliner.session import spread, workers_find_package

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


# a well spread column of each larger table
KEYS = {
    "orders": "o_orderkey", "lineitem": "l_orderkey", "documents": "doc_id", "pages": "page_id", "events": "event_id",
    "conversations": "conv_id", "part": "p_partkey", "customer": "c_custkey", "embeddings": "vec_id",
}


class Tables:
    """Lazy access to the parquet tables of one scale folder."""

    def __init__(self, spark: SparkSession, folder: str):
        # window starts and dates are read in UTC, whatever zone the session came with
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        workers_find_package(spark)
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


    def busy(self, name: str, *columns: str) -> DataFrame:
        """A table for CPU-heavy row work: only ``columns`` when given, split over all cores."""
        df = getattr(self, name)
        return spread(df.select(*columns) if columns else df, KEYS[name])


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ids: tuple[str, ...]


REGISTRY: dict[str, Query] = {}


def query(ids: str, sql: str | None = None):
    """Register ``fn(tables)`` under its own name; ``ids`` lists the inventory rows it covers."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if fn.__name__ in REGISTRY:
            raise ValueError(f"{fn.__name__} is registered twice")
        REGISTRY[fn.__name__] = Query(
            fn.__name__, lambda spark, folder: fn(Tables(spark, folder)), sql, tuple(ids.split())
        )
        return fn

    return wrap
