"""Streaming jobs over the event log and the findings, drained into a table in the shared folder and compared with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redliner.catalog.base import Tables, query
from redliner.catalog.operations import calls
from redliner.session import durable_folder
from redliner.streaming import jobs

TS = "%Y-%m-%d %H:%M:%S"


def stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


class Streams(Tables):
    """The same tables as file streams."""

    def __getattr__(self, name: str) -> DataFrame:
        batch = super().__getattr__(name)
        # a pattern, since a stream takes a single file only by one; times of the log are in UTC
        rows = self.spark.readStream.schema(batch.schema).parquet(f"{self.folder}/{name}.parque[t]")
        return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in rows.columns else rows


def streams(t: Tables) -> Streams:
    return Streams(t.spark, t.folder)


def folder(t: Tables) -> str:
    return f"{durable_folder(t.spark)}/redliner-stream-{uuid.uuid4().hex}"


def drained(t: Tables, stream: DataFrame) -> DataFrame:
    """All that the stream yields from the files there are now."""
    place = folder(t)
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{place}/checkpoint").outputMode("append").trigger(availableNow=True).start(f"{place}/rows")
    q.awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{place}/rows")


@query("I1", "SELECT DISTINCT event_type || ':' || user_id AS content_hash FROM events")
def stream_intake_dedupe(t: Tables):
    s = streams(t).events.select("ts", F.concat_ws(":", "event_type", "user_id").alias("content_hash"))
    return drained(t, jobs.dedupe_intake(s, "20000 days").select("content_hash"))


@query("I10", "SELECT event_id, n_name AS version FROM events LEFT JOIN nation ON n_nationkey = user_id % 30")
def stream_enriched(t: Tables):
    log = streams(t).events.select("event_id", (F.col("user_id") % 30).alias("k"))
    registry = t.nation.select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("version"))
    return drained(t, jobs.enriched(log, registry, "k")).select("event_id", "version")


@query("I9", f"""WITH w AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '2000-01-01') AS s, user_id % 10 AS service, count(*) AS n FROM events GROUP BY 1, 2)
SELECT strftime(s, '{TS}') AS window_start, service, n, n AS late FROM w WHERE s + INTERVAL 5 MINUTE > (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def stream_late_rows(t: Tables):
    """Rows of windows that the stream has not closed: those that end after the watermark."""
    counts = drained(t, jobs.error_rate(calls(streams(t)))).select("window_start", "service", F.col("calls").alias("n"))
    recount = calls(t).groupBy(F.window("ts", "5 minutes").alias("w"), "service").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), "service", "n")
    late = jobs.late_rows(recount, counts, ["window_start", "service"])
    return late.select(stamp("window_start").alias("window_start"), "service", "n", "late")


@query("I11", """WITH o AS (SELECT l_partkey % 12 AS rule_id, l_suppkey % 5 AS jurisdiction, l_returnflag <> 'A' AS emitted, l_linenumber % 3 = 0 AS ok, l_partkey % 2 = 0 AS hit FROM lineitem),
c AS (SELECT rule_id, jurisdiction, count_if(emitted) AS emitted, count_if(emitted AND ok) AS approved, count_if(emitted AND hit) AS matched, count_if(NOT emitted) AS missed, count_if(emitted AND NOT hit) AS false_positive FROM o GROUP BY 1, 2)
SELECT rule_id, jurisdiction, emitted, approved, matched, missed, false_positive, round(approved / emitted, 6) AS precision, round(matched / (matched + missed), 6) AS recall FROM c""")
def stream_rule_metrics(t: Tables):
    emitted, hit = F.col("l_returnflag") != "A", F.col("l_partkey") % 2 == 0
    outcomes = streams(t).lineitem.select(
        (F.col("l_partkey") % 12).alias("rule_id"), F.lit("1").alias("rule_version"), (F.col("l_suppkey") % 5).alias("jurisdiction"), emitted.alias("emitted"),
        (emitted & (F.col("l_linenumber") % 3 == 0)).alias("approved"), (emitted & hit).alias("matched"), (~emitted).alias("missed"), (emitted & ~hit).alias("false_positive"))
    place = folder(t)
    jobs.incremental_metrics(outcomes, f"{place}/rows", f"{place}/checkpoint").awaitTermination()
    return jobs.read_metrics(t.spark, f"{place}/rows").select(
        "rule_id", "jurisdiction", "emitted", "approved", "matched", "missed", "false_positive", "precision", "recall")


@query("B2", """WITH s AS (SELECT DISTINCT l_orderkey AS sheet_id, l_suppkey AS project_id FROM lineitem), q AS (SELECT o_orderkey AS sheet_id, o_custkey % 100 AS project_id FROM orders)
SELECT sheet_id, project_id FROM s JOIN q USING (sheet_id, project_id)""")
def sheets_guarded_by_project(t: Tables):
    """Many requests (sheet, project): only sheets that belong to the project that asks."""
    sheets = t.lineitem.select(F.col("l_orderkey").alias("sheet_id"), F.col("l_suppkey").alias("project_id")).distinct()
    asked = t.orders.select(F.col("o_orderkey").alias("sheet_id"), (F.col("o_custkey") % 100).alias("project_id"))
    return sheets.join(asked, ["sheet_id", "project_id"])
