"""Streaming forms of the log jobs. Each takes and returns a streaming frame unless it starts a query."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def dedupe_intake(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """First document per content hash within the watermark."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["content_hash"])


def error_rate(stream: DataFrame, delay: str = "10 minutes", limit: float = 0.10) -> DataFrame:
    """Error share per 5 minute window and service."""
    per = stream.withWatermark("ts", delay).groupBy(F.window("ts", "5 minutes").alias("w"), "service").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if("failed").alias("errors")
    )
    return per.select(
        F.col("w.start").alias("window_start"), "service", "calls", "errors", (F.col("errors") / F.col("calls") > limit).alias("alert")
    )


def latency_p99(stream: DataFrame, delay: str = "10 minutes", limit_ms: float = 30_000.0) -> DataFrame:
    """Approximate 99th percentile latency over 5 minutes, sliding by one."""
    per = stream.withWatermark("ts", delay).groupBy(F.window("ts", "5 minutes", "1 minute").alias("w")).agg(
        F.percentile_approx("latency_ms", 0.99, 10_000).alias("p99"), F.count(F.lit(1)).alias("calls")
    )
    return per.select(F.col("w.start").alias("window_start"), "p99", "calls", (F.col("p99") > limit_ms).alias("alert"))


def overdue(enqueued: DataFrame, completed: DataFrame, minutes: int = 10, delay: str = "10 minutes") -> DataFrame:
    """Items whose completion did not arrive within the bound.

    ``enqueued``: item_id, ts; ``completed``: item_id, ts.
    """
    e = enqueued.withWatermark("ts", delay).select("item_id", "ts")
    c = completed.select(F.col("item_id").alias("done_item"), F.col("ts").alias("done_at")).withWatermark("done_at", delay)
    bound = F.expr(f"item_id = done_item AND done_at >= ts AND done_at <= ts + INTERVAL {minutes} MINUTES")
    return e.join(c, bound, "left_outer").filter(F.col("done_item").isNull()).select("item_id", "ts")


def activity_sessions(stream: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Reviewer activity sessions."""
    per = stream.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("events"))
    return per.select("user_id", F.col("w.start").alias("started_at"), F.col("w.end").alias("closed_at"), "events")


def cost_windows(stream: DataFrame, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Cost per window and service; compare with ``cost_anomalies`` of the batch jobs."""
    per = stream.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "service").agg(
        F.sum(F.col("cost_usd").cast("decimal(18,6)")).alias("cost_usd")
    )
    return per.select(F.col("w.start").alias("window_start"), "service", "cost_usd")


def enriched(stream: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """Log rows with the registry row of their version. Spark broadcasts the registry when it is small."""
    return stream.join(registry, key, "left")


def late_rows(batch_counts: DataFrame, stream_counts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per window that a batch recount sees and the finalised stream result does not."""
    s = stream_counts.select(*keys, F.col("n").alias("stream_n"))
    both = batch_counts.join(s, keys, "left")
    return both.withColumn("late", F.col("n") - F.coalesce("stream_n", F.lit(0))).filter(F.col("late") > 0)


def _recovery_processor(need: int):
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
    from pyspark.sql.types import LongType, StructField, StructType, TimestampType

    class Recovery(StatefulProcessor):
        """Length of the current success run per service and the time of its last row."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self._streak = handle.getValueState("streak", StructType([
                StructField("n", LongType()), StructField("last", TimestampType())]))

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            n = self._streak.get()[0] if self._streak.exists() else 0
            out = []
            frame = pd.concat(list(rows)).sort_values(["ts", "event_id"])
            for ts, failed in zip(frame["ts"], frame["failed"]):
                n = 0 if failed else n + 1
                if n == need:
                    out.append((key[0], ts))
            self._streak.update((n, frame["ts"].iloc[-1].to_pydatetime()))
            if out:
                yield pd.DataFrame(out, columns=["service", "recovered_at"])

        def close(self) -> None:
            pass

    return Recovery()


def recoveries(stream: DataFrame, need: int = 10) -> DataFrame:
    """Moments at which a service completed ``need`` successes in a row.

    The state is one counter per service; needs the RocksDB state store. Rows of
    one micro-batch are put in time order; ``maxFilesPerTrigger`` bounds them.
    """
    return stream.groupBy("service").transformWithStateInPandas(
        statefulProcessor=_recovery_processor(need), outputStructType="service long, recovered_at timestamp",
        outputMode="Append", timeMode="None",
    )


def failed_attempts(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Attempt counts per call over two days, for use in update mode.

    A new window opens every day, so attempts up to a day apart always share
    one, also across midnight.
    """
    return stream.withWatermark("ts", delay).groupBy("call_id", F.window("ts", "2 days", "1 day").alias("w")).agg(
        F.count_if("failed").alias("failures"), F.count_if(~F.col("failed")).alias("successes"), F.max("ts").alias("last_at")
    ).drop("w")


def route_failures(stream: DataFrame, deferred_path: str, retry_path: str, checkpoint: str, limit: int = 3):
    """Start the query that sends calls with ``limit`` failures to the deferred table and others to the retry table.

    Each micro-batch writes its own folder, so a replayed batch replaces itself.
    A call may stand in retry folders of earlier batches when it is deferred;
    ``calls_to_retry`` leaves it out.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        # of the windows of a call, the one with most failures decides
        per_call = batch.groupBy("call_id").agg(F.max_by(F.struct("failures", "successes", "last_at"), F.struct("failures", "last_at")).alias("w"))
        open_calls = per_call.select("call_id", "w.*").filter(F.col("successes") == 0)
        open_calls.filter(F.col("failures") >= limit).write.mode("overwrite").parquet(f"{deferred_path}/batch={batch_id}")
        open_calls.filter((F.col("failures") > 0) & (F.col("failures") < limit)).write.mode("overwrite").parquet(f"{retry_path}/batch={batch_id}")

    return (
        failed_attempts(stream).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(write).start()
    )


def calls_to_retry(retry: DataFrame, deferred: DataFrame) -> DataFrame:
    """The latest retry row of each call that has not been deferred."""
    latest = retry.groupBy("call_id").agg(F.max_by("failures", "last_at").alias("failures"), F.max("last_at").alias("last_at"))
    return latest.join(deferred.select("call_id").distinct(), "call_id", "left_anti")


def incremental_metrics(stream: DataFrame, path: str, checkpoint: str):
    """Start the query that keeps rule counts per micro-batch; ``read_metrics`` adds them up.

    Counts of a batch overwrite their own folder, which makes a replay harmless.
    """
    from redliner.plans.learning import rule_counts

    def write(batch: DataFrame, batch_id: int) -> None:
        rule_counts(batch, ["rule_id", "rule_version", "jurisdiction"]).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    )


def read_metrics(spark, path: str) -> DataFrame:
    from redliner.plans.learning import with_rates

    names = ["emitted", "approved", "matched", "missed", "false_positive"]
    total = spark.read.parquet(path).groupBy("rule_id", "rule_version", "jurisdiction").agg(*[F.sum(n).alias(n) for n in names])
    return with_rates(total)
