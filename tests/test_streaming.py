"""Streams over file sources, drained with availableNow and compared with the batch jobs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from redliner.plans import learning, ops
from redliner.streaming import jobs

T0 = dt.datetime(2025, 1, 1)
SCHEMA = "event_id long, ts timestamp, service long, user_id long, failed boolean, latency_ms long, cost_usd double, call_id long, content_hash string"


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    """Calls of two services over five hours in three files, then a far later row that moves the watermark."""
    rows = []
    for i in range(600):
        ts = T0 + dt.timedelta(seconds=30 * i + (i * 7) % 11)
        rows.append((i, ts, i % 2, i % 5, i % 13 == 0 and i < 400, 100 + i * 37 % 900, 0.01 * (i % 9), i % 150, f"h{i % 90}"))
    folder = str(tmp_path_factory.mktemp("log"))
    for part in range(3):
        spark.createDataFrame(rows[part * 200:(part + 1) * 200], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    spark.createDataFrame([(9999, T0 + dt.timedelta(days=3), 7, 99, False, 1, 0.0, 99999, "last")], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return folder, spark.createDataFrame(rows, SCHEMA)


def stream(spark, log):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(log[0])


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return df.sparkSession.table(name)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_error_rate_equals_batch(spark, log):
    got = drain(jobs.error_rate(stream(spark, log)), "err").filter("service < 7")
    want = ops.error_windows(log[1])
    assert rows(got) == rows(want.select(got.columns))
    assert got.filter("alert").count() > 0


def test_latency_p99_close_to_batch(spark, log):
    got = drain(jobs.latency_p99(stream(spark, log)), "p99").filter(F.col("window_start") < "2025-01-02")
    want = log[1].groupBy(F.window("ts", "5 minutes", "1 minute").alias("w")).agg(F.percentile_approx("latency_ms", 0.99, 10_000).alias("p99"), F.count("*").alias("calls"))
    assert rows(got.select("window_start", "p99", "calls")) == rows(want.select("w.start", "p99", "calls"))


def test_dedupe(spark, log):
    got = drain(jobs.dedupe_intake(stream(spark, log), "10 hours"), "dd")
    assert got.count() == 91 and got.select("content_hash").distinct().count() == 91


def test_sessions_equal_batch(spark, log):
    gap = 400
    got = drain(jobs.activity_sessions(stream(spark, log), f"{gap} seconds"), "sess").filter("user_id < 99")
    want = ops.sessions(log[1], "user_id", "ts", "event_id", gap)
    assert rows(got.select("user_id", "started_at", "events")) == rows(want.select("user_id", "started_at", "events"))


def test_overdue(spark, log, tmp_path):
    done = log[1].filter("event_id % 3 = 0").select(F.col("event_id").alias("item_id"), F.expr("ts + INTERVAL 4 MINUTES").alias("ts"))
    late = log[1].filter("event_id % 3 = 1").select(F.col("event_id").alias("item_id"), F.expr("ts + INTERVAL 30 MINUTES").alias("ts"))
    last = spark.createDataFrame([(-1, T0 + dt.timedelta(days=3))], "item_id long, ts timestamp")
    for part in (done.unionByName(late), last):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "done"))
    enqueued = stream(spark, log).select(F.col("event_id").alias("item_id"), "ts")
    completed = spark.readStream.schema("item_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "done"))
    got = drain(jobs.overdue(enqueued, completed), "overdue").filter("item_id < 9999")
    want = ops.overdue(log[1].select(F.col("event_id").alias("item_id"), "ts"), done.unionByName(late))
    assert rows(got.select("item_id")) == rows(want.select("item_id"))


def test_cost_windows_and_anomalies(spark, log):
    got = drain(jobs.cost_windows(stream(spark, log)), "cost").filter("service < 7")
    want = log[1].groupBy(F.window("ts", "1 hour").alias("w"), "service").agg(F.sum(F.col("cost_usd").cast("decimal(18,6)")).alias("c"))
    assert rows(got) == rows(want.select("w.start", "service", "c"))
    kept = spark.createDataFrame(got.collect(), got.schema)  # a memory sink cannot be joined with itself
    flagged = ops.cost_anomalies(kept, ["service"], "window_start", "cost_usd", F.date_trunc("DAY", F.col("window_start")), 0.9, 1)
    assert flagged.filter("anomaly").count() > 0


def test_enrichment(spark, log):
    registry = spark.createDataFrame([(0, "1.4.0"), (1, "1.3.0")], "service long, version string")
    got = drain(jobs.enriched(stream(spark, log), registry, "service"), "rich")
    assert got.filter("version = '1.4.0'").count() == 300 and got.filter("version is null").count() == 1


def test_recoveries_equal_batch(spark, log):
    try:
        got = drain(jobs.recoveries(stream(spark, log).select("event_id", "ts", "service", "failed")), "recov")
    except Exception as e:  # the state server opens a local socket; a sandbox may refuse it
        pytest.skip(f"transformWithState cannot run here: {str(e)[:200]}")
    want = ops.success_streaks(log[1]).filter("recovered_at is not null")
    assert rows(got.filter("service < 7")) == rows(want.select("service", "recovered_at"))


def test_failures_are_routed(spark, log, tmp_path):
    always = log[1].withColumn("failed", F.col("call_id") % 10 == 0)
    src = str(tmp_path / "src")
    always.coalesce(1).write.parquet(src)
    q = jobs.route_failures(spark.readStream.schema(SCHEMA).parquet(src), str(tmp_path / "deferred"), str(tmp_path / "retry"), str(tmp_path / "cp"), 4)
    q.awaitTermination(240)
    got = spark.read.parquet(str(tmp_path / "deferred"))
    assert rows(got.select("call_id")) == rows(ops.deferred_calls(always, 4).select("call_id"))
    assert got.count() == 15


def test_attempts_on_either_side_of_midnight_count_together(spark, tmp_path):
    night = dt.datetime(2025, 1, 1, 23, 59)
    calls = [(i, night + dt.timedelta(minutes=i), 0, 0, True, 1, 0.0, 5, "h") for i in range(3)] + [(9, night, 0, 0, True, 1, 0.0, 6, "h")]
    src, deferred, retry = (str(tmp_path / x) for x in ("src", "deferred", "retry"))
    spark.createDataFrame(calls, SCHEMA).coalesce(1).write.parquet(src)
    jobs.route_failures(spark.readStream.schema(SCHEMA).parquet(src), deferred, retry, str(tmp_path / "cp"), 3).awaitTermination(240)
    assert [r["call_id"] for r in spark.read.parquet(deferred).collect()] == [5]
    assert [r["call_id"] for r in jobs.calls_to_retry(spark.read.parquet(retry), spark.read.parquet(deferred)).collect()] == [6]


def test_incremental_metrics_equal_batch(spark, tmp_path):
    data = spark.range(300).select(
        (F.col("id") % 7).alias("rule_id"), F.lit("1").alias("rule_version"), F.lit("j").alias("jurisdiction"), F.lit(True).alias("emitted"), (F.col("id") % 3 == 0).alias("approved"),
        (F.col("id") % 2 == 0).alias("matched"), F.lit(False).alias("missed"), (F.col("id") % 2 == 1).alias("false_positive"))
    for part in range(2):
        data.filter(F.col("rule_id") % 2 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "o"))
    s = spark.readStream.schema(data.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "o"))
    jobs.incremental_metrics(s, str(tmp_path / "m"), str(tmp_path / "cp")).awaitTermination(240)
    got = jobs.read_metrics(spark, str(tmp_path / "m"))
    want = learning.with_rates(learning.rule_counts(data, ["rule_id", "rule_version", "jurisdiction"]))
    assert rows(got.select(sorted(got.columns))) == rows(want.select(sorted(want.columns)))


def test_late_rows_are_counted(spark):
    b = spark.createDataFrame([(1, 5), (2, 3), (3, 1)], "w long, n long")
    s = spark.createDataFrame([(1, 5), (2, 1)], "w long, n long")
    assert rows(jobs.late_rows(b, s, ["w"]).select("w", "late")) == [(2, 2), (3, 1)]
