"""Operations, audit and log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from redliner.catalog import adapters as a
from redliner.catalog.base import Tables, query
from redliner.functions import text as x  # noqa: F401
from redliner.operators import sketches
from redliner.operators import validate as v
from redliner.operators.fuzzy import near_values
from redliner.operators.scan import by_month
from redliner.plans import ops
from redliner.session import durable

TS = "%Y-%m-%d %H:%M:%S"


def stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def calls(t: Tables):
    """events as call log: user modulo 10 is the service, errors failed, value is latency in 0.01 s."""
    return t.events.select(
        "event_id", "ts", (F.col("user_id") % 10).alias("service"), (F.col("event_type") == "error").alias("failed"),
        F.round(F.col("value") * 100).cast("long").alias("latency_ms"), (F.col("event_id") % 4000).alias("tokens_in"), (F.col("event_id") % 700).alias("tokens_out"),
        a.pick(["small", "large", "other"], F.col("user_id")).alias("model"), "user_id")


SQL_CALLS = """c AS (SELECT event_id, ts, user_id % 10 AS service, event_type = 'error' AS failed, round(value * 100)::BIGINT AS latency_ms, event_id % 4000 AS tokens_in, event_id % 700 AS tokens_out,
  (['small', 'large', 'other'])[user_id % 3 + 1] AS model, user_id FROM events),
pr AS (SELECT * FROM (VALUES ('small', 1::DECIMAL(9,2), 5::DECIMAL(9,2)), ('large', 3::DECIMAL(9,2), 15::DECIMAL(9,2))) t(model, pi, po)),
k AS (SELECT c.*, round((tokens_in * pi + tokens_out * po) / 1000000, 6) AS cost FROM c LEFT JOIN pr USING (model))"""


def priced_calls(t: Tables):
    prices = t.spark.createDataFrame([("small", 1, 5), ("large", 3, 15)], "model string, price_in int, price_out int")
    return ops.priced(calls(t), prices)


@query("D14 M26", f"""WITH {SQL_CALLS} SELECT service, model, count(*) AS calls, round(sum(cost)::DOUBLE, 6) AS cost_usd, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out, round(avg(latency_ms), 4) AS mean_latency,
  round(quantile_cont(latency_ms, 0.99), 4) AS p99_latency FROM k GROUP BY 1, 2""")
def call_stats(t: Tables):
    s = ops.call_stats(priced_calls(t), ["service", "model"])
    return s.select("service", "model", "calls", F.round(F.col("cost_usd").cast("double"), 6).alias("cost_usd"), "tokens_in", "tokens_out",
                    F.round("mean_latency", 4).alias("mean_latency"), F.round("p99_latency", 4).alias("p99_latency"))


@query("D14 D26 I3", f"""WITH {SQL_CALLS} SELECT service, strftime(date_trunc('month', ts), '%Y-%m') AS month, count(*) AS n, true AS p50_within, true AS p99_within, true AS distinct_within FROM c GROUP BY 1, 2""")
def call_sketches(t: Tables):
    """Months put together from hourly sketches, each held against the raw rows within the stated errors."""
    log = calls(t)
    stored = durable(sketches.hourly(log, ["service"], "ts", "latency_ms", "user_id"))
    months = sketches.over(stored, ["service"], F.date_trunc("MONTH", "hour"), "month")
    raw = log.withColumn("month", F.date_trunc("MONTH", "ts")).join(months, ["service", "month"])
    exact = raw.groupBy("service", "month", "n", "p50", "p99", "distinct").agg(
        F.count_distinct("user_id").alias("users"), *[f(F.col("latency_ms"), F.col(p)).alias(f"{p}_{s}") for p in ("p50", "p99")
        for s, f in (("below", lambda v, q: F.count_if(v < q)), ("upto", lambda v, q: F.count_if(v <= q)))])
    rank = lambda p, q: (F.col(f"{p}_below") <= (q + sketches.RANK_ERROR) * F.col("n")) & (F.col(f"{p}_upto") >= (q - sketches.RANK_ERROR) * F.col("n"))
    return exact.select("service", F.date_format("month", "yyyy-MM").alias("month"), "n", rank("p50", 0.5).alias("p50_within"), rank("p99", 0.99).alias("p99_within"),
                        (F.abs(F.col("distinct") - F.col("users")) <= F.greatest(sketches.COUNT_ERROR * F.col("users"), F.lit(1))).alias("distinct_within"))


@query("D15 M26", f"""WITH {SQL_CALLS}, p AS (SELECT user_id AS project_id, (['ingestion', 'measurement', 'review', 'drafting'])[service % 4 + 1] AS step, sum(cost) * 10 AS cost FROM k GROUP BY 1, 2)
SELECT project_id, step, round(cost::DOUBLE, 4) AS cost, (MAP {{'ingestion': 4.0, 'measurement': 1.0, 'review': 5.0, 'drafting': 1.0}})[step]::DOUBLE AS budget, coalesce(cost > (MAP {{'ingestion': 4.0, 'measurement': 1.0, 'review': 5.0, 'drafting': 1.0}})[step], false) AS "over" FROM p""")
def project_costs(t: Tables):
    c = priced_calls(t).withColumn("cost_usd", F.col("cost_usd") * 10)
    steps = c.select(F.col("user_id").alias("project_id"), a.pick(["ingestion", "measurement", "review", "drafting"], F.col("service")).alias("step"), "cost_usd")
    return ops.project_costs(steps).withColumn("cost", F.round(F.col("cost").cast("double"), 4))


@query("D25", """WITH h AS (SELECT unnest([label * 3, label * 3 + vec_id % 3]) AS section_id, unnest([embedding[1], embedding[2]])::DOUBLE AS s FROM embeddings)
SELECT section_id, count(*) AS hits, round(avg(s), 6) AS mean_score, round(max(s) - min(s), 6) AS spread FROM h GROUP BY 1""")
def retrieval_stats(t: Tables):
    e = F.col("embedding")
    log = t.embeddings.select(
        F.array((F.col("label") * 3).cast("long"), F.col("label") * 3 + F.col("vec_id") % 3).alias("matched_section_ids"),
        F.array(e[0].cast("double"), e[1].cast("double")).alias("scores"))
    return ops.retrieval_stats(log).withColumn("mean_score", F.round("mean_score", 6)).withColumn("spread", F.round("spread", 6))


@query("D28", f"SELECT event_type AS stage, strftime(date_trunc('hour', ts), '{TS}') AS period, count(*) AS n FROM events GROUP BY 1, 2")
def stage_throughput(t: Tables):
    return ops.throughput(t.events, "event_type", "ts").select(F.col("event_type").alias("stage"), stamp("period").alias("period"), "n")


@query("D28", """WITH e AS (SELECT event_id, user_id % 5 AS stage, ts, CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE -1 END AS d FROM events)
SELECT event_id, stage, sum(d) OVER (PARTITION BY stage ORDER BY ts, event_id)::BIGINT AS depth FROM e""")
def queue_depth(t: Tables):
    e = t.events.select("event_id", (F.col("user_id") % 5).alias("stage"), "ts", F.when(F.col("event_type").isin("click", "view"), 1).otherwise(-1).alias("d"))
    return ops.queue_depth(e, ["stage"], "ts", F.col("d"), "event_id").select("event_id", "stage", "depth")


@query("I2 D2", f"""WITH {SQL_CALLS} SELECT strftime(time_bucket(INTERVAL 5 MINUTE, ts), '{TS}') AS window_start, service, count(*) AS calls, count_if(failed) AS errors, count_if(failed) / count(*) > 0.1 AS alert FROM c GROUP BY 1, 2""")
def error_rate_5min(t: Tables):
    return ops.error_windows(calls(t)).withColumn("window_start", stamp("window_start"))


@query("I3 D14", f"""WITH w AS (SELECT unnest(generate_series(date_trunc('minute', ts) - INTERVAL 4 MINUTE, date_trunc('minute', ts), INTERVAL 1 MINUTE)) AS s, ts, round(value * 100)::BIGINT AS ms FROM events)
SELECT strftime(s, '{TS}') AS window_start, count(*) AS calls, round(quantile_cont(ms, 0.99), 4) AS p99 FROM w WHERE ts < s + INTERVAL 5 MINUTE GROUP BY 1""")
def latency_p99_sliding(t: Tables):
    w = F.window("ts", "5 minutes", "1 minute")
    per = calls(t).groupBy(w.alias("w"), "latency_ms").agg(F.count(F.lit(1)).alias("n")).groupBy("w").agg(
        F.sum("n").alias("calls"), F.round(F.percentile("latency_ms", F.lit(0.99), F.col("n")), 4).alias("p99"))
    return per.select(stamp("w.start").alias("window_start"), "calls", "p99")


@query("E8 I5", f"""WITH {SQL_CALLS}, i AS (SELECT *, sum(failed::INT) OVER (PARTITION BY service ORDER BY ts, event_id) AS island FROM c),
n AS (SELECT *, row_number() OVER (PARTITION BY service, island ORDER BY ts, event_id) AS n FROM i WHERE NOT failed)
SELECT service, island::BIGINT AS island, max(n) AS length, strftime(min(ts), '{TS}') AS started_at, strftime(min(ts) FILTER (WHERE n = 10), '{TS}') AS recovered_at FROM n GROUP BY 1, 2""")
def success_streak(t: Tables):
    s = ops.success_streaks(calls(t).select("event_id", "ts", "service", "failed"))
    return s.select("service", "island", "length", stamp("started_at").alias("started_at"), stamp("recovered_at").alias("recovered_at"))


@query("I7 D11", f"""WITH l AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events), m AS (SELECT *, sum(CASE WHEN p IS NULL OR ts - p > INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session_no FROM l)
SELECT user_id, session_no::BIGINT AS session_no, count(*) AS events, strftime(min(ts), '{TS}') AS started_at, strftime(max(ts), '{TS}') AS ended_at FROM m GROUP BY 1, 2""")
def reviewer_sessions(t: Tables):
    s = ops.sessions(t.events.select("user_id", "ts", "event_id"), "user_id", "ts", "event_id", 30 * 60)
    return s.select("user_id", "session_no", "events", stamp("started_at").alias("started_at"), stamp("ended_at").alias("ended_at"))


@query("I4", """WITH q AS (SELECT event_id AS item_id, ts FROM events WHERE event_type = 'click'), d AS (SELECT event_id - 3 AS item_id, min(ts) AS done_at FROM events WHERE event_type <> 'click' GROUP BY 1)
SELECT item_id, done_at IS NULL AS open FROM q LEFT JOIN d USING (item_id) WHERE done_at IS NULL OR done_at - ts > INTERVAL 10 MINUTE""")
def backlog_outer_join(t: Tables):
    enqueued = t.events.filter(F.col("event_type") == "click").select(F.col("event_id").alias("item_id"), "ts")
    completed = t.events.filter(F.col("event_type") != "click").select((F.col("event_id") - 3).alias("item_id"), "ts")
    return ops.overdue(enqueued, completed).select("item_id", F.col("done_at").isNull().alias("open"))


@query("E13 I6", """WITH f AS (SELECT * FROM events WHERE event_type = 'error'), n AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS fifo FROM f) SELECT event_id, fifo, (fifo - 1) // 50 AS slot FROM n""")
def drain_plan(t: Tables):
    failed = t.events.filter(F.col("event_type") == "error").select("event_id", "ts")
    return ops.drain_plan(failed, 50).select("event_id", "fifo", "slot")


@query("I6", f"""WITH {SQL_CALLS} SELECT user_id * 100 + event_id % 20 AS call_id, count_if(failed) AS failures FROM c GROUP BY 1 HAVING count_if(failed) >= 3 AND count_if(NOT failed) = 0""")
def deferred_calls(t: Tables):
    c = calls(t).withColumn("call_id", F.col("user_id") * 100 + F.col("event_id") % 20)
    return ops.deferred_calls(c, 3).select("call_id", "failures")


@query("I8", f"""WITH w AS (SELECT user_id % 10 AS service, date_trunc('day', ts) AS d, sum(value::DECIMAL(12,2)) AS v FROM events GROUP BY 1, 2),
m AS (SELECT *, avg(v::DOUBLE) OVER z AS tm, count(*) OVER z AS n FROM w WINDOW z AS (PARTITION BY service ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT service, strftime(d, '%Y-%m-%d') AS day, v::DOUBLE AS cost, round(tm, 6) AS trailing_mean, coalesce(n >= 3 AND v > tm * 1.2, false) AS anomaly FROM m""")
def cost_anomaly(t: Tables):
    w = t.events.groupBy((F.col("user_id") % 10).alias("service"), F.date_trunc("DAY", "ts").alias("d")).agg(F.sum(F.col("value").cast("decimal(12,2)")).alias("v"))
    c = ops.cost_anomalies(w, ["service"], "d", "v", by_month(F.col("d")), 1.2)
    return c.select("service", F.date_format("d", "yyyy-MM-dd").alias("day"), F.col("v").cast("double").alias("cost"), F.round(F.col("trailing_mean").cast("double"), 6).alias("trailing_mean"), "anomaly")


@query("C21 M24", """SELECT 'lineitem.order' AS "check", count(*) AS violations FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'lineitem.part', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part) UNION ALL SELECT 'lineitem.supplier', count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 9 <> 0)
UNION ALL SELECT 'orders.customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 11 <> 0) UNION ALL SELECT 'customer.nation', count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)
UNION ALL SELECT 'supplier.nation', count(*) FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation) UNION ALL SELECT 'nation.region', count(*) FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region)
UNION ALL SELECT 'labels.document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def fk_audit(t: Tables):
    return v.union_all([
        v.orphan_count(t.lineitem, "l_orderkey", t.orders, "o_orderkey", "lineitem.order"),
        v.orphan_count(t.lineitem, "l_partkey", t.part, "p_partkey", "lineitem.part"),
        v.orphan_count(t.lineitem, "l_suppkey", t.supplier.filter(F.col("s_suppkey") % 9 != 0), "s_suppkey", "lineitem.supplier"),
        v.orphan_count(t.orders, "o_custkey", t.customer.filter(F.col("c_custkey") % 11 != 0), "c_custkey", "orders.customer"),
        v.orphan_count(t.customer, "c_nationkey", t.nation, "n_nationkey", "customer.nation"),
        v.orphan_count(t.supplier, "s_nationkey", t.nation, "n_nationkey", "supplier.nation"),
        v.orphan_count(t.nation, "n_regionkey", t.region, "r_regionkey", "nation.region"),
        v.orphan_count(t.labels, "doc_id", t.documents, "doc_id", "labels.document"),
    ])


@query("B10 B11 B12 M24", """WITH f AS (SELECT l_orderkey, l_linenumber, l_quantity, 1.05 - l_discount * 2 AS confidence, (['revise', 'provide', 'clarify', 'reference_only', 'fix'])[l_partkey % 5 + 1] AS severity,
  CASE WHEN l_suppkey % 7 <> 0 THEN l_returnflag END AS txt, CASE WHEN l_suppkey % 3 = 0 THEN 3 ELSE 4 END AS nbox, l_linenumber - 1 AS page FROM lineitem)
SELECT 'severity_domain' AS "check", count(*) AS violations FROM f WHERE severity = 'fix' UNION ALL SELECT 'confidence_range', count(*) FROM f WHERE NOT confidence BETWEEN 0 AND 1
UNION ALL SELECT 'page_min', count(*) FROM f WHERE page < 1 UNION ALL SELECT 'text_required', count(*) FROM f WHERE txt IS NULL UNION ALL SELECT 'bbox_shape', count(*) FROM f WHERE nbox <> 4""")
def domain_audit(t: Tables):
    four = F.array(*[F.lit(float(i)) for i in range(4)])
    rows = t.lineitem.select(
        (F.lit(1.05) - F.col("l_discount") * 2).alias("confidence"), a.pick(["revise", "provide", "clarify", "reference_only", "fix"], F.col("l_partkey")).alias("severity"),
        F.when(F.col("l_suppkey") % 7 != 0, F.col("l_returnflag")).alias("txt"), F.when(F.col("l_suppkey") % 3 == 0, F.slice(four, 1, 3)).otherwise(four).alias("bbox"),
        (F.col("l_linenumber") - 1).alias("page"))
    return v.violations(rows, {
        "severity_domain": v.in_domain("severity", "findings.severity"), "confidence_range": v.between("confidence", 0, 1), "page_min": v.at_least("page", 1),
        "text_required": v.has_text("txt"), "bbox_shape": v.box_shape("bbox")})


def _one_bad(domain: str) -> list[str]:
    """The words of a domain and one that is none of it."""
    return [*v.DOMAINS[domain], f"no {domain}"]


@query("B10", " UNION ALL ".join(
    f"""SELECT '{d.replace('.', '_')}' AS "check", count_if(l_partkey % {len(v.DOMAINS[d]) + 2} = {len(v.DOMAINS[d])}) AS violations FROM lineitem""" for d in v.DOMAINS))
def domain_audit_all(t: Tables):
    """Every enumerated column of the data model, null now and then, which is allowed."""
    k = F.col("l_partkey")
    rows = t.lineitem.select(*[a.pick([*_one_bad(d), None], k).alias(d.replace(".", "_")) for d in v.DOMAINS])
    return v.violations(rows, {c: v.in_domain(c, d) for d in v.DOMAINS for c in [d.replace(".", "_")]})


@query("D27 M24", """SELECT 'finding_evidence' AS "check", count_if(l_suppkey % 50 = 0) AS violations FROM lineitem UNION ALL SELECT 'finding_rule_version', 0 UNION ALL SELECT 'finding_text', count_if(l_partkey % 40 = 0) FROM lineitem
UNION ALL SELECT 'citation_frozen_text', count_if(o_orderkey % 30 = 0) FROM orders UNION ALL SELECT 'citation_chain', count_if(o_orderkey % 4 = 0) FROM orders
UNION ALL SELECT 'measurement_trace', count_if(p_size % 5 = 0) FROM part UNION ALL SELECT 'measurement_confidence', count_if(p_size > 48) FROM part""")
def invariant_audit(t: Tables):
    findings = t.lineitem.select(
        F.when(F.col("l_suppkey") % 50 != 0, F.col("l_suppkey")).alias("evidence_id"), F.lit("1.0.0").alias("rule_version"),
        F.when(F.col("l_partkey") % 40 == 0, "").otherwise("text").alias("draft_comment_text"))
    citations = t.orders.select(F.when(F.col("o_orderkey") % 30 != 0, "text").alias("frozen_text"), (F.col("o_orderkey") % 4).alias("chain_steps"))
    measures = t.part.select((F.col("p_size") % 5).alias("trace_steps"), (F.col("p_size") / 48).alias("confidence"))
    return ops.invariant_audit(findings, citations, measures)


@query("D31", """WITH s AS (SELECT p_partkey, sha256(p_name || ' ' || p_brand) AS h FROM part), c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_name || CASE WHEN l_suppkey % 10 = 0 THEN '  ' ELSE ' ' END || p_brand AS txt FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM c JOIN s ON s.p_partkey = c.l_partkey WHERE sha256(txt) <> h""")
def citation_fidelity(t: Tables):
    stored = t.part.select(F.col("p_partkey").alias("l_partkey"), F.concat_ws(" ", "p_name", "p_brand").alias("applicable_text"))
    frozen = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.concat(F.col("p_name"), F.when(F.col("l_suppkey") % 10 == 0, "  ").otherwise(" "), F.col("p_brand")).alias("frozen_text"))
    return ops.citation_fidelity(frozen, stored, ["l_partkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def _pii_sql(table: str, text: str, key: str) -> str:
    cols = ", ".join(f"count_if(regexp_matches({text}, '{p}')) AS {k}" for k, p in ops.PERSONAL.items())
    return f"SELECT {key} AS source, {cols}, count(*) AS n FROM {table} GROUP BY 1"


@query("M27", _pii_sql("documents", "text", "source"))
def pii_inventory(t: Tables):
    return ops.personal_data(t.busy("documents", "source", "text", "doc_id"), "text", ["source"])


@query("M27", _pii_sql("pages", "html", "page_id % 10"))
def pii_inventory_pages(t: Tables):
    return ops.personal_data(t.busy("pages").withColumn("source", F.col("page_id") % 10), "html", ["source"])


@query("C15 A5", f"""WITH p AS ({a.SQL_PROJECTS}), s AS (SELECT o_orderkey, o_custkey, o_orderkey % 5 AS f FROM orders),
sp AS (SELECT s.o_orderkey, f, p.jurisdiction, CASE WHEN f = 0 THEN p.permit_number END AS permit_number, CASE WHEN f = 1 THEN p.apn END AS apn,
  CASE f WHEN 2 THEN upper(p.address) WHEN 3 THEN replace(replace(p.address, 'Dennis', 'Denis'), 'Mission', 'Mision') ELSE 'unknown' END AS address FROM s JOIN p ON p.project_id = s.o_custkey),
kp AS (SELECT permit_number || '|' || jurisdiction AS k, min(project_id) AS p, count(*) AS n FROM p GROUP BY 1), ka AS (SELECT apn || '|' || jurisdiction AS k, min(project_id) AS p, count(*) AS n FROM p GROUP BY 1),
kd AS (SELECT split_part(address, ' ', 1) || '|' || lower(split_part(address, ' ', 2)) AS k, min(project_id) AS p, count(*) AS n FROM p GROUP BY 1),
ks AS (SELECT split_part(address, ' ', 1) || '|' || replace(replace(split_part(address, ' ', 2), 'Dennis', 'Denis'), 'Mission', 'Mision') AS k, min(project_id) AS p, count(*) AS n FROM p GROUP BY 1)
SELECT o_orderkey, coalesce(kp.p, ka.p, kd.p, ks.p) AS project_id, CASE WHEN kp.p IS NOT NULL THEN 'permit' WHEN ka.p IS NOT NULL THEN 'apn' WHEN kd.p IS NOT NULL THEN 'address' WHEN ks.p IS NOT NULL THEN 'sound' END AS matched_by,
  coalesce(kp.n, ka.n, kd.n, ks.n) AS candidates
FROM sp LEFT JOIN kp ON kp.k = permit_number || '|' || jurisdiction LEFT JOIN ka ON ka.k = apn || '|' || jurisdiction
LEFT JOIN kd ON kd.k = split_part(sp.address, ' ', 1) || '|' || lower(split_part(sp.address, ' ', 2)) LEFT JOIN ks ON ks.k = split_part(sp.address, ' ', 1) || '|' || split_part(sp.address, ' ', 2)""")
def match_project(t: Tables):
    p = a.projects(t)
    f = F.col("o_orderkey") % 5
    typo = F.replace(F.replace(F.col("address"), F.lit("Dennis"), F.lit("Denis")), F.lit("Mission"), F.lit("Mision"))
    submitted = t.orders.join(p.withColumnRenamed("project_id", "o_custkey"), "o_custkey").select(
        "o_orderkey", "jurisdiction", F.when(f == 0, F.col("permit_number")).alias("permit_number"), F.when(f == 1, F.col("apn")).alias("apn"),
        F.when(f == 2, F.upper("address")).when(f == 3, typo).otherwise("unknown").alias("address"))
    return ops.match_project(submitted, p).select("o_orderkey", "project_id", "matched_by", "candidates")


@query("C15 H14", """WITH p AS (SELECT c_custkey AS project_id, (c_custkey % 40)::VARCHAR AS number, lower(replace(substr(c_mktsegment, 1, 3 + (c_custkey % 5)::INT) || 'ton', ' ', '')) AS street FROM customer),
s AS (SELECT o_orderkey, (o_custkey % 40)::VARCHAR AS number, lower(CASE o_orderkey % 4 WHEN 0 THEN street WHEN 1 THEN substr(street, 1, 2) || substr(street, 4) WHEN 2 THEN substr(street, 2, 1) || substr(street, 1, 1) || substr(street, 3) ELSE 'zz' || reverse(street) END) AS street
  FROM orders JOIN p ON p.project_id = o_custkey),
pairs AS (SELECT a.number, a.street, b.street AS near, levenshtein(a.street, b.street) AS edits FROM (SELECT DISTINCT number, street FROM s) a JOIN (SELECT DISTINCT number, street FROM p) b ON a.number = b.number AND levenshtein(a.street, b.street) <= 2)
SELECT number, street, near, edits FROM pairs""")
def near_streets(t: Tables):
    """Streets of submittals, whole, with a letter dropped, two transposed or another name, against those of the projects with their number."""
    n = F.col("c_custkey")
    p = t.customer.select(n.alias("o_custkey"), (n % 40).cast("string").alias("number"), F.lower(F.replace(F.concat(F.substring("c_mktsegment", F.lit(1), (n % 5 + 3).cast("int")), F.lit("ton")), F.lit(" "), F.lit(""))).alias("street"))
    k, w = F.col("o_orderkey") % 4, F.col("street")
    spelled = (F.when(k == 0, w).when(k == 1, F.concat(F.substring(w, 1, 2), F.substring(w, 4, 99)))
               .when(k == 2, F.concat(F.substring(w, 2, 1), F.substring(w, 1, 1), F.substring(w, 3, 99))).otherwise(F.concat(F.lit("zz"), F.reverse(w))))
    s = t.orders.select("o_orderkey", "o_custkey").join(p, "o_custkey").select("number", spelled.alias("street"))
    return near_values(s, p, "number", "street", 2)


@query("C23", """WITH r AS (SELECT p_size AS citation, min(p_partkey) AS retrieval_id FROM part WHERE p_size % 3 <> 0 GROUP BY 1), m AS (SELECT o_orderkey AS measurement_id, o_custkey AS sheet_id, o_totalprice AS value FROM orders WHERE o_orderstatus <> 'P')
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * 100)::BIGINT) AS finding_id, l_orderkey AS measurement_id, m.sheet_id, m.value, r.retrieval_id FROM lineitem LEFT JOIN m ON m.measurement_id = l_orderkey LEFT JOIN r ON r.citation = l_linenumber""")
def provenance_chain(t: Tables):
    fid = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long")).alias("finding_id")
    found = t.lineitem.select(fid, F.col("l_linenumber").alias("citation"))
    evidence = t.lineitem.select(fid, F.col("l_orderkey").alias("measurement_id"))
    measures = t.orders.filter(F.col("o_orderstatus") != "P").select(
        F.col("o_orderkey").alias("measurement_id"), F.col("o_custkey").alias("sheet_id"), F.col("o_totalprice").alias("value"), F.lit(0.9).alias("confidence"))
    retrievals = t.part.filter(F.col("p_size") % 3 != 0).select(F.col("p_size").alias("citation"), F.col("p_partkey").alias("retrieval_id"))
    return ops.provenance_chain(found, evidence, measures, retrievals).select("finding_id", "measurement_id", "sheet_id", "value", "retrieval_id")


@query("B20 A8 C22", f"""WITH e AS ({a.SQL_ENTITIES}) SELECT entity_id, sheet_id, sheet_raw AS tag, address_mismatch FROM e WHERE type = 'window' AND address_mismatch AND sheet_raw = 'A-1.4'""")
def typed_entities(t: Tables):
    view = ops.typed_view(
        a.entities(t), "window", "sheet_identifier_raw struct<value:string>, address_mismatch boolean",
        F.col("address_mismatch") & (F.col("sheet_identifier_raw.value") == "A-1.4"))
    return view.select("entity_id", "sheet_id", F.col("sheet_identifier_raw.value").alias("tag"), "address_mismatch")


@query("A9 D14", f"""WITH {SQL_CALLS} SELECT model, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS calls, count(cost) AS priced FROM k GROUP BY 1, 2""")
def call_log_daily(t: Tables):
    c = priced_calls(t)
    return c.groupBy("model", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("calls"), F.count("cost_usd").alias("priced"))
