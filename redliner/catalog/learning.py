"""Alignment, metrics, triage and regression queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from redliner.catalog import adapters as a
from redliner.catalog.base import Tables, query
from redliner.catalog.review import SQL_FINDINGS, findings
from redliner.operators.scan import by_month
from redliner.plans import learning as ln
from redliner.plans.review import current_state  # noqa: F401

WORDS = ["door", "window", "stair", "exit", "ramp", "sign", "wall"]


def alignment_sides(t: Tables):
    """Findings and comments derived from lineitem by status; texts are three words."""
    def words(seed):
        k = F.col("l_partkey") * seed
        return F.concat_ws(" ", a.pick(WORDS, k), a.pick(WORDS, k + F.col("l_linenumber")), F.lit("code"))

    b = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("s"), F.min("l_linestatus").alias("st"))
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    rows = b.select(
        key.alias("id"), (F.col("s") % 40).alias("project_id"), F.when(F.col("l_partkey") % 6 != 0, F.concat(F.lit("A-"), (F.col("l_partkey") % 23).cast("string"))).alias("sheet_id"),
        F.when(F.col("l_partkey") % 5 != 0, F.concat(F.lit("CBC-"), (F.col("l_partkey") % 17).cast("string"))).alias("citation"), words(1).alias("text"), "st")
    found = rows.filter(F.col("st") == "F").withColumnRenamed("id", "finding_id").drop("st")
    comments = rows.filter(F.col("st") == "O").withColumnRenamed("id", "comment_id").drop("st")
    return found, comments


def _tier_sql() -> str:
    """The tiers as a chain of common table expressions: number both sides per key, join on the number."""
    pick = a.sql_pick(WORDS, "pk")
    pick2 = a.sql_pick(WORDS, "(pk + ln)")
    out = [f"""b AS (SELECT l_orderkey AS ok, l_linenumber AS ln, min(l_partkey) AS pk, min(l_suppkey) AS s, min(l_linestatus) AS st FROM lineitem GROUP BY 1, 2),
r AS (SELECT ok * 10 + ln AS id, s % 40 AS project_id, CASE WHEN pk % 6 <> 0 THEN 'A-' || pk % 23 END AS sheet_id, CASE WHEN pk % 5 <> 0 THEN 'CBC-' || pk % 17 END AS citation, {pick} || ' ' || {pick2} || ' code' AS text, st FROM b),
k AS (SELECT *, md5(array_to_string(list_sort(list_distinct(string_split(text, ' '))), ' ')) AS signature, list_min(list_transform(list_distinct(string_split(text, ' ')), lambda w: md5('a' || w))) AS sketch FROM r),
f0 AS (SELECT * FROM k WHERE st = 'F'), c0 AS (SELECT * FROM k WHERE st = 'O')"""]
    for i, tier in enumerate(ln.TIERS):
        keys = ", ".join(tier.keys)
        full = " AND ".join(f"{k} IS NOT NULL" for k in tier.keys)
        out.append(
            f"h{i} AS MATERIALIZED (SELECT x.id AS finding_id, y.id AS comment_id, '{tier.name}' AS tier FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY id) AS n FROM f{i} WHERE {full}) x "
            f"JOIN (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY id) AS n FROM c{i} WHERE {full}) y USING ({keys}, n)), "
            f"f{i + 1} AS MATERIALIZED (SELECT * FROM f{i} WHERE id NOT IN (SELECT finding_id FROM h{i})), c{i + 1} AS MATERIALIZED (SELECT * FROM c{i} WHERE id NOT IN (SELECT comment_id FROM h{i}))")
    union = " UNION ALL ".join(f"SELECT * FROM h{i}" for i in range(len(ln.TIERS)))
    out.append(f"""p AS ({union}),
sc AS (SELECT p.*, x.project_id, round(0.4 * coalesce(x.sheet_id = y.sheet_id, false)::INT + 0.3 * coalesce(x.citation = y.citation, false)::INT +
  0.3 * len(list_intersect(list_distinct(string_split(x.text, ' ')), list_distinct(string_split(y.text, ' '))))::DOUBLE / len(list_distinct(list_concat(string_split(x.text, ' '), string_split(y.text, ' ')))), 6) AS score
  FROM p JOIN f0 x ON x.id = finding_id JOIN c0 y ON y.id = comment_id),
al AS (SELECT project_id, finding_id, comment_id, tier, score, CASE WHEN score >= 0.6 THEN 'matched' ELSE 'partial' END AS bucket FROM sc WHERE score >= 0.3
UNION ALL SELECT project_id, id, NULL, NULL, NULL, 'false_positive' FROM f0 WHERE id NOT IN (SELECT finding_id FROM sc WHERE score >= 0.3)
UNION ALL SELECT project_id, NULL, id, NULL, NULL, 'missed' FROM c0 WHERE id NOT IN (SELECT comment_id FROM sc WHERE score >= 0.3))""")
    return ", ".join(out)


SQL_ALIGN = _tier_sql()


@query("C18 E11 J5 M14", f"WITH {SQL_ALIGN} SELECT project_id, finding_id, comment_id, tier, score, bucket FROM al")
def alignment(t: Tables):
    return ln.align(*alignment_sides(t))


@query("D29 M16", f"""WITH {SQL_ALIGN}, n AS (SELECT project_id, count(DISTINCT id) AS comments FROM c0 GROUP BY 1), h AS (SELECT project_id, count(DISTINCT comment_id) AS covered FROM al WHERE bucket IN ('matched', 'partial') GROUP BY 1),
m AS (SELECT project_id, count(*) AS triaged FROM al WHERE bucket = 'missed' GROUP BY 1)
SELECT project_id, comments, coalesce(covered, 0) AS covered, coalesce(triaged, 0) AS triaged, coalesce(covered, 0) + coalesce(triaged, 0) = comments AS complete FROM n LEFT JOIN h USING (project_id) LEFT JOIN m USING (project_id)""")
def comment_coverage(t: Tables):
    found, comments = alignment_sides(t)
    al = ln.align(found, comments)
    return ln.comment_coverage(al, comments, al.filter(F.col("bucket") == "missed"))


SQL_OUTCOMES = """o AS (SELECT source AS rule_id, lang AS discipline, (['north', 'south'])[d.doc_id % 2 + 1] AS jurisdiction, text ILIKE '%is%' AS emitted, text ILIKE '%is%' AND quality = 1 AS approved,
  text ILIKE '%is%' AND toxic = 1 AS matched, NOT text ILIKE '%is%' AND toxic = 1 AS missed, text ILIKE '%is%' AND toxic = 0 AS false_positive, d.doc_id AS doc_id FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"""


def outcomes(t: Tables):
    hit = F.col("text").ilike("%is%")
    toxic = F.col("toxic") == 1
    return t.documents.join(t.labels, "doc_id").select(
        F.col("source").alias("rule_id"), F.col("lang").alias("discipline"), a.pick(["north", "south"], F.col("doc_id")).alias("jurisdiction"),
        hit.alias("emitted"), (hit & (F.col("quality") == 1)).alias("approved"), (hit & toxic).alias("matched"), (~hit & toxic).alias("missed"),
        (hit & ~toxic).alias("false_positive"), "doc_id")


@query("D7 M15", f"""WITH {SQL_OUTCOMES}, c AS (SELECT rule_id, count_if(emitted) AS emitted, count_if(approved) AS approved, count_if(matched) AS matched, count_if(missed) AS missed, count_if(false_positive) AS false_positive FROM o GROUP BY 1),
p AS (SELECT *, approved / nullif(emitted, 0) AS p, matched / nullif(matched + missed, 0) AS r FROM c)
SELECT rule_id, emitted, approved, matched, missed, false_positive, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / nullif(p + r, 0), 6) AS f1,
  round(matched / nullif(matched + false_positive, 0), 6) AS precision_vs_authority, emitted + missed AS sample_size FROM p""")
def rule_metrics(t: Tables):
    return ln.with_rates(ln.rule_counts(outcomes(t), ["rule_id"]))


@query("D8 M15", f"""WITH {SQL_OUTCOMES}, c AS (SELECT rule_id, discipline, jurisdiction, grouping_id(rule_id, discipline, jurisdiction) AS level, count_if(emitted)::BIGINT AS emitted, count_if(approved)::BIGINT AS approved, count_if(matched)::BIGINT AS matched,
  count_if(missed)::BIGINT AS missed, count_if(false_positive)::BIGINT AS false_positive FROM o GROUP BY GROUPING SETS ((discipline, rule_id), (discipline), (jurisdiction), ())),
p AS (SELECT *, approved / nullif(emitted, 0) AS p, matched / nullif(matched + missed, 0) AS r FROM c)
SELECT rule_id, discipline, jurisdiction, level, emitted, approved, matched, missed, false_positive, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / nullif(p + r, 0), 6) AS f1,
  round(matched / nullif(matched + false_positive, 0), 6) AS precision_vs_authority, emitted + missed AS sample_size FROM p""")
def metrics_rollup(t: Tables):
    return ln.metrics_rollup(outcomes(t))


@query("D9", f"""WITH {SQL_FINDINGS} SELECT discipline, count_if(severity = 'revise') AS revise, count_if(severity = 'provide') AS provide, count_if(severity = 'clarify') AS clarify, count_if(severity = 'reference_only') AS reference_only,
  count_if(requires_licensed_review) AS licensed, count(*) AS n, round(count_if(requires_licensed_review) / count(*), 6) AS licensed_share FROM f GROUP BY 1""")
def severity_profile(t: Tables):
    return ln.severity_profile(findings(t), ["discipline"])


# the SQL distance counts bytes, so there, and only there, each accented letter becomes a byte of its own that no text holds
ONE_BYTE = "'ÄÁÇÈÉÊÍÑÓÖÚÜßäáçèéêíñóöúü', '!#$%&()*+-/0123456789:;<='"
SQL_EDITS = f"e AS (SELECT a.conv_id * 1000 + a.turn AS finding_id, a.role AS rule_id, translate(a.text, {ONE_BYTE}) AS draft, translate(b.text, {ONE_BYTE}) AS final FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"


def edits(t: Tables):
    c = t.busy("conversations")
    following = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("final"))
    return c.join(following, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("finding_id"), F.col("role").alias("rule_id"), F.col("text").alias("draft"), "final")


@query("D10 H26", f"WITH {SQL_EDITS} SELECT rule_id, sum(levenshtein(draft, final))::BIGINT AS total_distance, count(*) AS n, round(sum(levenshtein(draft, final)) / count(*), 6) AS mean_distance FROM e GROUP BY 1")
def edit_distance(t: Tables):
    return ln.edit_distances(edits(t), ["rule_id"], "draft", "final")


@query("A18 M16", f"""WITH {SQL_ALIGN}, {SQL_EDITS} SELECT 'misses' AS queue, comment_id AS ref_id FROM al WHERE bucket = 'missed' UNION ALL SELECT 'false_positives', finding_id FROM al WHERE bucket = 'false_positive'
UNION ALL SELECT 'edits', finding_id FROM e WHERE levenshtein(draft, final) >= 40""")
def triage_queues(t: Tables):
    return ln.triage_queues(ln.align(*alignment_sides(t)), edits(t))


@query("D16 M16", """WITH x AS (SELECT l_returnflag AS type, (['vector', 'hybrid', 'raster', 'low_quality_scan'])[l_suppkey % 4 + 1] AS quality, l_discount > 0.08 AS overridden FROM lineitem)
SELECT type, quality, count(*) AS n, count_if(overridden)::BIGINT AS overridden, round(count_if(overridden) / count(*), 6) AS rate FROM x GROUP BY CUBE (type, quality)""")
def override_rates(t: Tables):
    rows = t.lineitem.select(
        F.col("l_returnflag").alias("type"), a.pick(["vector", "hybrid", "raster", "low_quality_scan"], F.col("l_suppkey")).alias("quality"), (F.col("l_discount") > 0.08).alias("overridden"))
    return ln.override_queue(rows)


@query("D11", """WITH a AS (SELECT event_id % 1500 AS k, min(ts) AS t0 FROM events GROUP BY 1), b AS (SELECT event_id % 1500 AS k, min(ts) AS t1 FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT k % 10 AS rule_id, round(avg(epoch(date_trunc('second', t1)) - epoch(date_trunc('second', t0))), 3) AS mean_seconds, max(epoch(date_trunc('second', t1)) - epoch(date_trunc('second', t0)))::BIGINT AS max_seconds, count(*) AS n FROM a JOIN b USING (k) GROUP BY 1""")
def time_to_approve(t: Tables):
    e = t.events.select((F.col("event_id") % 1500).alias("k"), F.col("ts").alias("created_at"), "event_type")
    created = e.groupBy("k").agg(F.min("created_at").alias("created_at")).withColumn("rule_id", F.col("k") % 10)
    return ln.time_to_approve(created, e.filter(F.col("event_type") == "purchase").drop("event_type"), ["rule_id"], "k")


@query("E6", """WITH m AS (SELECT l_returnflag AS rule_id, date_trunc('month', l_shipdate) AS period, sum(l_quantity::DECIMAL(12,2)) AS v FROM lineitem GROUP BY 1, 2)
SELECT rule_id, strftime(period, '%Y-%m') AS period, v::DOUBLE AS value, (v - lag(v) OVER w)::DOUBLE AS change, round(avg(v::DOUBLE) OVER (PARTITION BY rule_id ORDER BY period ROWS UNBOUNDED PRECEDING), 4) AS mean_so_far FROM m WINDOW w AS (PARTITION BY rule_id ORDER BY period)""")
def metric_trend(t: Tables):
    m = t.lineitem.groupBy(F.col("l_returnflag").alias("rule_id"), F.date_trunc("MONTH", "l_shipdate").alias("period")).agg(F.sum(F.col("l_quantity").cast("decimal(12,2)")).alias("v"))
    tr = ln.trend(m, ["rule_id"], "period", "v", F.year("period"))
    return tr.select(
        "rule_id", F.date_format("period", "yyyy-MM").alias("period"), F.col("v").cast("double").alias("value"), F.col("change").cast("double").alias("change"),
        F.round(F.col("mean_so_far").cast("double"), 4).alias("mean_so_far"))


@query("E7", """WITH p AS (SELECT user_id, min(ts) AS t0 FROM events WHERE event_type = 'signup' GROUP BY 1), j AS (SELECT e.user_id, epoch(date_trunc('second', e.ts)) - epoch(date_trunc('second', t0)) AS g, event_type <> 'error' AS good FROM events e JOIN p USING (user_id))
SELECT user_id, count_if(g >= -259200 AND g < 0) AS n_before, count_if(g >= -259200 AND g < 0 AND good) AS good_before, count_if(g >= 0 AND g < 259200) AS n_after, count_if(g >= 0 AND g < 259200 AND good) AS good_after,
  round(count_if(g >= -259200 AND g < 0 AND good) / nullif(count_if(g >= -259200 AND g < 0), 0) - count_if(g >= 0 AND g < 259200 AND good) / nullif(count_if(g >= 0 AND g < 259200), 0), 6) AS drop FROM j GROUP BY 1""")
def promotion_drop(t: Tables):
    e = t.events.select("user_id", "ts", (F.col("event_type") != "error").alias("good"))
    promoted = t.events.filter(F.col("event_type") == "signup").groupBy("user_id").agg(F.min("ts").alias("promoted_at"))
    return ln.promotion_drop(e, promoted, ["user_id"])


@query("G2 M17", "SELECT doc_id AS comment_id FROM labels WHERE toxic = 1 EXCEPT SELECT doc_id FROM labels WHERE quality = 0")
def regression_gate(t: Tables):
    ids = F.col("doc_id").alias("comment_id")
    return ln.lost_matches(t.labels.filter(F.col("toxic") == 1).select(ids), t.labels.filter(F.col("quality") == 0).select(ids))


@query("G4", "SELECT doc_id AS comment_id FROM labels WHERE toxic = 0 INTERSECT SELECT doc_id FROM documents WHERE lang = 'en'")
def matched_in_both(t: Tables):
    ids = F.col("doc_id").alias("comment_id")
    return ln.kept_matches(t.labels.filter(F.col("toxic") == 0).select(ids), t.documents.filter(F.col("lang") == "en").select(ids))


@query("G3 M25", """WITH o AS (SELECT p_partkey AS k, p_name AS v FROM part WHERE p_size % 4 <> 0), n AS (SELECT p_partkey AS k, CASE WHEN p_size % 7 = 0 THEN p_type ELSE p_name END AS v FROM part WHERE p_size % 5 <> 0)
SELECT coalesce(o.k, n.k) AS base_section_id, o.v AS old_value, n.v AS new_value, CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' WHEN o.v = n.v THEN 'same' ELSE 'changed' END AS status FROM o FULL OUTER JOIN n ON o.k = n.k""")
def pack_diff(t: Tables):
    from redliner.operators.keyed import changed

    k = F.col("p_partkey").alias("base_section_id")
    old = t.part.filter(F.col("p_size") % 4 != 0).select(k, F.col("p_name").alias("v"))
    new = t.part.filter(F.col("p_size") % 5 != 0).select(k, F.when(F.col("p_size") % 7 == 0, F.col("p_type")).otherwise(F.col("p_name")).alias("v"))
    return changed(old, new, ["base_section_id"], "v")


@query("D24 M23", """SELECT count(*) AS n, count_if(o = w) AS agree, count_if(w = tr AND o <> tr) AS wins, count_if(o = tr AND w <> tr) AS losses, count_if(w = tr AND o <> tr) > count_if(o = tr AND w <> tr) AS promote
FROM (SELECT n_chars % 3 AS o, n_chars % 5 % 3 AS w, quality AS tr FROM documents JOIN labels USING (doc_id))""")
def shadow_report(t: Tables):
    d = t.documents
    old, new = d.select("doc_id", (F.col("n_chars") % 3).alias("v")), d.select("doc_id", (F.col("n_chars") % 5 % 3).alias("v"))
    return ln.shadow_report(old, new, t.labels.select("doc_id", F.col("quality").cast("long").alias("v")), ["doc_id"], "v")


@query("D17", """WITH c AS (SELECT DISTINCT o_orderpriority AS jurisdiction, o_custkey % 300 AS k FROM orders WHERE o_orderstatus <> 'P'), m AS (SELECT DISTINCT o_orderpriority AS jurisdiction, o_custkey % 300 AS k FROM orders WHERE o_orderstatus = 'P')
SELECT c.jurisdiction, count(*) AS cited, count(m.k) AS amended, round(count(m.k) / count(*), 6) AS coverage FROM c LEFT JOIN m USING (jurisdiction, k) GROUP BY 1""")
def amendment_coverage(t: Tables):
    o = t.orders.select(F.col("o_orderpriority").alias("jurisdiction"), (F.col("o_custkey") % 300).alias("canonical_id"), "o_orderstatus")
    return ln.amendment_coverage(o.filter(F.col("o_orderstatus") != "P"), o.filter(F.col("o_orderstatus") == "P"))


@query("D30 M25", """WITH p AS (SELECT p_partkey AS pack, p_size % 30 AS ex, p_size % 3 AS src FROM part), am AS (SELECT p_partkey AS pack, unnest([p_partkey % 120, p_partkey % 130, p_size]) AS base FROM part),
l AS (SELECT pack, count(*) FILTER (WHERE base NOT IN (SELECT s_suppkey FROM supplier)) AS unlinked FROM am GROUP BY 1)
SELECT pack::VARCHAR AS pack_id, ex AS examples, CASE WHEN src = 0 THEN 1 ELSE 0 END AS unsourced_policies, coalesce(unlinked, 0) AS unlinked_amendments, ex >= 20 AND src <> 0 AND coalesce(unlinked, 0) = 0 AS ready FROM p LEFT JOIN l USING (pack)""")
def pack_readiness(t: Tables):
    from redliner.sources import packs

    bases = F.array(F.col("p_partkey") % 120, F.col("p_partkey") % 130, F.col("p_size").cast("long"))
    am = F.transform(bases, lambda b: F.struct(
        b.cast("string").alias("base_section_id"), F.lit("append").alias("operation"), F.lit("t").alias("amendment_text"),
        F.lit(None).cast("date").alias("effective_date"), F.lit(None).cast("string").alias("superseded_by")))
    src = F.when(F.col("p_size") % 3 != 0, "http://city.example/policy")
    policy = F.struct(F.lit("p").alias("title"), F.lit("b").alias("body_text"), src.alias("source_url"), F.array(F.lit("x")).alias("applies_to_sections"))
    frame = t.part.select(
        F.col("p_partkey").cast("string").alias("pack_id"), F.lit("j").alias("jurisdiction"), F.lit("1").alias("version"), am.alias("amendments"),
        F.array(policy).alias("agency_policies"), F.array_repeat(F.lit("e"), (F.col("p_size") % 30)).alias("drafter_examples"))
    sections = t.supplier.select(F.col("s_suppkey").cast("string").alias("canonical_id"))
    return packs.pack_readiness(frame, sections)
