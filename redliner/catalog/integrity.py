"""Plan-integrity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from redliner.catalog import adapters as a
from redliner.catalog.base import Tables, query
from redliner.operators.overlap import overlapping, overlaps_any
from redliner.plans import integrity


def sheet_index(t: Tables):
    """Index entries written from orders: positions 1..4 of each order, some renamed, some left out."""
    k, n = F.col("o_orderkey"), F.col("n")
    rows = t.orders.select(k, F.explode(F.sequence(F.lit(1), F.lit(4))).alias("n"))
    return rows.filter((k + n) % 7 != 0).select(
        k.alias("project_id"), n.alias("ord"),
        F.concat(F.lit("A-"), n.cast("string"), F.when((k + n) % 5 == 0, "x").otherwise("")).alias("declared_id"),
        F.concat(F.lit("Plan "), F.when(k % 3 == 0, "B").otherwise("A")).alias("declared_title"),
    )


def indexed_sheets(t: Tables):
    s = t.lineitem.select(F.col("l_orderkey").alias("project_id"), F.col("l_linenumber").alias("ord")).distinct()
    return s.select(
        "project_id", "ord", F.concat_ws(":", "project_id", "ord").alias("sheet_id"),
        F.concat(F.lit("A-"), F.col("ord").cast("string")).alias("canonical_id"), F.lit("plan a").alias("sheet_title"),
    )


SQL_INDEX = """WITH n AS (SELECT o_orderkey AS k, unnest([1, 2, 3, 4]) AS n FROM orders),
i AS (SELECT k AS project_id, n AS ord, 'A-' || n || CASE WHEN (k + n) % 5 = 0 THEN 'x' ELSE '' END AS declared_id, 'Plan ' || CASE WHEN k % 3 = 0 THEN 'B' ELSE 'A' END AS declared_title
  FROM n WHERE (k + n) % 7 <> 0),
s AS (SELECT DISTINCT l_orderkey AS project_id, l_linenumber AS ord, 'A-' || l_linenumber AS canonical_id FROM lineitem),
j AS (SELECT coalesce(i.project_id, s.project_id) AS project_id, i.declared_id, s.canonical_id, i.declared_title, coalesce(i.ord, s.ord) AS ord
  FROM i FULL OUTER JOIN s ON i.project_id = s.project_id AND i.declared_id = s.canonical_id),
r AS (SELECT project_id, ord, max(declared_id) AS declared_id, max(canonical_id) AS canonical_id FROM j WHERE declared_id IS NULL OR canonical_id IS NULL GROUP BY 1, 2),
x AS (SELECT project_id, declared_id, canonical_id, CASE WHEN lower(declared_title) = 'plan a' THEN 'match' ELSE 'mismatched_title' END AS status FROM j WHERE declared_id IS NOT NULL AND canonical_id IS NOT NULL
  UNION ALL SELECT project_id, declared_id, canonical_id, CASE WHEN declared_id IS NULL THEN 'orphan' WHEN canonical_id IS NULL THEN 'missing' ELSE 'mismatched_id' END FROM r)
"""


@query("C7 K6", SQL_INDEX + "SELECT project_id, declared_id, canonical_id, status FROM x")
def index_reconcile(t: Tables):
    return integrity.reconcile_index(sheet_index(t), indexed_sheets(t)).select("project_id", "declared_id", "canonical_id", "status")


@query("C8 M5 STR-SHEAR-001", """WITH c AS (SELECT l_suppkey AS project_id, l_partkey AS tag, (l_quantity::INT % 2) AS size, count(*) AS n FROM lineitem GROUP BY 1, 2, 3),
r AS (SELECT ps AS project_id, p_partkey AS tag, p_size % 2 AS size FROM (SELECT *, unnest([p_partkey % 10, p_partkey % 100]) AS ps FROM part WHERE p_size % 5 <> 0)),
q AS (SELECT project_id, tag, min(size) AS size FROM r GROUP BY 1, 2)
SELECT coalesce(c.project_id, q.project_id) AS project_id, coalesce(c.tag, q.tag) AS tag, c.size AS callout_size, q.size AS row_size, coalesce(c.n, 0) AS n_callouts,
  CASE WHEN q.tag IS NULL THEN 'provide' WHEN c.tag IS NULL THEN 'clarify' ELSE 'revise' END AS severity
FROM c FULL OUTER JOIN q ON c.project_id = q.project_id AND c.tag = q.tag WHERE c.tag IS NULL OR q.tag IS NULL OR c.size <> q.size""")
def callout_vs_schedule(t: Tables):
    callouts = t.lineitem.select(
        F.col("l_suppkey").alias("project_id"), F.col("l_partkey").alias("tag"), (F.col("l_quantity").cast("int") % 2).alias("size"))
    rows = t.part.filter(F.col("p_size") % 5 != 0).select(
        F.explode(F.array(F.col("p_partkey") % 10, F.col("p_partkey") % 100)).alias("project_id"), F.col("p_partkey").alias("tag"), (F.col("p_size") % 2).alias("size"))
    return integrity.callouts_vs_schedule(callouts, rows, ["project_id", "tag"], "size")


@query("C27", """SELECT l_suppkey AS project_id, l_linenumber || '/A-' || (l_partkey % 50) AS callout, count(*) AS n FROM lineitem l
WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey % 100 = l.l_suppkey AND p.p_size % 7 + 1 = l.l_linenumber AND p.p_partkey % 50 = l.l_partkey % 50) GROUP BY 1, 2""")
def detail_callouts(t: Tables):
    callouts = t.lineitem.select(
        F.col("l_suppkey").alias("project_id"),
        F.concat(F.col("l_linenumber").cast("string"), F.lit("/A-"), (F.col("l_partkey") % 50).cast("string")).alias("callout"),
    ).groupBy("project_id", "callout").agg(F.count(F.lit(1)).alias("n"))
    details = t.part.select(
        (F.col("p_partkey") % 100).alias("project_id"), (F.col("p_size") % 7 + 1).cast("string").alias("detail"),
        F.concat(F.lit("A-"), (F.col("p_partkey") % 50).cast("string")).alias("canonical_id"))
    return integrity.missing_details(callouts, details).select("project_id", "callout", "n")


@query("E3", """WITH s AS (SELECT DISTINCT l_suppkey AS project_id, l_returnflag AS discipline_letter, l_linenumber AS major, l_partkey % 37 AS minor FROM lineitem),
w AS (SELECT *, lag(minor) OVER (PARTITION BY project_id, discipline_letter, major ORDER BY minor) AS previous FROM s)
SELECT project_id, discipline_letter, major, minor, previous FROM w WHERE minor - previous > 1""")
def sheet_numbering_gaps(t: Tables):
    sheets = t.lineitem.select(
        F.col("l_suppkey").alias("project_id"), F.col("l_returnflag").alias("discipline_letter"),
        F.col("l_linenumber").alias("major"), (F.col("l_partkey") % 37).alias("minor"))
    return integrity.numbering_gaps(sheets)


def text_boxes(t: Tables):
    """Text boxes from lineitem: x from the part, y from the supplier, width from the quantity."""
    x, y = F.col("l_partkey") % 97 * 11, F.col("l_suppkey") % 31 * 5
    return t.lineitem.select(
        (F.col("l_orderkey") % 40).alias("project_id"), (F.col("l_orderkey") % 200).cast("string").alias("sheet_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long")).alias("span_id"),
        x.cast("double").alias("x1"), y.cast("double").alias("y1"), (x + F.col("l_quantity") + 1).alias("x2"), (y + F.col("l_linenumber") + 1).cast("double").alias("y2"),
    )


SQL_BOXES = """SELECT (l_orderkey % 40) AS project_id, (l_orderkey % 200)::VARCHAR AS sheet_id, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * 100)::BIGINT) AS span_id,
  (l_partkey % 97 * 11)::DOUBLE AS x1, (l_suppkey % 31 * 5)::DOUBLE AS y1, l_partkey % 97 * 11 + l_quantity + 1 AS x2, (l_suppkey % 31 * 5 + l_linenumber + 1)::DOUBLE AS y2 FROM lineitem"""


@query("C14", f"""WITH b AS ({SQL_BOXES})
SELECT a.sheet_id, a.span_id FROM b a WHERE EXISTS (SELECT 1 FROM b o WHERE o.sheet_id = a.sheet_id AND o.span_id <> a.span_id
  AND o.x1 < a.x2 AND o.x2 > a.x1 AND o.y1 < a.y2 AND o.y2 > a.y1)""")
def bbox_overlap(t: Tables):
    return overlapping(text_boxes(t), ["sheet_id"], "span_id")


@query("C14 M20", f"""WITH b AS ({SQL_BOXES}), c AS (SELECT sheet_id, span_id AS cloud_id, x1, y1, x2 + 20 AS x2, y2 + 10 AS y2 FROM b WHERE ends_with(span_id, '7')),
p AS (SELECT sheet_id, span_id AS comment_id, x1, y1 FROM b WHERE NOT ends_with(span_id, '7'))
SELECT p.sheet_id, p.comment_id, (max((c.x2, c.cloud_id)))[2] AS cloud_id FROM p JOIN c ON c.sheet_id = p.sheet_id AND c.x1 < p.x1 + 1 AND c.x2 > p.x1 AND c.y1 < p.y1 + 1 AND c.y2 > p.y1
GROUP BY 1, 2""")
def revision_clouds(t: Tables):
    b = text_boxes(t)
    cloud = F.col("span_id").endswith("7")
    clouds = b.filter(cloud).select("sheet_id", F.col("span_id").alias("cloud_id"), "x1", "y1", (F.col("x2") + 20).alias("x2"), (F.col("y2") + 10).alias("y2"))
    points = b.filter(~cloud).select("sheet_id", F.col("span_id").alias("comment_id"), "x1", "y1", (F.col("x1") + 1).alias("x2"), (F.col("y1") + 1).alias("y2"))
    return overlaps_any(points, clouds, ["sheet_id"], "comment_id", "cloud_id")


def integrity_context(t: Tables):
    k = F.col("o_orderkey")
    blocks = t.orders.select(
        F.col("o_custkey").alias("project_id"), k.cast("string").alias("sheet_id"), F.concat(F.lit("tb"), k.cast("string")).alias("entity_id"),
        F.concat(F.when(k % 9 == 0, "1966").otherwise("2008"), F.lit(" Dennis Ln")).alias("address"),
        F.concat(F.lit("A-"), (k % 30).cast("string")).alias("sheet_raw"), (k % 11 != 0).alias("stamp_present"),
        a.pick(["floor_plan", "site_plan", "details"], k).alias("sheet_type"),
        F.when(k % 4 != 0, '1/4" = 1\'-0"').alias("scale_declared"), (k % 8 != 1).alias("has_north_arrow"),
        F.when(k % 13 == 0, "2019").otherwise("2022").alias("code_cycle"), F.when(k % 17 == 0, "B0").otherwise("B1").alias("permit_number"),
        F.date_format(F.date_sub(F.col("o_orderdate").cast("date"), (k % 120).cast("int")), "MM/dd/yyyy").alias("date_issued"),
        F.lit(0.7).alias("confidence"))
    projects = t.customer.select(
        F.col("c_custkey").alias("project_id"), F.lit("2008 Dennis Lane, Santa Rosa, CA").alias("project_address"),
        F.lit("2022").alias("project_code_cycle"), F.lit("B1").alias("project_permit_number"), F.lit(None).cast("timestamp").alias("received_at"))
    return blocks, projects


@query("K6 E4 J2 H14 B14 PI-TITLE-001 PI-STAMP-001 PI-SCALE-001 PI-NORTH-001 PI-CODECYCLE-001 PI-PERMIT-001 PI-ADDR-001", """
WITH b AS (SELECT o_custkey AS project_id, o_orderkey AS k, CASE WHEN o_orderkey % 9 = 0 THEN '1966' ELSE '2008' END || ' Dennis Ln' AS address FROM orders),
v AS (SELECT project_id, address, count(*) AS n FROM b GROUP BY 1, 2), m AS (SELECT project_id, arg_min(address, (-n, address)) AS major FROM v GROUP BY 1)
SELECT 'PI-TITLE-001' AS rule_id, b.project_id, k::VARCHAR AS sheet_id, 'clarify' AS severity FROM b JOIN m USING (project_id) WHERE b.address <> m.major
UNION ALL SELECT 'PI-STAMP-001', project_id, k::VARCHAR, 'provide' FROM b WHERE k % 11 = 0
UNION ALL SELECT 'PI-SCALE-001', project_id, k::VARCHAR, 'provide' FROM b WHERE k % 3 = 0 AND k % 4 = 0
UNION ALL SELECT 'PI-NORTH-001', project_id, k::VARCHAR, 'provide' FROM b WHERE k % 3 = 1 AND k % 8 = 1
UNION ALL SELECT 'PI-CODECYCLE-001', project_id, k::VARCHAR, 'clarify' FROM b WHERE k % 13 = 0
UNION ALL SELECT 'PI-PERMIT-001', project_id, k::VARCHAR, 'clarify' FROM b WHERE k % 17 = 0
UNION ALL SELECT 'PI-ADDR-001', project_id, k::VARCHAR, 'clarify' FROM b WHERE k % 9 = 0""")
def plan_integrity_rules(t: Tables):
    blocks, projects = integrity_context(t)
    found = integrity.BOOK.run({"title_blocks": integrity.with_project(blocks, projects)}, [
        "PI-TITLE-001", "PI-STAMP-001", "PI-SCALE-001", "PI-NORTH-001", "PI-CODECYCLE-001", "PI-PERMIT-001", "PI-ADDR-001"])
    return found.select("rule_id", "project_id", "sheet_id", "severity")


@query("H30 PI-DATE-001", """SELECT o_custkey AS project_id, o_orderkey::VARCHAR AS sheet_id, o_orderkey % 120 AS age_days FROM orders WHERE o_orderkey % 120 > 90""")
def stale_title_dates(t: Tables):
    blocks, projects = integrity_context(t)
    # the date is checked against the submittal the sheet came with
    received = t.orders.select(F.col("o_orderkey").cast("string").alias("sheet_id"), F.col("o_orderdate").alias("received_at"))
    frame = integrity.with_project(blocks, projects).drop("received_at").join(received, "sheet_id")
    found = integrity.BOOK.run({"title_blocks": frame}, ["PI-DATE-001"])
    return found.select("project_id", "sheet_id", (F.col("sheet_id").cast("long") % 120).alias("age_days"))


@query("K6 PI-INDEX-001 PI-INDEX-002 PI-INDEX-003 PI-INDEX-004", SQL_INDEX + """
SELECT CASE status WHEN 'orphan' THEN 'PI-INDEX-001' WHEN 'missing' THEN 'PI-INDEX-002' WHEN 'mismatched_id' THEN 'PI-INDEX-003' ELSE 'PI-INDEX-004' END AS rule_id,
  project_id, coalesce(declared_id, canonical_id) AS evidence_id FROM x WHERE status <> 'match'""")
def plan_index_rules(t: Tables):
    found = integrity.BOOK.run({"sheet_index": sheet_index(t), "sheets": indexed_sheets(t)})
    return found.select("rule_id", "project_id", "evidence_id")


@query("K6 PI-REV-CLOUD-001", """WITH s AS (SELECT DISTINCT l_orderkey AS project_id, l_linenumber AS sheet FROM lineitem WHERE l_returnflag = 'R'),
r AS (SELECT DISTINCT l_orderkey AS project_id, l_linenumber AS sheet FROM lineitem WHERE l_linestatus = 'F')
SELECT project_id, sheet::VARCHAR AS sheet_id FROM s ANTI JOIN r USING (project_id, sheet)""")
def clouds_without_table(t: Tables):
    li = t.lineitem.select(
        F.col("l_orderkey").alias("project_id"), F.col("l_linenumber").cast("string").alias("sheet_id"), "l_returnflag", "l_linestatus")
    found = integrity.BOOK.run({
        "revision_clouds": li.filter(F.col("l_returnflag") == "R"), "revision_tables": li.filter(F.col("l_linestatus") == "F")})
    return found.select("project_id", "sheet_id")


@query("K6 E3 PI-SHEET-NUMBERING", """WITH s AS (SELECT DISTINCT l_suppkey AS project_id, l_returnflag AS d, l_linenumber AS major, l_partkey % 37 AS minor FROM lineitem),
w AS (SELECT *, lag(minor) OVER (PARTITION BY project_id, d, major ORDER BY minor) AS previous FROM s)
SELECT 'PI-SHEET-NUMBERING' AS rule_id, project_id, d || '-' || major || '.' || minor AS sheet_id, 'clarify' AS severity FROM w WHERE minor - previous > 1""")
def sheet_numbering_rule(t: Tables):
    sheets = t.lineitem.select(
        F.col("l_suppkey").alias("project_id"), F.col("l_returnflag").alias("discipline_letter"),
        F.col("l_linenumber").alias("major"), (F.col("l_partkey") % 37).alias("minor"))
    return integrity.BOOK.run({"numbered_sheets": sheets}).select("rule_id", "project_id", "sheet_id", "severity")


@query("K6 C14 PI-TEXT-OVERLAP-001", f"""WITH b AS ({SQL_BOXES})
SELECT 'PI-TEXT-OVERLAP-001' AS rule_id, a.project_id, a.sheet_id, a.span_id AS evidence_id FROM b a WHERE EXISTS (SELECT 1 FROM b o WHERE o.project_id = a.project_id AND o.sheet_id = a.sheet_id
  AND o.span_id <> a.span_id AND o.x1 < a.x2 AND o.x2 > a.x1 AND o.y1 < a.y2 AND o.y2 > a.y1)""")
def text_overlap_rule(t: Tables):
    return integrity.BOOK.run({"text_boxes": text_boxes(t)}).select("rule_id", "project_id", "sheet_id", "evidence_id")
