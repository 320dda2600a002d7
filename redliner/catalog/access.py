"""Read API, gate and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from redliner.catalog import adapters as a
from redliner.catalog.base import Tables, query
from redliner.functions.text import page_label
from redliner.operators.keyed import latest_per_key
from redliner.operators.scan import by_month, ordered_scan, position
from redliner.plans import access

WITH_ALL = f"WITH p AS ({a.SQL_PROJECTS}), s AS ({a.SQL_SUBMITTALS}), d AS ({a.SQL_DOCUMENTS}), sh AS ({a.SQL_SHEETS}), e AS ({a.SQL_ENTITIES})"


def scoped_sheets(t: Tables):
    return access.sheets_of_projects(a.sheets(t), a.documents(t), a.submittals(t).select("submittal_id", "project_id"))


def parsed_entities(t: Tables):
    e = a.entities(t)
    return e.select(
        "*",
        access.json_text("$.project_address.value").alias("address"),
        access.json_text("$.sheet_identifier_raw.value").alias("sheet_raw"),
        access.json_text("$.address_mismatch").cast("boolean").alias("address_mismatch"),
    )


@query("B8 C2 C3 D1 F1", f"""{WITH_ALL}
SELECT p.project_id, p.address, p.jurisdiction, count(DISTINCT sh.sheet_id)::VARCHAR AS sheet_count
FROM p LEFT JOIN s ON s.project_id = p.project_id LEFT JOIN d ON d.submittal_id = s.submittal_id
LEFT JOIN sh ON sh.document_id = d.document_id
GROUP BY ALL ORDER BY p.project_id""")
def projects_sheet_count(t: Tables):
    counts = access.sheet_counts(a.projects(t), a.submittals(t), a.documents(t), a.sheets(t))
    return counts.select("project_id", "address", "jurisdiction", F.col("sheet_count").cast("string")).orderBy("project_id")


@query("A3 B1 B19 C1 C4 C5 E1", f"""{WITH_ALL},
tb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY created_at DESC, entity_id DESC) AS rn
       FROM e WHERE type = 'title_block') WHERE rn = 1)
SELECT s.project_id, sh.page, sh.sheet_id, coalesce(tb.sheet_raw, printf('p%03d', sh.page)) AS label,
       tb.entity_id AS title_block_id, coalesce(tb.address_mismatch, false) AS mismatch
FROM sh JOIN d ON d.document_id = sh.document_id JOIN s ON s.submittal_id = d.submittal_id
LEFT JOIN tb ON tb.sheet_id = sh.sheet_id""")
def sheets_by_project(t: Tables):
    sheets = access.with_title_block(scoped_sheets(t), a.entities(t))
    raw = access.json_text("$.sheet_identifier_raw.value")
    return sheets.select(
        "project_id", "page", "sheet_id", page_label(raw, F.col("page")).alias("label"),
        F.col("entity_id").alias("title_block_id"),
        F.coalesce(access.json_text("$.address_mismatch").cast("boolean"), F.lit(False)).alias("mismatch"),
    ).orderBy("project_id", "page", "sheet_id")


@query("F2 E14 B2", f"""{WITH_ALL}
SELECT s.project_id, min(sh.page) AS first_page, arg_min(sh.sheet_id, (sh.page, sh.sheet_id)) AS first_sheet_id
FROM sh JOIN d ON d.document_id = sh.document_id JOIN s ON s.submittal_id = d.submittal_id GROUP BY 1""")
def first_sheet_per_project(t: Tables):
    return access.first_sheet(scoped_sheets(t), ["project_id"])


@query("E14 E12", f"""WITH s AS ({a.SQL_SUBMITTALS})
SELECT submittal_id, project_id, row_number() OVER (PARTITION BY project_id ORDER BY received_at, submittal_id) AS round_number FROM s""")
def submittal_rounds(t: Tables):
    s = a.submittals(t)
    numbered = ordered_scan(
        s, ["project_id"], [F.col("received_at"), F.col("submittal_id")], by_month(F.col("received_at")),
        {"round_number": position()},
    )
    return numbered.select("submittal_id", "project_id", "round_number")


@query("B3 B4 B7 C22 F1", f"""{WITH_ALL}
SELECT e.sheet_id, e.entity_id, e.type, e.address FROM e WHERE e.type IN ('door', 'window')
AND e.sheet_id IN (SELECT sheet_id FROM e WHERE type = 'title_block')""")
def entities_of_listed_sheets(t: Tables):
    e = a.entities(t)
    listed = e.filter(F.col("type") == "title_block").select("sheet_id").distinct()
    wanted = access.entities_of_sheets(e.filter(F.col("type").isin("door", "window")), listed)
    return wanted.select(
        "sheet_id", "entity_id", "type", access.json_text("$.project_address.value").alias("address")
    )


@query("A8 B5 B6 B7 D2", f"""{WITH_ALL}
SELECT document_id % 100 AS bucket, count(*) AS total, count(*) FILTER (WHERE address ILIKE '%dennis%') AS with_street,
       count(*) FILTER (WHERE address_mismatch) AS mismatches FROM e WHERE type = 'title_block' GROUP BY 1""")
def payload_json_filter(t: Tables):
    blocks = parsed_entities(t).filter(F.col("type") == "title_block")
    return blocks.groupBy((F.col("document_id") % 100).alias("bucket")).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("address").ilike("%dennis%")).alias("with_street"),
        F.count_if("address_mismatch").alias("mismatches"),
    )


@query("B5 B6", """SELECT event_type, (json_extract_string(props, '$.k'))::INT % 10 AS k, count(*) AS n
FROM events WHERE (json_extract_string(props, '$.k'))::INT >= 50 AND event_type ILIKE '%i%' GROUP BY 1, 2""")
def event_payload_filter(t: Tables):
    k = F.get_json_object("props", "$.k").cast("int")
    return (
        t.events.filter((k >= 50) & F.col("event_type").ilike("%i%"))
        .groupBy("event_type", (k % 10).alias("k"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query("B9", f"""{WITH_ALL} SELECT p.tenant_id, count(*) AS submittals, min(s.submittal_id) AS first_submittal
FROM s JOIN p ON p.project_id = s.project_id WHERE p.tenant_id = 7 GROUP BY 1""")
def tenant_scope(t: Tables):
    own = access.tenant_scope(a.submittals(t), a.projects(t), 7)
    return own.groupBy(F.lit(7).alias("tenant_id")).agg(
        F.count(F.lit(1)).alias("submittals"), F.min("submittal_id").alias("first_submittal")
    )


@query("C28 D3 K4", f"""{WITH_ALL},
ns AS (SELECT s.project_id, count(*) AS n FROM sh JOIN d ON d.document_id = sh.document_id JOIN s ON s.submittal_id = d.submittal_id GROUP BY 1),
nb AS (SELECT s.project_id, count(*) FILTER (WHERE address ILIKE '%dennis%') AS na, count(*) FILTER (WHERE address_mismatch) AS nm
       FROM e JOIN d ON d.document_id = e.document_id JOIN s ON s.submittal_id = d.submittal_id WHERE type = 'title_block' GROUP BY 1),
j AS (SELECT p.project_id, ns.n, nb.na, nb.nm FROM p LEFT JOIN ns USING (project_id) LEFT JOIN nb USING (project_id))
SELECT project_id, 'sheets' AS "check", coalesce(n, 0) AS value, 19 AS need,
       CASE WHEN n IS NULL THEN 'UNCHECKED' WHEN n >= 19 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM j
UNION ALL SELECT project_id, 'addresses', coalesce(na, 0), 17,
       CASE WHEN n IS NULL THEN 'UNCHECKED' WHEN na >= 17 THEN 'PASS' ELSE 'FAIL' END FROM j
UNION ALL SELECT project_id, 'mismatches', coalesce(nm, 0), 1,
       CASE WHEN n IS NULL THEN 'UNCHECKED' WHEN nm >= 1 THEN 'PASS' ELSE 'UNCHECKED' END FROM j""")
def ingest_gate(t: Tables):
    owner = access.sheets_of_projects(parsed_entities(t).filter(F.col("type") == "title_block"), a.documents(t),
                                      a.submittals(t).select("submittal_id", "project_id"))
    return access.ingest_gate(owner, scoped_sheets(t), a.projects(t))


@query("A19 B7 D3 K3", f"""{WITH_ALL}
SELECT document_id, page, coalesce(sheet_raw, '(none)') AS sheet, coalesce(address, '(none)') AS address,
       round(confidence, 2) AS confidence, CASE WHEN address_mismatch THEN '[MISMATCH]' ELSE '[OK]' END AS flag
FROM e WHERE type = 'title_block'""")
def ingest_summary(t: Tables):
    return access.ingest_summary(parsed_entities(t).filter(F.col("type") == "title_block"))


@query("K3 D3", f"""{WITH_ALL}
SELECT document_id, count(*) AS entities, count(*) FILTER (WHERE NOT address_mismatch AND coalesce(address ILIKE '%dennis%', false)) AS address_ok,
       count(*) FILTER (WHERE address_mismatch) AS mismatches
FROM e WHERE type = 'title_block' GROUP BY 1""")
def ingest_report(t: Tables):
    return access.ingest_report(parsed_entities(t).filter(F.col("type") == "title_block"))


@query("E1 B18 A7", f"""{WITH_ALL}
SELECT sheet_id, type, extractor_version, entity_id FROM (
  SELECT *, row_number() OVER (PARTITION BY sheet_id, type ORDER BY extractor_version DESC, created_at DESC, entity_id DESC) AS rn FROM e)
WHERE rn = 1""")
def latest_entity_version(t: Tables):
    e = a.entities(t).select("sheet_id", "type", "extractor_version", "created_at", "entity_id")
    newest = latest_per_key(e, ["sheet_id", "type"], [F.col("extractor_version"), F.col("created_at"), F.col("entity_id")])
    return newest.select("sheet_id", "type", "extractor_version", "entity_id")


@query("B18", """SELECT e.user_id % 10 AS service, v.label AS version, count(*) AS n
FROM events e JOIN (SELECT label, min(vec_id) AS lo FROM embeddings GROUP BY 1) v ON e.user_id % 10 = v.label
WHERE to_timestamp(1704067200 + v.label * 86400)::TIMESTAMP <= e.ts
  AND to_timestamp(1704067200 + v.label * 86400 + 1728000)::TIMESTAMP > e.ts GROUP BY 1, 2""")
def active_version_calls(t: Tables):
    registry = t.embeddings.groupBy("label").agg(F.min("vec_id").alias("lo")).select(
        F.col("label").alias("version"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("label") * 86400).alias("deployed_at"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("label") * 86400 + 1728000).alias("deprecated_at"),
    )
    calls = t.events.withColumn("service", F.col("user_id") % 10)
    joined = calls.join(registry, F.col("service") == F.col("version"))
    return access.active_versions(joined, F.col("ts")).groupBy("service", "version").agg(F.count(F.lit(1)).alias("n"))


@query("D13 B19", f"""{WITH_ALL}, q AS (
SELECT s.project_id, coalesce(CASE WHEN sh.page % 4 > 0 THEN substr('ASM', (sh.page % 4)::INT, 1) END, '—') AS discipline, sh.page, sh.sheet_id
FROM sh JOIN d ON d.document_id = sh.document_id JOIN s ON s.submittal_id = d.submittal_id),
n AS (SELECT *, (row_number() OVER (PARTITION BY project_id, discipline ORDER BY page, sheet_id) - 1) // 500 + 1 AS part FROM q)
SELECT project_id, discipline, part, count(*) AS n_sheets, string_agg(printf('p%03d', page), ',' ORDER BY page, sheet_id) AS labels FROM n GROUP BY 1, 2, 3""")
def sheet_rail(t: Tables):
    letter = F.when(F.col("page") % 4 > 0, F.substring(F.lit("ASM"), F.col("page") % 4, F.lit(1)))
    sheets = scoped_sheets(t).withColumn("discipline_letter", letter).withColumn("sheet_raw", F.lit(None).cast("string"))
    rail = access.sheet_rail(sheets, ["project_id"])
    return rail.select(
        "project_id", "discipline", "part", F.size("sheets").cast("long").alias("n_sheets"),
        F.array_join(F.transform("sheets", lambda x: x["label"]), ",").alias("labels"),
    )


@query("H19 B16", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN c >= 0.9 THEN 'green' WHEN c >= 0.6 THEN 'yellow' ELSE 'red' END AS color,
 (floor(c * 100 + 0.5))::INT AS percent
FROM (SELECT *, ((1 - l_discount::DECIMAL(4,2)) * (1 - 4 * l_tax::DECIMAL(4,2)))::DOUBLE AS c FROM lineitem)""")
def confidence_badges(t: Tables):
    conf = ((F.lit(1) - F.col("l_discount").cast("decimal(4,2)")) * (F.lit(1) - 4 * F.col("l_tax").cast("decimal(4,2)"))).cast("double")
    badges = access.field_badges(t.lineitem.withColumn("confidence", conf))
    return badges.select("l_orderkey", "l_linenumber", "l_partkey", "color", "percent")
