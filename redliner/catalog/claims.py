"""Cross-document claim queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from redliner.catalog import adapters as a
from redliner.catalog.base import Tables, query
from redliner.plans import claims as c
from redliner.plans.integrity import BOOK


def assertions(t: Tables):
    """lineitem rows as assertions: the part is the project, ship year the type, status and flag the value."""
    return t.lineitem.select(
        F.col("l_partkey").alias("project_id"),
        a.pick(c.CLAIM_TYPES, F.col("l_suppkey")).alias("claim_type"),
        F.concat("l_linestatus", "l_returnflag").alias("value"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("entity_id"),
        F.col("l_orderkey").alias("document_id"),
        (F.lit(1) - F.col("l_discount").cast("decimal(4,2)")).alias("confidence"),
        F.when(F.col("l_linenumber") % 2 == 0, "plan_set").otherwise("title24_report").alias("source_kind"),
    )


SQL_ASSERT = f"""a AS (SELECT l_partkey AS project_id, {a.sql_pick(c.CLAIM_TYPES, 'l_suppkey')} AS claim_type, l_linestatus || l_returnflag AS value,
  concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS entity_id, l_orderkey AS document_id, 1 - l_discount::DECIMAL(4,2) AS confidence,
  CASE WHEN l_linenumber % 2 = 0 THEN 'plan_set' ELSE 'title24_report' END AS source_kind FROM lineitem),
v AS (SELECT project_id, claim_type, value, sum(confidence) AS support, count(*) AS n, min(entity_id) AS e FROM a GROUP BY 1, 2, 3),
w AS (SELECT project_id, claim_type, arg_min(value, (-support, value)) AS resolved_value, arg_min(e, (-support, value)) AS resolved_entity,
  max(support)::DOUBLE / sum(support)::DOUBLE AS confidence, sum(n) AS n_sources, count(*) AS n_values FROM v GROUP BY 1, 2)"""


@query("D6 M1 J7", f"""WITH {SQL_ASSERT} SELECT project_id, claim_type, resolved_value, round(confidence, 6) AS confidence, n_sources::BIGINT AS n_sources, n_values, resolved_entity FROM w""")
def claims_resolved(t: Tables):
    return c.resolve_claims(assertions(t)).withColumn("confidence", F.round("confidence", 6))


@query("C17 D6", f"""WITH {SQL_ASSERT} SELECT a.project_id, a.claim_type, least(entity_id, resolved_entity) AS entity_id_a, greatest(entity_id, resolved_entity) AS entity_id_b,
  CASE WHEN entity_id < resolved_entity THEN value || ' <> ' || resolved_value ELSE resolved_value || ' <> ' || value END AS delta
FROM a JOIN w USING (project_id, claim_type) WHERE value <> resolved_value""")
def claims_conflicts(t: Tables):
    rows = assertions(t)
    return c.claim_conflicts(rows, c.resolve_claims(rows))


@query("K7 PI-CROSSDOC-001", f"""WITH {SQL_ASSERT} SELECT project_id, claim_type AS evidence_id,
  CASE WHEN starts_with(claim_type, 'r_value') OR starts_with(claim_type, 'u_factor') THEN 'revise' ELSE 'clarify' END AS severity FROM w WHERE n_values > 1""")
def claim_conflict_findings(t: Tables):
    found = BOOK.run({"claims": c.resolve_claims(assertions(t))})
    return found.select("project_id", "evidence_id", "severity")


@query("D26", f"""WITH {SQL_ASSERT} SELECT project_id, claim_type, count(DISTINCT document_id) AS documents FROM a GROUP BY 1, 2""")
def claim_source_counts(t: Tables):
    return c.source_counts(assertions(t)).drop("documents_approx")


@query("D6", f"""WITH {SQL_ASSERT} SELECT project_id, claim_type, count(*) AS n_sources, min(entity_id) AS smallest FROM a GROUP BY 1, 2""")
def claim_source_pages(t: Tables):
    pages = c.claim_sources(assertions(t), page_size=3)
    return pages.groupBy("project_id", "claim_type").agg(
        F.sum(F.size("sources")).alias("n_sources"), F.min(F.array_min(F.transform("sources", lambda s: s["entity_id"]))).alias("smallest")
    )


@query("M9", f"""WITH {SQL_ASSERT}, vk AS (SELECT source_kind, project_id, claim_type, value, sum(confidence) AS support FROM a GROUP BY 1, 2, 3, 4),
k AS (SELECT source_kind, project_id, claim_type, arg_min(value, (-support, value)) AS r FROM vk GROUP BY 1, 2, 3)
SELECT l.project_id, l.claim_type, l.r AS left_value, g.r AS right_value FROM k l JOIN k g ON l.project_id = g.project_id AND l.claim_type = g.claim_type
WHERE l.source_kind = 'plan_set' AND g.source_kind = 'title24_report' AND l.r <> g.r""")
def plan_report_mismatch(t: Tables):
    return c.value_disagreements(assertions(t), "plan_set", "title24_report").select("project_id", "claim_type", "left_value", "right_value")
