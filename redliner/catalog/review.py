"""Review, round, letter and checklist queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from redliner.catalog import adapters as a
from redliner.catalog.base import Tables, query
from redliner.functions import review as r
from redliner.plans import review as rv
from redliner.session import growing

SEV = r.SEVERITIES
DISC = r.DISCIPLINE_ORDER
FIRST_DAY = "TIMESTAMP '2024-01-01'"


def findings(t: Tables):
    """Findings from lineitem: supplier as project, part decides rule and discipline, line number the round."""
    return t.lineitem.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("finding_id"),
        F.col("l_suppkey").alias("project_id"), a.pick(DISC, F.col("l_partkey")).alias("discipline"),
        F.concat(F.lit("R-"), (F.col("l_partkey") % 12).cast("string")).alias("rule_id"), (F.col("l_orderkey") % 50).alias("sheet_id"),
        (F.col("l_partkey") % 3).alias("tag"), F.col("l_linenumber").alias("round"), a.pick(SEV, F.col("l_orderkey")).alias("severity"),
        (F.lit(1) - 5 * F.col("l_discount").cast("decimal(4,2)")).cast("double").alias("confidence"),
        (F.col("l_partkey") % 7 == 0).alias("requires_licensed_review"), "l_orderkey", "l_partkey")


SQL_FINDINGS = f"""f AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS finding_id, l_suppkey AS project_id, {a.sql_pick(DISC, 'l_partkey')} AS discipline,
  'R-' || (l_partkey % 12) AS rule_id, l_orderkey % 50 AS sheet_id, l_partkey % 3 AS tag, l_linenumber AS round, {a.sql_pick(SEV, 'l_orderkey')} AS severity,
  (1 - 5 * l_discount::DECIMAL(4,2))::DOUBLE AS confidence, l_partkey % 7 = 0 AS requires_licensed_review, l_orderkey, l_partkey, (l_partkey % {len(DISC)} + 1) AS dr FROM lineitem)"""


def simple_findings(t: Tables):
    return t.part.select(
        F.col("p_partkey").alias("finding_id"), F.col("p_size").alias("sheet_id"), a.pick(DISC, F.col("p_partkey")).alias("discipline"),
        (F.col("p_size") / 50).alias("confidence"), (F.col("p_partkey") % 7 == 0).alias("requires_licensed_review"))


def actions(t: Tables):
    kind = (
        F.when(F.col("event_type") == "signup", "approve").when(F.col("event_type") == "view", "edit").when(F.col("event_type") == "purchase", "merge")
        .when(F.col("event_type") == "error", "reject").otherwise("override")
    )
    return t.events.select(
        F.col("event_id").alias("action_id"), (F.col("event_id") * 13 % 1500).alias("finding_id"), kind.alias("action"),
        F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("text"), F.col("ts").alias("created_at"))


SQL_STATE = f"""pf AS (SELECT p_partkey AS finding_id, p_size AS sheet_id, {a.sql_pick(DISC, 'p_partkey')} AS discipline, p_size / 50.0 AS confidence, p_partkey % 7 = 0 AS licensed FROM part),
ac AS (SELECT event_id AS action_id, event_id * 13 % 1500 AS finding_id, CASE event_type WHEN 'signup' THEN 'approved' WHEN 'view' THEN 'edited' WHEN 'purchase' THEN 'merged' WHEN 'error' THEN 'rejected' END AS state,
  't' || event_id AS text, ts FROM events),
st AS (SELECT finding_id, arg_max(state, (ts, action_id)) AS state, (max((ts, action_id, text)) FILTER (WHERE state = 'edited'))[3] AS final_text, count(*) AS n FROM ac WHERE state IS NOT NULL GROUP BY 1),
cs AS (SELECT pf.*, coalesce(state, 'pending') AS approval_state, final_text, coalesce(n, 0) AS n_actions FROM pf LEFT JOIN st USING (finding_id))"""


@query("M18 E1", f"WITH {SQL_STATE} SELECT finding_id, approval_state, final_text, n_actions FROM cs")
def finding_state(t: Tables):
    return rv.current_state(simple_findings(t), actions(t)).select("finding_id", "approval_state", "final_text", "n_actions")


@query("B15 B21 M18", f"""WITH {SQL_STATE} SELECT finding_id, CASE WHEN confidence < 0.3 THEN 'reject' ELSE 'approve' END AS action FROM cs
WHERE approval_state = 'pending' AND (confidence < 0.3 OR (discipline = 'structural' AND NOT licensed))""")
def batch_actions(t: Tables):
    state = rv.current_state(simple_findings(t), actions(t))
    return rv.batch_actions(state, 0.3, "structural")


@query("C24 D12", f"""WITH {SQL_STATE} SELECT sheet_id, count(*) AS open_findings FROM cs WHERE approval_state = 'pending' GROUP BY 1""")
def open_badges(t: Tables):
    return rv.open_badges(rv.current_state(simple_findings(t), actions(t)))


@query("C24", f"""WITH {SQL_STATE} SELECT finding_id FROM pf WHERE finding_id NOT IN (SELECT finding_id FROM ac)""")
def unacted_findings(t: Tables):
    return rv.unacted(simple_findings(t), actions(t)).select("finding_id")


@query("C20 M19 E12", f"""WITH {SQL_FINDINGS}, p AS (SELECT project_id, discipline, rule_id, sheet_id, tag, min(round) AS prev_round FROM f WHERE round <= 6 GROUP BY ALL),
c AS (SELECT project_id, discipline, rule_id, sheet_id, tag, max(round) AS this_round FROM f WHERE round = 7 GROUP BY ALL)
SELECT project_id, discipline, rule_id, sheet_id, tag, CASE WHEN this_round IS NULL THEN 'closed' WHEN prev_round IS NULL THEN 'new' ELSE 're-raised' END AS status, coalesce(prev_round, this_round) AS first_round
FROM p FULL OUTER JOIN c USING (project_id, discipline, rule_id, sheet_id, tag)""")
def round_manager(t: Tables):
    f = findings(t)
    return rv.compare_rounds(f.filter(F.col("round") <= 6), f.filter(F.col("round") == 7))


@query("E12 H29", f"""WITH {SQL_FINDINGS}, w AS (SELECT *, min(round) OVER (PARTITION BY project_id, discipline, rule_id, sheet_id, tag) AS first_round FROM f)
SELECT finding_id, first_round, round - first_round AS age, CASE WHEN round - first_round <= 0 THEN 'italic' WHEN round - first_round = 1 THEN 'bold' ELSE 'underlined' END AS typography FROM w""")
def issue_ages(t: Tables):
    return rv.issue_ages(findings(t)).select("finding_id", "first_round", "age", "typography")


SQL_LETTER_NO = f"""{SQL_FINDINGS}, n AS (SELECT *, row_number() OVER (PARTITION BY project_id, round ORDER BY dr, sheet_id, finding_id) AS comment_number FROM f)"""


def letter(t: Tables):
    """One letter per project and round."""
    return rv.number_letter(findings(t), ["project_id", "round"], ["sheet_id", "finding_id"])


@query("E2 F3 M21", f"WITH {SQL_LETTER_NO} SELECT project_id, round, finding_id, discipline, comment_number FROM n")
def letter_numbering(t: Tables):
    return letter(t).select("project_id", "round", "finding_id", "discipline", "comment_number")


@query("A14 M21", f"""WITH {SQL_LETTER_NO} SELECT project_id, round, (comment_number - 1) // 25 + 1 AS part, count(*) AS n_findings, min(comment_number) AS first_number, arg_max(finding_id, comment_number) AS last_finding FROM n GROUP BY 1, 2, 3""")
def letter_bundle(t: Tables):
    rows = letter(t).select("project_id", "round", "comment_number", "finding_id", "discipline", "severity")
    bundle = rv.letter_bundle(rows, ["project_id", "round"], 25)
    back = F.from_json("bundle", "findings array<struct<comment_number:bigint,finding_id:string>>")["findings"]
    return bundle.select(
        "project_id", "round", "part", F.col("n_findings").cast("long").alias("n_findings"), back[0]["comment_number"].alias("first_number"),
        F.element_at(back, -1)["finding_id"].alias("last_finding"))


def acted_letter(t: Tables):
    """Letters of the findings that reviewers let through: a return flag A approves, R edits, N of a finished order rejects."""
    kind = F.when(F.col("l_returnflag") == "A", "approve").when(F.col("l_returnflag") == "R", "edit").when(F.col("l_linestatus") == "F", "reject")
    flags = t.lineitem.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("finding_id"), kind.alias("kind"))
    # the rows of an id are counted once by their action; a finding meets each of them, and so does an action
    told = ["approve", "edit", "reject"]
    marks = flags.groupBy("finding_id").agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in told], F.count(F.when(F.col("kind").isNull(), 1)).alias("none"))
    n = sum((F.col(k) for k in told), F.col("none"))
    each = lambda n: F.explode(F.sequence(F.lit(1).cast("long"), n))
    f = findings(t).join(growing(marks), "finding_id").withColumn("copy", each(n)).drop("copy", "none", *told)
    f = f.withColumn("draft_comment_text", F.concat(F.lit("Comment "), F.col("finding_id"))).withColumn(
        "crop_uri", F.when(F.col("l_orderkey") % 4 != 0, F.concat(F.lit("crops/"), F.col("project_id").cast("string"), F.lit("/"), F.col("finding_id"), F.lit(".png"))))
    ways = F.filter(F.array(*[F.struct(F.lit(k).alias("action"), (F.col(k) * n).alias("n")) for k in told]), lambda w: w["n"] > 0)
    acts = marks.select("finding_id", F.explode(ways).alias("w")).select("finding_id", "w.action", each(F.col("w.n")).alias("copy")).select(
        F.col("finding_id").alias("action_id"), "finding_id", "action", F.concat(F.lit("Edited "), F.col("finding_id")).alias("text"),
        F.lit("2024-01-01").cast("timestamp").alias("created_at"))
    state = rv.current_state(f, acts)
    return rv.assembled_letter(state, ["project_id", "round"], ["sheet_id", "finding_id"],
                               ["project_id", "round", "finding_id", "discipline", "sheet_id", "comment_text", "crop_uri", "style"]).withColumn("response", F.lit(""))


SQL_SENT = f"""{SQL_FINDINGS}, acted AS (SELECT f.*, l.l_returnflag FROM f JOIN (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS finding_id, l_returnflag FROM lineitem) l USING (finding_id) WHERE l_returnflag IN ('A', 'R')),
sent AS (SELECT project_id, round, finding_id, discipline, sheet_id, row_number() OVER (PARTITION BY project_id, round ORDER BY dr, sheet_id, finding_id) AS comment_number,
  CASE l_returnflag WHEN 'R' THEN 'Edited ' ELSE 'Comment ' END || finding_id AS comment_text,
  CASE WHEN l_orderkey % 4 <> 0 THEN 'crops/' || project_id || '/' || finding_id || '.png' END AS crop_uri,
  CASE round - min(round) OVER (PARTITION BY project_id, discipline, rule_id, sheet_id, tag) WHEN 0 THEN 'italic' WHEN 1 THEN 'bold' ELSE 'underlined' END AS style FROM acted)"""


@query("C24 M21", f"WITH {SQL_SENT} SELECT *, '' AS response FROM sent")
def letter_full(t: Tables):
    return acted_letter(t).select("project_id", "round", "finding_id", "discipline", "sheet_id", "comment_number", "comment_text", "crop_uri", "style", "response")


@query("A14 M21 C24", f"""WITH {SQL_SENT}, h AS (SELECT s_suppkey AS project_id, r.round, s_suppkey * 10 + r.round AS submittal_id, n_name AS jurisdiction, 'v' || n_regionkey AS pack_version, 'B' || s_suppkey AS permit_number,
  s_name AS description FROM supplier JOIN nation ON n_nationkey = s_nationkey, (SELECT unnest(range(1, 9)) AS round) r)
SELECT h.project_id, h.round, coalesce((comment_number - 1) // 25 + 1, 1) AS part, count(finding_id) AS n_findings, submittal_id::VARCHAR AS submittal_id, jurisdiction, pack_version, jurisdiction AS city, h.round AS review_round,
  permit_number, description, md5(coalesce(string_agg(comment_number || ' ' || comment_text || ' ' || style || ' ' || coalesce(crop_uri, '-'), chr(10) ORDER BY comment_number), '')) AS comments_md5
FROM h LEFT JOIN sent ON sent.project_id = h.project_id AND sent.round = h.round GROUP BY ALL""")
def letter_bundle_full(t: Tables):
    """Bundles with letterhead, project block and instructions, read back from their JSON; a round without comments has one too."""
    number = F.col("round").cast("string")
    headers = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey")).withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(8)))).select(
        F.col("s_suppkey").alias("project_id"), "round", (F.col("s_suppkey") * 10 + F.col("round")).cast("string").alias("submittal_id"), F.col("round").alias("review_round"),
        F.col("n_name").alias("jurisdiction"), F.concat(F.lit("v"), F.col("n_regionkey").cast("string")).alias("pack_version"), F.concat(F.lit("2024-01-0"), number, F.lit("T00:00:00Z")).alias("generated_at"),
        F.struct(F.col("n_name").alias("city"), number.alias("review_round")).alias("letterhead"),
        F.struct(F.col("s_name").alias("description"), F.concat(F.lit("B"), F.col("s_suppkey").cast("string")).alias("permit_number")).alias("project_block"),
        F.lit("Respond to each comment and cloud all revisions.").alias("general_instructions"), F.struct(F.lit("reviewer").alias("role")).alias("signature_block"))
    rows = acted_letter(t).select("project_id", "round", "comment_number", "finding_id", "comment_text", "style", "crop_uri", "response")
    back = F.from_json("bundle", """submittal_id string, jurisdiction string, pack_version string, review_round int, letterhead struct<city:string>, project_block struct<permit_number:string, description:string>,
        findings array<struct<comment_number:bigint, comment_text:string, style:string, crop_uri:string>>""")
    line = lambda c: F.concat_ws(" ", c["comment_number"].cast("string"), c["comment_text"], c["style"], F.coalesce(c["crop_uri"], F.lit("-")))
    return rv.full_bundle(rows, headers, ["project_id", "round"], 25).withColumn("b", back).select(
        "project_id", "round", "part", F.col("n_findings").cast("long").alias("n_findings"), "b.submittal_id", "b.jurisdiction", "b.pack_version", "b.letterhead.city", "b.review_round",
        "b.project_block.permit_number", "b.project_block.description", F.md5(F.array_join(F.transform("b.findings", line), "\n").cast("binary")).alias("comments_md5"))


@query("F4 F5 H27", f"""WITH {SQL_FINDINGS}, q AS (SELECT * FROM f)
SELECT project_id, round, finding_id, CASE severity WHEN 'revise' THEN 'attention' WHEN 'reference_only' THEN 'optional' ELSE 'recommend' END AS label,
  row_number() OVER (PARTITION BY project_id, round ORDER BY list_position(['revise', 'provide', 'clarify', 'reference_only'], severity), confidence, finding_id) AS queue_position FROM q""")
def remediation_queue(t: Tables):
    q = rv.remediation_queue(findings(t), ["project_id", "round"], "finding_id")
    return q.select("project_id", "round", "finding_id", r.designer_severity(F.col("severity")).alias("label"), "queue_position")


SQL_CHECK = """q AS (SELECT item_id, item_id * 60 AS sheet, CASE WHEN item_id % 2 = 0 THEN '>=' ELSE '<=' END AS cmp, CASE WHEN item_id % 2 = 0 THEN item_id % 4 ELSE 46 + item_id % 5 END AS threshold FROM benchmark),
m AS (SELECT l_partkey AS sheet, min(l_quantity) AS lo, max(l_quantity) AS hi, min(1 - l_discount::DECIMAL(4,2))::DOUBLE AS c FROM lineitem GROUP BY 1),
j AS (SELECT q.*, CASE WHEN cmp = '>=' THEN lo ELSE hi END AS value, c FROM q LEFT JOIN m USING (sheet)),
s AS (SELECT *, CASE WHEN value IS NULL THEN 'unknown' WHEN c < 0.9 AND item_id % 3 = 0 THEN 'amber' WHEN (cmp = '>=' AND value >= threshold) OR (cmp = '<=' AND value <= threshold) THEN 'green' ELSE 'red' END AS status FROM j)"""


def checklist(t: Tables):
    i = F.col("item_id")
    questions = t.benchmark.select(
        i, (i * 60).alias("sheet"), F.when(i % 2 == 0, ">=").otherwise("<=").alias("comparison"), F.when(i % 2 == 0, i % 4).otherwise(46 + i % 5).alias("threshold"),
        F.when(i % 3 == 0, 0.9).otherwise(0.0).alias("min_confidence"))
    measures = t.lineitem.select(
        F.col("l_partkey").alias("sheet"), F.col("l_quantity").alias("value"), (F.lit(1) - F.col("l_discount").cast("decimal(4,2)")).cast("double").alias("confidence"))
    return rv.checklist_answers(questions, measures, ["sheet"])


@query("M22 A12", f"WITH {SQL_CHECK} SELECT item_id, value, status FROM s")
def checklist_status(t: Tables):
    return checklist(t).select("item_id", "value", "status")


@query("M22 F4", f"WITH {SQL_CHECK} SELECT item_id, 0 AS review_round, 'attention' AS designer_severity FROM s WHERE status = 'red'")
def checklist_red_findings(t: Tables):
    return rv.red_findings(checklist(t)).select("item_id", "review_round", "designer_severity")
