"""Reviewer actions, rounds, letters and checklist answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redliner.functions.review import DISCIPLINE_ORDER, designer_severity, discipline_rank, severity_rank, typography
from redliner.operators.keyed import latest_per_key
from redliner.operators.scan import every, numbered, ordered_scan, paged, position
from redliner.session import dense, growing

# State after each action; an override keeps the state.
STATE_AFTER = {"approve": "approved", "edit": "edited", "merge": "merged", "split": "split", "reject": "rejected"}
ISSUE = ["project_id", "discipline", "rule_id", "sheet_id", "tag"]
DISCLAIMER = "Draft prepared for review by a licensed professional; not an approval."


def current_state(findings: DataFrame, actions: DataFrame) -> DataFrame:
    """Findings with the state of their latest action, the final text of their latest edit and the action count.

    ``actions``: action_id, finding_id, action, text, created_at.
    """
    pairs = [F.lit(x) for item in STATE_AFTER.items() for x in item]
    told = actions.withColumn("state", F.try_element_at(F.create_map(*pairs), F.col("action"))).filter(F.col("state").isNotNull())
    at = F.struct("created_at", "action_id")
    per = told.groupBy("finding_id").agg(
        F.max_by("state", at).alias("state"),
        F.max_by("text", F.when(F.col("action") == "edit", at)).alias("final_text"),
        F.count(F.lit(1)).alias("n_actions"),
        F.min("created_at").alias("first_action_at"),
        F.max("created_at").alias("last_action_at"),
    )
    return findings.join(per, "finding_id", "left").select(
        *findings.columns, F.coalesce("state", F.lit("pending")).alias("approval_state"), "final_text",
        F.coalesce("n_actions", F.lit(0)).cast("long").alias("n_actions"), "first_action_at", "last_action_at",
    )


def batch_actions(findings: DataFrame, reject_below: float | None = 0.7, approve_discipline: str | None = None) -> DataFrame:
    """Action rows of a batch decision over pending findings. Licensed findings are never approved in a batch."""
    pending = findings.filter(F.col("approval_state") == "pending")
    action = F.lit(None).cast("string")
    if approve_discipline is not None:
        action = F.when((F.col("discipline") == approve_discipline) & ~F.col("requires_licensed_review"), "approve")
    if reject_below is not None:
        action = F.when(F.col("confidence") < reject_below, "reject").otherwise(action)
    return pending.withColumn("action", action).filter(F.col("action").isNotNull()).select("finding_id", "action")


def unacted(findings: DataFrame, actions: DataFrame) -> DataFrame:
    return findings.join(actions.select("finding_id").distinct(), "finding_id", "left_anti")


def compare_rounds(previous: DataFrame, current: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Issues of two rounds: re-raised, closed or new, with the round they were first raised in."""
    keys = keys or ISSUE
    p = previous.groupBy(*keys).agg(F.min("round").alias("prev_round"))
    c = current.groupBy(*keys).agg(F.max("round").alias("this_round"))
    both = p.join(c, keys, "full_outer")
    status = F.when(F.col("this_round").isNull(), "closed").when(F.col("prev_round").isNull(), "new").otherwise("re-raised")
    return both.select(*keys, status.alias("status"), F.coalesce("prev_round", "this_round").alias("first_round"))


def issue_ages(findings: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Findings with the first round of their issue, its age and the letter style that follows."""
    keys = keys or ISSUE
    first = findings.groupBy(*keys).agg(F.min("round").alias("first_round"))
    aged = findings.join(first, keys).withColumn("age", F.col("round") - F.col("first_round"))
    return aged.withColumn("typography", typography(F.col("age")))


def number_letter(findings: DataFrame, keys: list[str], within: list[str], chunk: Column | None = None) -> DataFrame:
    """Letter-wide numbers from 1 across the disciplines in their fixed order.

    ``within`` orders the comments of a discipline. A ``chunk`` that follows the
    first of these columns may cut the letter; without one it is cut evenly.
    """
    ranked = findings.withColumn("discipline_rank", discipline_rank(F.col("discipline")))
    order = [F.col("discipline_rank"), *[F.col(c) for c in within]]
    if chunk is None:
        return numbered(ranked, keys, order, "comment_number")
    return ordered_scan(ranked, keys, order, F.struct(F.col("discipline_rank"), chunk), {"comment_number": position()})


def letter_bundle(letter: DataFrame, keys: list[str], per_part: int = 500) -> DataFrame:
    """JSON bundle per project and round with nested findings.

    A letter of up to ``per_part`` comments is one object; a longer one has
    several, each naming its part, with every comment in exactly one of them.
    """
    item = F.struct(*[F.col(c) for c in letter.columns if c not in keys])
    parts = paged(letter, keys, [F.col("comment_number")], every(F.col("comment_number"), 10_000), item, per_part, "findings")
    style = F.struct(F.lit("italic").alias("round_1"), F.lit("bold").alias("round_2"), F.lit("underlined").alias("round_3"))
    body = F.to_json(F.struct(*keys, "part", F.lit(DISCLAIMER).alias("disclaimer"), style.alias("round_typography"), "findings"))
    return parts.select(*keys, "part", F.size("findings").alias("n_findings"), body.alias("bundle"))


def assembled_letter(findings: DataFrame, keys: list[str], within: list[str], columns: list[str] | None = None) -> DataFrame:
    """The comments of each letter: approved and edited findings only, styled, numbered through, with text, crop and response slot.

    ``findings``: the issue columns, discipline, approval_state, final_text,
    draft_comment_text and crop_uri (null where a finding has no box). The style
    follows the round in which an issue was first sent. ``columns``: those that
    the letter needs beside its number, by default all; no others are written
    for the numbering or shuffled before it.
    """
    rows = letter_rows(findings)
    if columns is not None:
        needed = {*ISSUE, "round", "discipline", *keys, *within, *columns}
        rows = rows.select(*[c for c in rows.columns if c in needed])
    # written, as the ages are taken from the rows that they are joined with
    sent = issue_ages(dense(rows)).withColumn("style", F.col("typography")).drop("typography")
    if columns is not None:
        needed = list(dict.fromkeys([*keys, *within, "discipline", *columns]))
        return number_letter(sent.select(*needed), keys, within).select(*columns, "comment_number")
    return number_letter(sent, keys, within)


def full_bundle(letter: DataFrame, headers: DataFrame, keys: list[str], per_part: int = 500) -> DataFrame:
    """JSON bundle of every letter with its header, also of a letter without comments.

    ``letter``: comments numbered from 1, as ``number_letter`` does. ``headers``: one row per letter with the keys, submittal_id, jurisdiction,
    pack_version, generated_at, letterhead, project_block, general_instructions
    and signature_block (the blocks as structs). A letter of more than
    ``per_part`` comments continues in further parts under the same header.
    """
    item = F.struct(*[F.col(c) for c in letter.columns if c not in keys])
    # the comments are numbered already, so their number tells the part
    of = F.floor((F.col("comment_number") - 1) / per_part) + 1
    listed = F.array_sort(F.collect_list(F.struct(F.col("comment_number").alias("n"), item.alias("item"))))
    parts = letter.groupBy(*keys, of.alias("part")).agg(listed.alias("__p")).select(*keys, "part", F.transform("__p", lambda x: x["item"]).alias("findings"))
    # headers go to the parts, which stay where they were put together
    last = letter.groupBy(*keys).agg(F.max(of).alias("last"))
    headers = headers.join(growing(last), keys, "left").withColumn("part", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("last", F.lit(1))))).drop("last")
    style = F.struct(F.lit("italic").alias("round_1"), F.lit("bold").alias("round_2"), F.lit("underlined").alias("round_3"))
    whole = headers.join(growing(parts), [*keys, "part"], "left").withColumns({
        "findings": F.coalesce("findings", F.array().cast(parts.schema["findings"].dataType)), "round_typography": style, "disclaimer": F.lit(DISCLAIMER)})
    body = F.to_json(F.struct(*[c for c in whole.columns if c != "findings"], "findings"))
    return whole.select(*keys, "part", F.size("findings").alias("n_findings"), body.alias("bundle"))


def write_letter_bundle(bundle: DataFrame, path: str) -> None:
    bundle.select("bundle").write.mode("append").text(path)


def letter_rows(findings: DataFrame) -> DataFrame:
    """Approved or edited findings with their final text, style and response slot."""
    sent = findings.filter(F.col("approval_state").isin("approved", "edited"))
    return sent.withColumn("comment_text", F.coalesce("final_text", "draft_comment_text")).withColumn("response", F.lit(""))


def checklist_answers(questions: DataFrame, measures: DataFrame, keys: list[str]) -> DataFrame:
    """Green, amber, red or unknown per question.

    ``questions``: the keys, comparison, threshold and min_confidence.
    ``measures``: the keys, value and confidence. The weakest value decides: the
    smallest for a lower limit, the largest for an upper one; for "=" all values
    must equal the threshold. Any other comparison, or none, is "unknown".
    """
    per = measures.groupBy(*keys).agg(
        F.min("value").alias("lowest"), F.max("value").alias("highest"), F.min("confidence").alias("confidence")
    )
    both = questions.join(per, keys, "left")
    how, limit = F.col("comparison"), F.col("threshold")
    off = F.col("lowest") != limit
    value = F.when(how == ">=", F.col("lowest")).when(how == "<=", F.col("highest")).when(how == "=", F.when(off, F.col("lowest")).otherwise(F.col("highest")))
    ok = F.when(how == ">=", value >= limit).when(how == "<=", value <= limit).otherwise(value == limit)
    status = (
        F.when(value.isNull() | limit.isNull(), "unknown").when(F.col("confidence") < F.col("min_confidence"), "amber").when(ok, "green").otherwise("red")
    )
    return both.withColumn("value", value).withColumn("status", status).drop("lowest", "highest")


def red_findings(answers: DataFrame, severity: str = "revise") -> DataFrame:
    """Red answers as findings of round 0 for the designer."""
    return answers.filter(F.col("status") == "red").withColumns(
        {"review_round": F.lit(0), "severity": F.lit(severity), "designer_severity": designer_severity(F.lit(severity))}
    )


def remediation_queue(findings: DataFrame, keys: list[str], row_id: str) -> DataFrame:
    """Queue position by severity, then lowest confidence."""
    ranked = findings.withColumn("severity_rank", severity_rank(F.col("severity")))
    order = [F.col("severity_rank"), F.col("confidence"), F.col(row_id)]
    return ordered_scan(ranked, keys, order, None, {"queue_position": position()})


def open_badges(findings: DataFrame) -> DataFrame:
    """Pending findings per sheet."""
    return findings.filter(F.col("approval_state") == "pending").groupBy("sheet_id").agg(F.count(F.lit(1)).alias("open_findings"))


def latest_round(submittals: DataFrame) -> DataFrame:
    return latest_per_key(submittals, ["project_id"], [F.col("round_number"), F.col("submittal_id")])


def discipline_order() -> list[str]:
    return list(DISCIPLINE_ORDER)
