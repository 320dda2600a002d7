"""Domain, range, shape and reference checks that report instead of failing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Allowed words per enumerated column.
DOMAINS = {
    "tenants.kind": ["reviewer_firm", "design_firm", "ahj"],
    "users.role": ["reviewer", "senior_reviewer", "admin", "designer"],
    "submittals.kind": ["initial", "resubmittal", "deferred"],
    "documents.doc_type": [
        "plan_set", "title24_report", "plan_check_letter", "narrative",
        "question_checklist", "deferred_submittal", "supporting_doc",
    ],
    "sheets.pdf_quality_class": ["vector", "hybrid", "raster", "low_quality_scan"],
    "entities.source_track": ["text", "vision", "merged"],
    "amendments.operation": ["replace", "append", "override", "insert_before", "insert_after"],
    "findings.severity": ["revise", "provide", "clarify", "reference_only"],
    "findings.approval_state": ["pending", "approved", "edited", "merged", "split", "rejected"],
    "external_review_comments.typography": ["italic", "bold", "underlined"],
    "reviewer_actions.action": ["approve", "edit", "merge", "split", "reject", "override"],
}


def in_domain(column: str, domain: str) -> Column:
    """Null passes, as a CHECK constraint lets it."""
    return F.col(column).isNull() | F.col(column).isin(DOMAINS[domain])


def between(column: str, low: float, high: float) -> Column:
    return F.col(column).isNull() | F.col(column).between(low, high)


def at_least(column: str, low: float) -> Column:
    return F.col(column).isNull() | (F.col(column) >= low)


def required(column: str) -> Column:
    return F.col(column).isNotNull()


def has_text(column: str) -> Column:
    return F.col(column).isNotNull() & (F.length(column) >= 1)


def box_shape(column: str) -> Column:
    return F.col(column).isNotNull() & (F.size(column) == 4)


def violations(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """Count rows failing each named check, in one pass over the data."""
    counts = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("violations")) for n in checks])
    return counts.select(F.inline(pairs))


def bad_rows(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """Rows failing at least one check with the names of the failed checks."""
    names = F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()])
    return df.withColumn("failed", F.array_compact(names)).filter(F.size("failed") > 0)


def orphan_count(child: DataFrame, column: str, parent: DataFrame, key: str, name: str) -> DataFrame:
    """Rows of ``child`` whose non-null reference has no parent.

    References are counted per value first, so a hot value is one row in the join.
    """
    refs = child.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("__ref")).agg(
        F.count(F.lit(1)).alias("__n")
    )
    missing = refs.join(parent.select(F.col(key).alias("__ref")).distinct(), "__ref", "left_anti")
    return missing.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("violations")).select(
        F.lit(name).alias("check"), "violations"
    )


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
