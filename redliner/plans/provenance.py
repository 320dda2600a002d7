"""Whole finding records: evidence, citations with the text that was in force, round and extractor versions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redliner.operators.scan import every, paged
from redliner.plans import codekb as kb
from redliner.plans import rules
from redliner.plans.findings import finding
from redliner.session import durable, growing

def _evidence(entity: Column | None = None, bbox: Column | None = None, crop: Column | None = None, measurement: Column | None = None,
              value: Column | None = None, unit: str | None = None, confidence: Column | None = None, trace: Column | None = None) -> Column:
    """One item of evidence; entities and measurements share the struct, the other kind's fields are null."""
    given = lambda c, kind: (F.lit(None) if c is None else c).cast(kind)
    return F.struct(
        given(entity, "string").alias("entity_id"), given(bbox, "array<double>").alias("bbox"), given(crop, "string").alias("raster_crop_uri"),
        given(measurement, "string").alias("measurement_id"), given(value, "double").alias("value"), F.lit(unit).cast("string").alias("unit"),
        given(confidence, "double").alias("confidence"), given(trace, "array<string>").alias("trace"))


def seen_entity(entity: Column, bbox: Column, crop: Column | None = None) -> Column:
    return _evidence(entity=entity, bbox=bbox, crop=crop)


def measured(measurement: Column, value: Column, unit: str, confidence: Column, trace: Column | None = None) -> Column:
    return _evidence(measurement=measurement, value=value, unit=unit, confidence=confidence, trace=trace)


def latest_submittals(submittals: DataFrame) -> DataFrame:
    """The submittal under review of each project: the last round, ties to the greatest id."""
    rest = [c for c in submittals.columns if c != "project_id"]
    best = submittals.groupBy("project_id").agg(F.max_by(F.struct(*rest), F.struct("review_round", "submittal_id")).alias("s"))
    return best.select("project_id", "s.*")


def best_measures(measures: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The most confident measurement of each key, ties to the smallest id; null confidence comes last."""
    rest = [c for c in measures.columns if c not in keys]
    order = F.struct(F.col("confidence").isNull(), -F.col("confidence"), F.col("measurement_id"))
    best = measures.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("m"))
    return best.select(*keys, "m.*")


def frozen_citations(requests: DataFrame, sections: DataFrame, amendments: DataFrame, code: str, section: str, per_part: int = 1000) -> DataFrame:
    """(KEY, part, cited, section_confidence): the text in force on each key's day, as it then stood.

    Keys without a section in force have no row. ``sections`` may bring a
    ``confidence``, otherwise it is 1. A text of more than ``per_part`` fragments
    goes on in the next part, with the amendments of its own fragments.
    """
    keys = requests.select(*kb.KEY).distinct()
    known = sections if "confidence" in sections.columns else sections.withColumn("confidence", F.lit(1.0))
    base = durable(kb.section_as_of(keys, known, ("section_id", "body_text", "confidence")).filter(F.col("section_id").isNotNull()))
    fragments = kb.folded_fragments(base, base, amendments)
    pages = paged(fragments.filter(F.col("fragment").isNotNull()), kb.KEY, [F.col("pos")], every(F.col("pos"), 10_000),
                  F.struct("fragment", F.col("amendment_id").cast("string").alias("amendment_id")), per_part, "pieces")
    applied = F.transform(F.filter("pieces", lambda p: p["amendment_id"].isNotNull()), lambda p: p["amendment_id"])
    step = lambda kind, ref: F.struct(F.lit(kind).alias("kind"), ref.cast("string").alias("ref"))
    citation = F.struct(
        F.lit(code).alias("code"), F.lit(section).alias("section"), F.col("jurisdiction"), F.col("effective_date").cast("date").alias("effective_date"),
        F.array_join(F.transform("pieces", lambda p: p["fragment"]), "\n").alias("frozen_text"),
        F.concat(F.array(step("state_section", F.col("section_id"))), F.transform(applied, lambda a: step("amendment", a))).alias("retrieval_chain"),
        applied.alias("amendments_applied"))
    return pages.join(growing(base.withColumnRenamed("confidence", "section_confidence")), kb.KEY).select(*kb.KEY, "part", citation.alias("cited"), "section_confidence")


def full_findings(found: DataFrame, citations: DataFrame) -> DataFrame:
    """Finding records, one row per finding and part of its cited text.

    ``found``: the columns of ``finding``, the lookup key of its section, submittal_id,
    review_round, created_at, evidence and extractor_versions_used. Confidence
    is that of the weakest input, the section included. A finding whose section
    is not in force stays, with part 1, no citation and a call for attention.
    """
    both = found.join(growing(citations), kb.KEY, "left")
    return both.select(
        "finding_id", "project_id", "submittal_id", "review_round", "discipline", "rule_id", "rule_version",
        F.lit(None).cast("string").alias("llm_reasoner_id"), F.lit(None).cast("string").alias("prompt_hash"), "severity", "requires_licensed_review",
        F.struct("sheet_id", F.lit(None).cast("string").alias("detail")).alias("sheet_reference"), "evidence",
        F.coalesce("part", F.lit(1)).cast("int").alias("part"),
        F.array_compact(F.array("cited")).alias("citations"),
        "draft_comment_text", F.least("confidence", "section_confidence").alias("confidence"),
        (F.col("needs_attention") | F.col("cited").isNull()).alias("needs_attention"), "created_at", "extractor_versions_used")


def egress_findings(context: Mapping[str, DataFrame]) -> DataFrame:
    """ARCH-EGRESS-010 over rooms, windows, window measures and the section in force, as whole records.

    ``rooms``: room_id, project_id, room_label, room_use, is_new. ``windows``:
    window_id, room_id, sheet_id, tag, bbox, extractor_version. ``specs``:
    measurement_id, sheet_id, tag, nco_sqft, confidence, trace,
    extractor_version. ``submittals``: project_id, submittal_id, review_round,
    canonical_id of the section, jurisdiction, as_of, created_at. ``sections``
    and ``amendments`` as for lookups. Windows without a measure, room or
    submittal give no finding.
    """
    specs = best_measures(context["specs"].withColumnRenamed("extractor_version", "spec_version"), ["sheet_id", "tag"])
    rooms = context["rooms"].filter((F.col("room_use") == "bedroom") & F.col("is_new"))
    joined = context["windows"].join(growing(rooms), "room_id").join(growing(specs), ["sheet_id", "tag"])
    # the section's confidence is known after the lookup and joins the weakest input there
    broken, text, window = rules.egress_window()
    hits = joined.filter(broken).join(growing(latest_submittals(context["submittals"])), "project_id")
    record = finding("ARCH-EGRESS-010", "architectural", "revise", text, window, F.col("confidence"), "CRC-R310.2.1")
    evidence = F.array(
        seen_entity(F.col("window_id"), F.col("bbox")),
        measured(F.col("measurement_id"), F.col("nco_sqft"), "sqft", F.col("confidence"), F.col("trace")))
    found = durable(hits.select(
        record.alias("f"), *kb.KEY, "submittal_id", "review_round", "created_at", evidence.alias("evidence"),
        F.array_sort(F.array_distinct(F.array("extractor_version", "spec_version"))).alias("extractor_versions_used"),
    ).select("f.*", *kb.KEY, "submittal_id", "review_round", "created_at", "evidence", "extractor_versions_used"))
    return full_findings(found, frozen_citations(found, context["sections"], context["amendments"], "CRC", "R310.2.1"))
