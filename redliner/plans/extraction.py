"""Title-block extraction and plan-set ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redliner.functions import titleblock as tb
from redliner.functions.geometry import box, boxes_union, mean_nonzero
from redliner.functions.review import canonical_sheet, sheet_discipline, sheet_number, sheet_type
from redliner.functions.text import address_differs, sheet_key, stable_id
from redliner.operators.keyed import changed, latest_per_key
from redliner.sources.documents import append_versioned, build_sheets, dedupe_ledger


def extract_title_blocks(pages: DataFrame, responses: DataFrame | None, vision_on: bool | None = None) -> DataFrame:
    """One title-block entity per page.

    ``pages``: document_id, page, width, height, spans (array of ord,
    block_type, text, bbox), full_text, images (array of w, h) and
    canonical_address. ``responses``: document_id, page, response_json. The
    spans travel inside the page row, so the text track needs no shuffle; the
    only join is the one with the recorded answers.
    """
    rows = pages
    if responses is not None:
        # one answer per page: the last recorded text wins
        one = responses.groupBy("document_id", "page").agg(F.max("response_json").alias("response_json"))
        rows = rows.join(one, ["document_id", "page"], "left")
    else:
        rows = rows.withColumn("response_json", F.lit(None).cast("string"))
    w, h = F.col("width"), F.col("height")
    rows = rows.withColumn("__spans", tb.spans_in_clip(F.col("spans"), w, h)).withColumn(
        "__answer", tb.parse_response(F.col("response_json"))
    )
    rows = rows.withColumn("__text", tb.joined_text(F.col("__spans")))
    # A column for each field and step: fields that nobody reads are left out, and no step is computed twice.
    rows = rows.withColumns({f"__low_{f}": tb.label_value(F.col("__text"), f) for f in tb.FIELDS})
    rows = rows.withColumns({f"__home_{f}": tb.home_span(F.col(f"__low_{f}"), F.col("__spans")) for f in tb.FIELDS})
    rows = rows.withColumns({f"__value_{f}": tb.spelled(F.col(f"__low_{f}"), F.col(f"__home_{f}")) for f in tb.FIELDS})
    rows = rows.withColumns({f: tb.text_field(F.col(f"__value_{f}"), F.col(f"__home_{f}")) for f in tb.FIELDS})
    if responses is not None:
        rows = rows.withColumns({f"__seen_{f}": tb.vision_field(F.col("__answer")[f], w, h) for f in tb.FIELDS})
        both = {f: tb.merged_field(F.col(f), F.col(f"__seen_{f}")) for f in tb.FIELDS}
        rows = rows.withColumns({f: F.when(F.col("__answer").isNull(), F.col(f)).otherwise(both[f]) for f in tb.FIELDS})
    scored = F.array(*tb.SCORED_FIELDS)
    whole = boxes_union(F.transform(scored, lambda f: f["bbox"]))
    track = F.lit("merged" if (responses is not None if vision_on is None else vision_on) else "text")
    return rows.select(
        "document_id",
        "page",
        sheet_key(F.col("document_id"), F.col("page")).alias("sheet_id"),
        stable_id("title_block", F.col("document_id"), F.col("page"), F.lit(tb.VERSION)).alias("entity_id"),
        F.lit("title_block").alias("type"),
        *tb.FIELDS,
        tb.stamp_present(F.col("full_text"), F.col("images")).alias("stamp_present"),
        address_differs(F.col("project_address")["value"], F.col("canonical_address")).alias("address_mismatch"),
        mean_nonzero(F.transform(scored, lambda f: f["confidence"])).alias("confidence"),
        F.coalesce(whole, box(F.lit(0.0), F.lit(0.0), w, h * 0.35)).alias("bbox"),
        F.lit(f"title_block:{tb.VERSION}").alias("extractor_version"),
        track.alias("source_track"),
    )


def entity_payload() -> Column:
    return F.to_json(F.struct(*tb.FIELDS, "stamp_present", "address_mismatch"))


def ingest_plan_set(documents: DataFrame, pages: DataFrame, responses: DataFrame | None, call_log: DataFrame | None, root: str) -> DataFrame:
    """Append the new documents of a batch with their sheets, entities and call log under ``root``.

    ``documents``: document_id, content_hash, pages (array of width, height).
    Copies inside the batch and documents known by hash are skipped. A second
    run over the same batch adds nothing. Returns the ledger.
    """
    from pyspark.errors import AnalysisException

    spark = documents.sparkSession
    try:
        known = spark.read.parquet(f"{root}/documents")
        known.schema  # noqa: B018 - resolves the path now
    except AnalysisException:
        known = None
    ledger = dedupe_ledger(documents, known, "document_id")
    kept = ledger.filter(~F.col("skipped")).select(F.col("kept_id").alias("document_id"))
    fresh = documents.join(kept, "document_id", "left_semi")
    fresh_pages = pages.join(kept, "document_id", "left_semi")
    entities = extract_title_blocks(fresh_pages, responses).withColumn("payload", entity_payload()).drop(*tb.FIELDS)
    # The documents table is written last: it is what marks a batch as done.
    append_versioned(build_sheets(fresh), f"{root}/sheets", ["sheet_id"])
    append_versioned(entities, f"{root}/entities", ["sheet_id", "extractor_version"], ["type"])
    if call_log is not None:
        append_versioned(call_log, f"{root}/call_log", ["call_id"])
    append_versioned(fresh.drop("pages"), f"{root}/documents", ["content_hash"])
    return ledger


def sheet_identity(blocks: DataFrame) -> DataFrame:
    """Discipline, number, canonical id and type of each sheet."""
    raw, title = F.col("sheet_raw"), F.col("sheet_title")
    return blocks.withColumns(
        {
            "discipline_letter": sheet_discipline(raw),
            "sheet_number": sheet_number(raw),
            "canonical_id": canonical_sheet(raw),
            "sheet_type": sheet_type(title),
        }
    )


def extraction_diff(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Differences between two extractor versions, newest row per key on each side."""
    def newest(df: DataFrame) -> DataFrame:
        return latest_per_key(df.select(*keys, value, "created_at", "entity_id"), keys, [F.col("created_at"), F.col("entity_id")])

    return changed(newest(old), newest(new), keys, value)
