"""Read queries over projects, submittals, documents, sheets and entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redliner.functions.review import confidence_color, confidence_percent
from redliner.functions.text import page_label
from redliner.operators.keyed import latest_per_key
from redliner.operators.scan import every, paged


def sheets_of_projects(sheets: DataFrame, documents: DataFrame, submittals: DataFrame) -> DataFrame:
    """Sheets with their project, through documents and submittals."""
    return sheets.join(documents, "document_id").join(submittals, "submittal_id")


def sheet_counts(projects: DataFrame, submittals: DataFrame, documents: DataFrame, sheets: DataFrame) -> DataFrame:
    """Distinct sheets per project, 0 for projects without any.

    Sheets are counted per project before the projects join, so the wide
    project rows meet one row per project instead of one per sheet.
    """
    counts = (
        sheets_of_projects(sheets, documents, submittals)
        .groupBy("project_id")
        .agg(F.countDistinct("sheet_id").alias("sheet_count"))
    )
    return projects.join(counts, "project_id", "left").withColumn(
        "sheet_count", F.coalesce("sheet_count", F.lit(0)).cast("long")
    )


def tenant_scope(df: DataFrame, projects: DataFrame, tenant_id) -> DataFrame:
    """Rows of the tenant's projects only."""
    own = projects.filter(F.col("tenant_id") == tenant_id).select("project_id")
    return df.join(own, "project_id", "left_semi")


def sheet_of_project(sheets: DataFrame, project_id, sheet_id) -> DataFrame:
    """One sheet guarded by its project; empty when the pair does not belong together."""
    return sheets.filter((F.col("sheet_id") == sheet_id) & (F.col("project_id") == project_id))


def first_sheet(sheets: DataFrame, keys: list[str]) -> DataFrame:
    """First sheet of each group by page."""
    return sheets.groupBy(*keys).agg(
        F.min_by("sheet_id", F.struct("page", "sheet_id")).alias("first_sheet_id"), F.min("page").alias("first_page")
    )


def entities_of_sheets(entities: DataFrame, sheets: DataFrame, kind: str | None = None) -> DataFrame:
    """Entities whose sheet is in the given list, optionally of one type."""
    chosen = entities if kind is None else entities.filter(F.col("type") == kind)
    return chosen.join(sheets.select("sheet_id"), "sheet_id", "left_semi")


def with_title_block(sheets: DataFrame, entities: DataFrame) -> DataFrame:
    """Every sheet with the payload of its newest title block, null when it has none."""
    blocks = entities.filter(F.col("type") == "title_block").select(
        "sheet_id", "entity_id", "payload", "created_at", "confidence"
    )
    newest = latest_per_key(blocks, ["sheet_id"], [F.col("created_at"), F.col("entity_id")])
    return sheets.join(newest, "sheet_id", "left")


def active_versions(registry: DataFrame, at: Column) -> DataFrame:
    """Registry rows deployed and not deprecated at a moment."""
    return registry.filter((F.col("deployed_at") <= at) & (F.col("deprecated_at").isNull() | (F.col("deprecated_at") > at)))


def json_text(path: str) -> Column:
    return F.get_json_object("payload", path)


def sheet_rail(sheets: DataFrame, keys: list[str], page_size: int = 500) -> DataFrame:
    """Sheets nested by discipline, unknown disciplines under a dash."""
    named = sheets.withColumn("discipline", F.coalesce("discipline_letter", F.lit("—")))
    return paged(
        named, [*keys, "discipline"], [F.col("page"), F.col("sheet_id")], every(F.col("page"), 1000),
        F.struct("sheet_id", "page", page_label(F.col("sheet_raw"), F.col("page")).alias("label")), page_size, "sheets",
    )


def field_badges(df: DataFrame) -> DataFrame:
    return df.withColumn("color", confidence_color(F.col("confidence"))).withColumn(
        "percent", confidence_percent(F.col("confidence"))
    )


def ingest_gate(
    title_blocks: DataFrame, sheets: DataFrame, projects: DataFrame,
    need_sheets: int = 19, need_addresses: int = 17, need_mismatches: int = 1, street: str = "dennis",
) -> DataFrame:
    """Per project the three ingest checks with value, need and verdict.

    ``sheets`` and ``title_blocks`` carry project_id; title blocks have
    ``address`` and ``address_mismatch``. The mismatch check is soft. A project
    with no sheet at all is UNCHECKED.
    """
    n_sheets = sheets.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_sheets"))
    blocks = title_blocks.groupBy("project_id").agg(
        F.count_if(F.col("address").ilike(f"%{street}%")).alias("n_address"),
        F.count_if(F.col("address_mismatch")).alias("n_mismatch"),
    )
    one = projects.select("project_id").join(n_sheets, "project_id", "left").join(blocks, "project_id", "left")
    checks = [
        ("sheets", F.col("n_sheets"), need_sheets, "FAIL"),
        ("addresses", F.col("n_address"), need_addresses, "FAIL"),
        ("mismatches", F.col("n_mismatch"), need_mismatches, "UNCHECKED"),
    ]
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("check"),
                F.coalesce(value, F.lit(0)).alias("value"),
                F.lit(need).alias("need"),
                F.when(F.col("n_sheets").isNull(), "UNCHECKED").when(value >= need, "PASS").otherwise(miss).alias("verdict"),
            )
            for name, value, need, miss in checks
        ]
    )
    return one.select("project_id", F.inline(rows))


def ingest_summary(entities: DataFrame) -> DataFrame:
    """Per sheet: identifier, address, confidence and flag, with "(none)" for missing values."""
    return entities.select(
        "document_id",
        "page",
        F.coalesce(F.nullif(F.col("sheet_raw"), F.lit("")), F.lit("(none)")).alias("sheet"),
        F.coalesce(F.nullif(F.col("address"), F.lit("")), F.lit("(none)")).alias("address"),
        F.round("confidence", 2).alias("confidence"),
        F.when(F.col("address_mismatch"), "[MISMATCH]").otherwise("[OK]").alias("flag"),
    )


def ingest_report(entities: DataFrame, street: str = "dennis") -> DataFrame:
    """Totals of an ingest per document: entities, good addresses, mismatches."""
    return entities.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("entities"),
        F.count_if(~F.col("address_mismatch") & F.coalesce(F.col("address").ilike(f"%{street}%"), F.lit(False))).alias("address_ok"),
        F.count_if(F.col("address_mismatch")).alias("mismatches"),
    )
