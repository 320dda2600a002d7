"""Plan integrity: index reconciliation, callouts, sheet coherence."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redliner.functions.review import is_stale_date, lookup, parse_date
from redliner.functions.text import address_differs
from redliner.operators.keyed import outliers
from redliner.operators.overlap import overlapping
from redliner.operators.scan import every, last_value, ordered_scan, position
from redliner.plans.findings import RuleBook, emit
from redliner.session import durable, growing

BOOK = RuleBook()
DISC = "plan_integrity"
CITE = "CBC-107.2"


def _repeats(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Number the rows of a key; chunks of the order keep a key of any size out of one task.

    A key with one row is its own aggregate and has number 1; only the rows of
    keys that repeat are scanned.
    """
    known = rows.filter(F.col(keys[1]).isNotNull())
    counted = durable(known.groupBy(*keys).agg(F.count(F.lit(1)).alias("repeat"), *[F.max(c).alias(c) for c in rows.columns if c not in keys]))
    numbered = counted.filter("repeat = 1").unionByName(rows.filter(F.col(keys[1]).isNull()).withColumn("repeat", F.lit(None).cast("long")))
    several = counted.filter("repeat > 1").select(*keys)
    if several.isEmpty():
        return numbered
    again = known.join(growing(several), keys, "left_semi")
    return numbered.unionByName(ordered_scan(
        again.withColumn("__h", F.xxhash64(*order)), keys, [F.pmod("__h", F.lit(64)), *[F.col(c) for c in order]],
        F.pmod("__h", F.lit(64)), {"repeat": position()}).drop("__h"))


def reconcile_index(index: DataFrame, sheets: DataFrame) -> DataFrame:
    """Sheet index against the set: missing, orphan, mismatched_id, mismatched_title and match.

    ``index``: project_id, ord, declared_id, declared_title. ``sheets``:
    project_id, ord, sheet_id, canonical_id, sheet_title. First by id; what is
    left on both sides is compared by position. Where an id or a position
    repeats, the first entry meets the first sheet, the second the second, and
    so on, so no row is multiplied or lost.
    """
    i = index.select("project_id", F.col("declared_id").alias("id"), "declared_id", "declared_title", F.col("ord").alias("index_ord"))
    s = sheets.select("project_id", F.col("canonical_id").alias("id"), "canonical_id", "sheet_title", "sheet_id", F.col("ord").alias("sheet_ord"))
    i = _repeats(i, ["project_id", "id"], ["index_ord", "declared_title"])
    s = _repeats(s, ["project_id", "id"], ["sheet_ord", "sheet_id"])
    by_id = durable(i.join(growing(s), ["project_id", "id", "repeat"], "full_outer"))
    both = by_id.filter(F.col("declared_id").isNotNull() & F.col("canonical_id").isNotNull()).select(
        "project_id", "declared_id", "canonical_id", "declared_title", "sheet_title", "sheet_id",
        F.when(F.lower("declared_title").eqNullSafe(F.lower("sheet_title")), "match").otherwise("mismatched_title").alias("status"),
    )
    rest = by_id.filter(F.col("declared_id").isNull() | F.col("canonical_id").isNull()).drop("repeat").withColumn(
        "ord", F.coalesce("index_ord", "sheet_ord")
    ).withColumn("side", F.col("declared_id").isNull())
    # An unmatched index entry and an unmatched sheet at the same place fall together.
    rest = _repeats(rest, ["project_id", "ord", "side"], ["id", "declared_title", "sheet_id"])
    placed = rest.groupBy("project_id", "ord", "repeat").agg(
        F.max("declared_id").alias("declared_id"), F.max("canonical_id").alias("canonical_id"),
        F.max("declared_title").alias("declared_title"), F.max("sheet_title").alias("sheet_title"),
        F.max("sheet_id").alias("sheet_id"),
    ).drop("repeat")
    status = (
        F.when(F.col("declared_id").isNull(), "orphan").when(F.col("canonical_id").isNull(), "missing").otherwise("mismatched_id")
    )
    return both.unionByName(placed.drop("ord").withColumn("status", status))


def callouts_vs_schedule(callouts: DataFrame, rows: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Callouts without a row (provide), rows without a callout (clarify), differing sizes (revise).

    A row of several sizes agrees with a callout of any of them; the least is
    reported. Callouts are reduced to one row per key and size first, so a tag
    drawn many times costs one row in the join.
    """
    c = callouts.groupBy(*keys, F.col(size).alias("callout_size")).agg(F.count(F.lit(1)).alias("n_callouts"))
    r = rows.groupBy(*keys).agg(F.min(size).alias("row_size"), F.lit(True).alias("has_row"))
    sizes = rows.select(*keys, F.col(size).alias("callout_size"), F.lit(True).alias("agrees")).distinct()
    both = c.join(sizes, [*keys, "callout_size"], "left").join(r, keys, "full_outer")
    status = (
        F.when(F.col("has_row").isNull(), "provide")
        .when(F.col("n_callouts").isNull(), "clarify")
        .when(F.col("agrees").isNull() & F.col("callout_size").isNotNull() & F.col("row_size").isNotNull(), "revise")
    )
    return both.withColumn("severity", status).filter(F.col("severity").isNotNull()).select(
        *keys, "callout_size", "row_size", F.coalesce("n_callouts", F.lit(0)).cast("long").alias("n_callouts"), "severity"
    )


def missing_details(callouts: DataFrame, details: DataFrame) -> DataFrame:
    """Detail callouts ``8/A-1.5`` whose detail is absent on the target sheet."""
    parts = F.split("callout", "/", 2)
    named = callouts.withColumn("detail", F.btrim(parts[0])).withColumn("target_sheet", F.btrim(F.get(parts, F.lit(1))))
    return named.join(
        details.select("project_id", "detail", F.col("canonical_id").alias("target_sheet")).distinct(),
        ["project_id", "detail", "target_sheet"], "left_anti",
    )


def numbering_gaps(sheets: DataFrame) -> DataFrame:
    """Sheets whose number leaves a gap after the one before it in their discipline.

    ``sheets``: project_id, discipline_letter, major, minor; gaps count inside a
    major number.
    """
    unique = sheets.select("project_id", "discipline_letter", "major", "minor").distinct()
    scanned = ordered_scan(
        unique, ["project_id", "discipline_letter", "major"], [F.col("minor")], every(F.col("minor"), 1000),
        {"previous": last_value(F.col("minor"), inclusive=False)},
    )
    return scanned.filter(F.col("minor") - F.col("previous") > 1)


@BOOK.rule("PI-TITLE-001", "title_blocks")
def title_differs(ctx: Mapping[str, DataFrame]) -> DataFrame:
    odd = outliers(ctx["title_blocks"], ["project_id"], "address")
    text = F.concat(F.lit("Title block reads \""), F.col("address"), F.lit("\"; the rest of the set reads \""), F.col("majority_value"), F.lit("\". Clarify."))
    return emit(odd, "PI-TITLE-001", DISC, "clarify", text, F.col("entity_id"), F.col("confidence"), CITE)


INDEX_RULES = {
    "orphan": ("PI-INDEX-001", " is in the set but not in the sheet index. Clarify."),
    "missing": ("PI-INDEX-002", " is in the sheet index but not in the set. Clarify."),
    "mismatched_id": ("PI-INDEX-003", " of the index carries another id in its title block. Clarify."),
    "mismatched_title": ("PI-INDEX-004", " has another title in the index. Clarify."),
}


@BOOK.rule("PI-INDEX", "sheet_index", "sheets")
def index_rules(ctx: Mapping[str, DataFrame]) -> DataFrame:
    """PI-INDEX-001 to 004 from one reconciliation."""
    hit = reconcile_index(ctx["sheet_index"], ctx["sheets"]).filter(F.col("status") != "match")
    rule = lookup({k: v[0] for k, v in INDEX_RULES.items()}, F.col("status"))
    words = lookup({k: v[1] for k, v in INDEX_RULES.items()}, F.col("status"))
    shown = F.coalesce("declared_id", "canonical_id")
    return emit(hit, rule, DISC, "clarify", F.concat(F.lit("Sheet "), shown, words), shown, citation=CITE)


def with_project(blocks: DataFrame, projects: DataFrame) -> DataFrame:
    """Title blocks next to the project facts they are checked against."""
    facts = projects.select(
        "project_id", "project_address", "project_code_cycle", "project_permit_number", "received_at"
    )
    return blocks.join(facts, "project_id", "left")


def _check(rule_id: str, severity: str):
    return BOOK.check(
        rule_id, "title_blocks", DISC, severity, confidence=lambda: F.col("confidence"), citation=CITE
    )


def _shown():
    return F.concat(F.lit("Sheet "), F.coalesce("sheet_raw", "sheet_id"))


@_check("PI-STAMP-001", "provide")
def stamp():
    return ~F.col("stamp_present"), F.concat(_shown(), F.lit(" has no designer stamp. Provide.")), F.col("entity_id")


@_check("PI-SCALE-001", "provide")
def scale():
    broken = (F.col("sheet_type") == "floor_plan") & F.col("scale_declared").isNull()
    return broken, F.concat(_shown(), F.lit(" is a floor plan without a scale. Provide.")), F.col("entity_id")


@_check("PI-NORTH-001", "provide")
def north():
    broken = (F.col("sheet_type") == "site_plan") & ~F.col("has_north_arrow")
    return broken, F.concat(_shown(), F.lit(" is a site plan without a north arrow. Provide.")), F.col("entity_id")


def _unlike(own: str, official: str, words: str):
    text = F.concat(F.lit(f"Title block {words} "), F.col(own), F.lit(" differs from "), F.col(official), F.lit(". Clarify."))
    return F.col(own) != F.col(official), text, F.col("entity_id")


@_check("PI-CODECYCLE-001", "clarify")
def code_cycle():
    return _unlike("code_cycle", "project_code_cycle", "code cycle")


@_check("PI-PERMIT-001", "clarify")
def permit():
    return _unlike("permit_number", "project_permit_number", "permit number")


@_check("PI-ADDR-001", "clarify")
def address():
    _, text, evidence = _unlike("address", "project_address", "address")
    return address_differs(F.col("address"), F.col("project_address")), text, evidence


@_check("PI-DATE-001", "clarify")
def stale_date():
    text = F.concat(F.lit("Title block date "), F.col("date_issued"), F.lit(" is more than 90 days before the submittal. Clarify."))
    return is_stale_date(parse_date(F.col("date_issued")), F.col("received_at").cast("date")), text, F.col("entity_id")


@BOOK.rule("PI-SHEET-NUMBERING", "numbered_sheets")
def numbering(ctx: Mapping[str, DataFrame]) -> DataFrame:
    gaps = numbering_gaps(ctx["numbered_sheets"]).withColumn(
        "sheet_id", F.format_string("%s-%d.%d", "discipline_letter", "major", "minor")
    )
    text = F.concat(F.lit("Sheet "), F.col("sheet_id"), F.lit(" follows a gap in the numbering. Clarify."))
    return emit(gaps, "PI-SHEET-NUMBERING", DISC, "clarify", text, F.col("sheet_id"), citation=CITE)


@BOOK.rule("PI-TEXT-OVERLAP-001", "text_boxes")
def text_overlap(ctx: Mapping[str, DataFrame]) -> DataFrame:
    hit = overlapping(ctx["text_boxes"], ["project_id", "sheet_id"], "span_id")
    return emit(hit, "PI-TEXT-OVERLAP-001", DISC, "clarify", F.lit("Text overlaps other text on the sheet. Clarify."), F.col("span_id"), citation=CITE)


@BOOK.rule("PI-REV-CLOUD-001", "revision_clouds", "revision_tables")
def cloud_without_table(ctx: Mapping[str, DataFrame]) -> DataFrame:
    clouded = ctx["revision_clouds"].select("project_id", "sheet_id").distinct()
    hit = clouded.join(ctx["revision_tables"].select("project_id", "sheet_id").distinct(), ["project_id", "sheet_id"], "left_anti")
    return emit(hit, "PI-REV-CLOUD-001", DISC, "provide", F.lit("Revision clouds without a revision table. Provide."), F.col("sheet_id"), citation=CITE)


@BOOK.rule("PI-CROSSDOC-001", "claims")
def claim_conflicts(ctx: Mapping[str, DataFrame]) -> DataFrame:
    """``claims``: resolved claims with n_values. Compliance values are revised, other facts clarified."""
    hit = ctx["claims"].filter(F.col("n_values") > 1)
    compliance = F.col("claim_type").startswith("r_value") | F.col("claim_type").startswith("u_factor")
    severity = F.when(compliance, "revise").otherwise("clarify")
    text = F.concat(F.lit("Documents disagree on "), F.col("claim_type"), F.lit(": "), F.col("n_values").cast("string"), F.lit(" values."))
    return emit(
        hit.withColumn("sheet_id", F.lit(None).cast("string")), "PI-CROSSDOC-001", DISC, severity, text, F.col("claim_type"),
        F.col("confidence"), CITE,
    )
