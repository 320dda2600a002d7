"""Text to rows: letters, narratives, forms, schedules, notes and checklists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redliner.functions.codes import canonical_citation, citations_in, with_canonical_citation
from redliner.operators.scan import every, last_value, ordered_scan, paged, running_sum

# The seven document types and words that point to them.
DOCUMENT_WORDS = {
    "plan_set": "floor plan|elevation|sheet index|title block",
    "title24_report": "title 24|cf1r|mf1r|certificate of compliance",
    "plan_check_letter": "plan check|plan review comments|response slot",
    "narrative": "narrative|code analysis|basis of design",
    "question_checklist": "checklist|does every|question",
    "deferred_submittal": "deferred submittal|sprinkler|solar",
}
SECTION_NAMES = {
    "architectural": "architectural",
    "accessibility": "accessibility",
    "energy": "energy",
    "electrical": "electrical",
    "mechanical": "mechanical",
    "plumbing": "plumbing",
    "structural": "structural",
    "fire": "fire_life_safety",
    "calgreen": "calgreen",
}
SCHEDULE_KINDS = ["door", "window", "fastener", "holdown", "wall"]


def classify_document(text: Column) -> Column:
    """Document type with most keyword hits; ties go to the earlier type, no hit is a supporting document."""
    hits = F.array(
        *[
            F.struct(
                F.regexp_count(F.lower(text), F.lit(words)).alias("n"),
                F.lit(-i).alias("rank"),
                F.lit(name).alias("name"),
            )
            for i, (name, words) in enumerate(DOCUMENT_WORDS.items())
        ]
    )
    best = F.array_max(hits)
    return F.when(best["n"] > 0, best["name"]).otherwise("supporting_doc")


def lines_of(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """Lines of each text, numbered from 1."""
    return df.select(row_id, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line")).select(
        row_id, (F.col("pos") + 1).alias("line_no"), "line"
    )


def split_paragraphs(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """Paragraphs separated by blank lines, numbered from 1; empty ones dropped."""
    parts = F.filter(F.split(F.col(text), r"\n[ \t]*\n"), lambda p: F.btrim(p, F.lit(" \t\n")) != "")
    return df.select(row_id, F.posexplode(parts).alias("pos", "body")).select(
        row_id, (F.col("pos") + 1).alias("paragraph_no"), F.btrim("body", F.lit(" \t\n")).alias("body")
    )


def with_heading(lines: DataFrame, row_id: str, number: str, body: str, heading: str, width: int = 1000) -> DataFrame:
    """Carry the latest heading line forward over the lines below it."""
    is_heading = F.col(body).rlike(heading)
    return ordered_scan(
        lines.withColumn("is_heading", is_heading), [row_id], [F.col(number)], every(F.col(number), width),
        {"heading": last_value(F.when(F.col("is_heading"), F.col(body)))},
    )


def letter_lines(lines: DataFrame, letter_id: str, width: int = 1000) -> DataFrame:
    """Letter lines with the section they stand in and the comment they belong to (0 before the first)."""
    names = "|".join(SECTION_NAMES)
    name = F.regexp_extract(F.lower(F.btrim("line")), rf"^({names})[a-z /]*:?$", 1)
    pairs = [F.lit(x) for item in SECTION_NAMES.items() for x in item]
    section = F.try_element_at(F.create_map(*pairs), name)
    number = F.regexp_extract("line", r"^\s*(\d+)\.\s+\S", 1)
    marked = lines.withColumn("__section", section).withColumn(
        "__number", F.when(number != "", number.cast("int"))
    )
    return ordered_scan(
        marked, [letter_id], [F.col("line_no")], every(F.col("line_no"), width),
        {
            "discipline": last_value(F.col("__section")),
            "comment_number": last_value(F.col("__number")),
            "comment_seq": running_sum(F.when(F.col("__number").isNotNull(), 1).otherwise(0)),
        },
    ).filter(F.col("__section").isNull() & (F.col("comment_seq") > 0)).drop("__section", "__number")


def parse_review_letter(lines: DataFrame, letter_id: str) -> DataFrame:
    """Numbered comments of review letters: discipline, first citation, style and size.

    ``lines`` has the letter id, line_no, line and style. The style of a comment
    is that of its first line.
    """
    marked = letter_lines(lines, letter_id)
    first = F.get(citations_in(F.col("line")), F.lit(0))
    return marked.groupBy(letter_id, "comment_seq", "comment_number").agg(
        F.min_by("discipline", "line_no").alias("discipline"),
        F.min_by(canonical_citation(first), F.when(first.isNotNull(), F.col("line_no"))).alias("citation"),
        F.min_by("style", "line_no").alias("typography"),
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(F.length("line")).alias("n_chars"),
    )


def letter_comment_texts(lines: DataFrame, letter_id: str, lines_per_part: int = 500) -> DataFrame:
    """Full comment texts; a comment longer than one part continues in the next."""
    marked = letter_lines(lines, letter_id)
    pages = paged(
        marked, [letter_id, "comment_seq"], [F.col("line_no")], every(F.col("line_no"), 1000), F.col("line"),
        lines_per_part, "lines",
    )
    return pages.select(letter_id, "comment_seq", "part", F.array_join("lines", "\n").alias("comment_text"))


def parse_form_rows(lines: DataFrame) -> DataFrame:
    """Compliance form lines to typed rows.

    ``name: value`` lines are header rows; ``kind | a | b | c`` lines are table
    rows: envelope (area, U-factor, R-value), hvac and dhw.
    """
    parts = F.split("line", r"\s*\|\s*")
    kind = F.lower(F.btrim(parts[0]))
    is_table = F.size(parts) == 4
    head = F.regexp_extract("line", r"^([A-Za-z][A-Za-z ]+):\s*(.+)$", 1)

    def cell(i: int) -> Column:
        return F.when(is_table, F.get(parts, F.lit(i)).try_cast("double"))

    return lines.select(
        *[c for c in lines.columns if c != "line"],
        F.when(is_table & kind.isin("wall", "roof", "floor", "window"), "t24_envelope_row")
        .when(is_table & (kind == "hvac"), "t24_hvac_row")
        .when(is_table & (kind == "dhw"), "t24_dhw_row")
        .when(head != "", "t24_header")
        .alias("type"),
        F.when(is_table, kind).otherwise(F.lower(head)).alias("name"),
        F.when(head != "", F.regexp_extract("line", r"^[A-Za-z][A-Za-z ]+:\s*(.+)$", 1)).alias("value"),
        cell(1).alias("area"),
        cell(2).alias("u_factor"),
        cell(3).alias("r_value"),
    ).filter(F.col("type").isNotNull())


def parse_schedule(cells: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(row, column, text) cells to one row per schedule line."""
    return cells.groupBy(*keys).agg(
        *[F.min(F.when(F.col("column") == c, F.col("text"))).alias(c) for c in columns]
    )


def code_notes(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """One row per citation in a text, with its canonical id and order."""
    found = df.select(row_id, F.posexplode(citations_in(F.col(text))).alias("pos", "citation"))
    return with_canonical_citation(found.select(row_id, (F.col("pos") + 1).alias("citation_no"), "citation"), "citation", "canonical_id")


def claim_fields(text: Column) -> dict[str, Column]:
    """Facts a narrative states: occupancy, construction type, sprinklers and code cycle."""
    def first(pattern: str) -> Column:
        hit = F.regexp_extract(text, pattern, 1)
        return F.when(hit != "", hit)

    return {
        "occupancy_class": F.upper(first(r"(?i)\boccupancy\s+(?:group\s+)?([a-z]-?\d(?:\.\d)?)")),
        "construction_type": F.upper(first(r"(?i)\btype\s+(i{1,3}[ab]?|iv|v[ab]?)\b")),
        "sprinklered": F.when(text.rlike(r"(?i)\b(?:non-?sprinklered|not sprinklered)"), "no").when(
            text.rlike(r"(?i)\bsprinkler"), "yes"
        ),
        "code_cycle": first(r"(?i)\b(20\d\d)\s+(?:california|cbc|crc)"),
    }


def parse_question(text: Column) -> dict[str, Column]:
    """Checklist question to a structured query."""
    low = F.lower(text)

    def first(pattern: str, group: int = 1) -> Column:
        hit = F.regexp_extract(low, pattern, group)
        return F.when(hit != "", hit)

    number = first(r"(\d+(?:\.\d+)?)\s*(?:sqft|sq ft|square feet|\"|in\b|inches|ft\b|feet)")
    return {
        "target": first(r"\b(bedroom|bathroom|kitchen|door|window|stair|ramp|corridor|exit)s?\b"),
        "only_new": F.coalesce(low.rlike(r"\bnew\b"), F.lit(False)),
        "measure": first(r"\b(net clear opening|clear width|sill height|turning space|width|height|area|distance|slope)\b"),
        "comparison": F.when(low.rlike(r"at least|minimum|not less than"), ">=").when(
            low.rlike(r"at most|maximum|not exceed|no more than"), "<="
        ),
        "threshold": number.try_cast("double"),
        "unit": first(r"\d\s*(sqft|sq ft|square feet|\"|in\b|inches|ft\b|feet)"),
        "section": canonical_citation(F.get(citations_in(text), F.lit(0))),
    }


def chunk_code_text(df: DataFrame, row_id: str, text: str, heading: str = r"\d+(?:\.\d+)+") -> DataFrame:
    """Subsection chunks of a code text: a chunk starts at each line that opens with a section number."""
    pieces = F.filter(F.split(F.col(text), rf"(?m)(?=^{heading}\s)"), lambda p: F.btrim(p, F.lit(" \t\n")) != "")
    return df.select(row_id, F.posexplode(pieces).alias("pos", "body")).select(
        row_id,
        (F.col("pos") + 1).alias("chunk_no"),
        F.nullif(F.regexp_extract("body", rf"^({heading})\s", 1), F.lit("")).alias("section_number"),
        F.btrim("body", F.lit(" \t\n")).alias("body_text"),
    )
