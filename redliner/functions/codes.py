"""Code citations: canonical ids and display form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redliner.functions.text import let

# Code books that may prefix a citation, and each discipline's own book.
CODE_BOOKS = ["CBC", "CRC", "CMC", "CPC", "CEC", "CEnC", "CFC", "CalGreen", "HSC", "NFPA"]
DISCIPLINE_BOOK = {
    "plan_integrity": "CBC",
    "architectural": "CBC",
    "accessibility": "CBC",
    "structural": "CBC",
    "mechanical": "CMC",
    "electrical": "CEC",
    "plumbing": "CPC",
    "energy": "CEnC",
    "fire_life_safety": "CFC",
    "calgreen": "CalGreen",
}

CITATION = (
    r"((?:(?:CBC|CRC|CMC|CPC|CEC|CEnC|CFC|CalGreen|HSC)\s*)?"
    r"(?:§\s*(?:11B-)?[A-Z]?\d+(?:\.\d+)*(?:\([a-z0-9]+\))*|Table\s+\d+(?:\.\d+)*))"
)


def _dashed(c: Column) -> Column:
    return F.regexp_replace(c, r"\(([A-Za-z0-9]+)\)", "-$1")


def _lower_tail(d: Column) -> Column:
    head = F.length(F.regexp_extract(d, r"^([^-]*(?:11B-[^-]*)?)", 1))
    return F.concat(F.substring(d, F.lit(1), head), F.lower(F.substring(d, head + 1, F.length(d))))


def _suffixes(c: Column) -> Column:
    """``150.0(f)(2)`` -> ``150.0-f-2``."""
    return F.when(c.contains("("), let(_dashed(c), _lower_tail)).otherwise(c)


def _bare(c: Column) -> Column:
    return F.btrim(F.replace(c, F.lit("§"), F.lit("")))


def _own_book(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, rf"^({'|'.join(CODE_BOOKS)})\b", 1), F.lit(""))


def _without_book(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, rf"^(?:{'|'.join(CODE_BOOKS)})\b[\s-]*", ""))


def _table(body: Column) -> Column:
    return F.regexp_extract(body, r"^[Tt]able\s+(\d+[0-9.]*(?:\([0-9a-z]+\))*)$", 1)


def _number(body: Column) -> Column:
    return F.regexp_extract(body, r"^((?:11B-)?[A-Z]?\d+(?:\.\d+)*[A-Z]?(?:\([A-Za-z0-9]+\))*)$", 1)


def _resolved(own: Column, table: Column, number: Column, default: Column, table_text: Column, number_text: Column) -> Column:
    book = (
        F.when(own.isNotNull(), own)
        .when(number.startswith("11B-"), "CBC")
        .when(number.rlike(r"^R\d"), "CRC")
        .when(number.rlike(r"^1\d\d\.\d+\([a-z]\)"), "CEnC")
        .when(number.rlike(r"^\d"), default)
    )
    return F.when(table != "", F.concat(F.coalesce(own, F.lit("CBC")), F.lit("-TBL-"), table_text)).when(
        number != "", F.concat(book, F.lit("-"), number_text)
    )


def canonical_citation(c: Column, discipline: Column | None = None) -> Column:
    """Canonical section id of a citation string, null when it cannot be resolved.

    A book prefix wins; then tables, accessibility (11B-), residential (R310)
    and energy sections with letter suffixes; a bare number belongs to the
    discipline's book, CBC when none is given.
    """
    default = F.lit("CBC")
    if discipline is not None:
        pairs = [F.lit(x) for item in DISCIPLINE_BOOK.items() for x in item]
        default = F.coalesce(F.try_element_at(F.create_map(*pairs), discipline), default)

    def split_prefix(text: Column) -> Column:
        return F.struct(_own_book(text).alias("own"), _without_book(text).alias("body"))

    def split_body(p: Column) -> Column:
        return F.struct(p["own"].alias("own"), _table(p["body"]).alias("table"), _number(p["body"]).alias("number"))

    text = _bare(c)
    return F.when(c.isNotNull(), let(let(let(text, split_prefix), split_body), lambda p: _resolved(p["own"], p["table"], p["number"], default, _suffixes(p["table"]), _suffixes(p["number"]))))


def with_canonical_citation(df: DataFrame, citation: str, name: str) -> DataFrame:
    """``canonical_citation`` of a column as a further one, without a discipline.

    Its steps are columns of successive selects, which compile, where those
    bound inside one expression are interpreted row by row.
    """
    text = df.withColumn("__bare", _bare(F.col(citation)))
    parts = text.withColumns({"__own": _own_book(F.col("__bare")), "__body": _without_book(F.col("__bare"))})
    read = parts.withColumns({"__table": _table(F.col("__body")), "__number": _number(F.col("__body"))})
    said = F.when(F.col("__table") != "", F.col("__table")).otherwise(F.col("__number"))
    read = read.withColumn("__said", said).withColumn("__dashed", _dashed(F.col("__said")))
    text = F.when(F.col("__said").contains("("), _lower_tail(F.col("__dashed"))).otherwise(F.col("__said"))
    found = _resolved(F.col("__own"), F.col("__table"), F.col("__number"), F.lit("CBC"), text, text)
    return read.select(*df.columns, F.when(F.col(citation).isNotNull(), found).alias(name))


def display_citation(canonical: Column) -> Column:
    """``CRC-R310.2.1`` -> ``CRC §R310.2.1``; ``CBC-TBL-508.4`` -> ``CBC Table 508.4``."""
    book = F.substring_index(canonical, "-", 1)
    rest = F.regexp_replace(canonical, "^[^-]+-", "")
    return F.when(
        rest.startswith("TBL-"), F.concat(book, F.lit(" Table "), F.regexp_replace(rest, "^TBL-", ""))
    ).otherwise(F.concat(book, F.lit(" §"), rest))


def citations_in(c: Column) -> Column:
    """Every citation string of a text in order."""
    # each begins with a book, a paragraph sign or the word Table; no other place is worth a try
    return F.regexp_extract_all(c, F.lit("(?=[CHT§])" + CITATION), F.lit(1))
