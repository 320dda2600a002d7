"""Token sets, similarity, street addresses and identifiers as Catalyst expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java's \s and \w are ASCII unless (?U) is set; (?d) makes "\n" the only line end.
UNICODE = "(?U)"
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0  　"

# Street types that count as the same word, and the words that end a street name.
STREET_GROUPS = [
    ("ln", "lane"),
    ("st", "street"),
    ("ave", "av", "avenue"),
    ("blvd", "boulevard"),
    ("rd", "road"),
    ("dr", "drive"),
    ("ct", "court"),
    ("pl", "place"),
    ("hwy", "highway"),
]
STREET_END = (
    r"\b(?:ln|lane|st(?:reet)?|ave(?:nue)?|blvd|boulevard|"
    r"rd|road|dr(?:ive)?|way|ct|court|pl(?:ace)?|hwy|highway)\b"
)
ADDRESS_JACCARD_FLOOR = 0.35


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a costly value once for several uses inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Remove leading and trailing white space of any kind, not only blanks."""
    return F.btrim(c, F.lit(BLANKS))


def truthy(c: Column) -> Column:
    """Neither null nor the empty string."""
    return c.isNotNull() & (c != "")


def none_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


def token_set(c: Column) -> Column:
    """Distinct lower-case tokens split at white space; punctuation stays."""
    parts = F.split(F.lower(c), UNICODE + r"\s+")
    return F.array_distinct(F.filter(parts, lambda t: t != ""))


def set_jaccard(a: Column, b: Column) -> Column:
    """|a and b| / |a or b|; two empty sets are equal, one empty set shares nothing."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    union = F.size(a) + F.size(b) - both
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
        .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
        .otherwise(both / union)
    )


def token_jaccard(a: Column, b: Column) -> Column:
    return let(F.struct(token_set(a).alias("a"), token_set(b).alias("b")), lambda p: set_jaccard(p["a"], p["b"]))


def token_signature(c: Column) -> Column:
    """One string per token set: equal signatures mean a token Jaccard of 1."""
    return F.array_join(F.array_sort(token_set(c)), " ")


def min_token_hash(c: Column, salt: str) -> Column:
    """Minimum of the salted token hashes; two texts agree with probability equal to their Jaccard."""
    return F.array_min(F.transform(token_set(c), lambda t: F.md5(F.concat(F.lit(salt), t))))


# --- addresses -----------------------------------------------------------------

def _street_canon() -> Column:
    entries = []
    for group in STREET_GROUPS:
        shortest = min(group, key=len)
        for word in group:
            entries += [F.lit(word), F.lit(shortest)]
    return F.create_map(*entries)


def _canon_words(words: Column) -> Column:
    table = _street_canon()
    return F.array_distinct(F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), w)))


def address_words(c: Column) -> Column:
    """Distinct lower-case alphanumeric words with street types brought to one spelling."""
    return _canon_words(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1)))


def _number_text(c: Column) -> Column:
    return F.regexp_extract(F.lower(c), r"(?Ud)^\s*(\d{3,5})\s+.+", 1)


def house_number(c: Column) -> Column:
    """Leading number of three to five digits followed by white space, else null."""
    return none_if_empty(_number_text(c))


def _words_after_number(c: Column) -> Column:
    rest = F.regexp_extract(F.lower(c), r"(?Ud)^\s*\d{3,5}\s+(.+)", 1)
    before = F.split(rest, UNICODE + STREET_END, 2)[0]
    return F.regexp_extract_all(before, F.lit("([a-z]+)"), F.lit(1))


def street_words(c: Column) -> Column:
    """Letter-only words between the house number and the first street type; null when none."""
    words = _words_after_number(c)
    return F.when(house_number(c).isNotNull() & (F.size(words) > 0), words)


def street_name(c: Column) -> Column:
    return F.array_join(street_words(c), " ")


def address_differs(found: Column, official: Column) -> Column:
    """Does ``found`` name another property than ``official``?

    The official house number must occur in ``found`` and one street word is
    enough. An official address without a usable number falls back to the word
    overlap. Missing text on either side never counts as a difference.
    """
    numbers = F.regexp_extract_all(found, F.lit(UNICODE + r"\b(\d{3,5})\b"), F.lit(1))

    def other_street(street: Column) -> Column:
        return (F.size(street) > 0) & ~F.arrays_overlap(_canon_words(street), address_words(found))

    def other_words(p: Column) -> Column:
        return (F.size(p["a"]) > 0) & (F.size(p["b"]) > 0) & (set_jaccard(p["a"], p["b"]) < ADDRESS_JACCARD_FLOOR)

    # each part is computed once, and only where those before leave the answer open
    by_words = let(F.struct(address_words(found).alias("a"), address_words(official).alias("b")), other_words)
    differs = let(_number_text(official), lambda number: F.when(
        number != "", ~F.array_contains(numbers, number) | let(_words_after_number(official), other_street)).otherwise(by_words))
    return F.coalesce(F.when(truthy(found) & truthy(official), differs), F.lit(False))


# --- identifiers ----------------------------------------------------------------

def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def prompt_hash(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the prompt parts in order."""
    return F.substring(F.sha2(F.concat(*parts), 256), 1, 16)


def stable_id(kind: str, *parts: Column) -> Column:
    """Deterministic row id: the same natural key gives the same id on every run."""
    return F.sha2(F.concat_ws("\u001f", F.lit(kind), *[p.cast("string") for p in parts]), 256)


def public_id(c: Column) -> Column:
    """Short public id of an internal id."""
    return F.substring(F.sha2(c.cast("string"), 256), 1, 12)


def sheet_key(document: Column, page: Column) -> Column:
    return F.format_string("%s:p%03d", document.cast("string"), page.cast("int"))


def page_label(value: Column, page: Column) -> Column:
    """Shown sheet label: the extracted identifier, else p001, p002, ..."""
    return F.coalesce(value, F.format_string("p%03d", page.cast("int")))


def page_heading(canonical: Column, page: Column) -> Column:
    return F.coalesce(canonical, F.format_string("Page %d", page.cast("int")))


def object_uri(bucket: Column, key: Column) -> Column:
    return F.concat(F.lit("s3://"), bucket, F.lit("/"), key)


def public_url(endpoint: Column, bucket: Column, key: Column) -> Column:
    return F.concat(F.rtrim(endpoint, F.lit("/")), F.lit("/"), bucket, F.lit("/"), key)


def object_key(uri: Column) -> Column:
    """Key part of an s3:// URI."""
    return F.regexp_replace(uri, "^s3://[^/]+/", "")


def proxy_path(uri: Column) -> Column:
    return F.concat(F.lit("/api/assets/"), object_key(uri))
