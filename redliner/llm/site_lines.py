"""Line dedup by site-relative frequency, in DataFrame expressions only.

A line is boilerplate on a host when the pages of that host that contain it,
divided by all pages of the host, exceed a ratio. Such lines are dropped from
every page of the host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redliner.session import durable

RATIO = 0.08
#: a line of a single page repeats nothing there, whatever its share of a small host
MIN_PAGES = 2


def _fingerprint(line: Column) -> Column:
    return F.unhex(F.md5(F.trim(line)))


def line_fingerprints(text: Column) -> Column:
    """128-bit fingerprints of the distinct trimmed lines of a page; blank lines have none."""
    lines = F.filter(F.split(text, "\n"), lambda line: F.trim(line) != "")
    return F.array_distinct(F.transform(lines, _fingerprint))


def boilerplate_lines(pages: DataFrame, text: str = "text", host: str = "source",
                      ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, hot): fingerprints of the lines found on more than ``ratio`` of a host's pages.

    A page counts once for each of its distinct lines, so the pages of a line
    are a plain count with a partial sum per task: a hot host or a line on
    every page is never gathered. Lines on fewer than ``min_pages`` pages are
    never boilerplate. One host has at most (mean lines a page) / ratio hot
    lines, which bounds the array.
    """
    rows = pages.select(F.col(host).alias("host"), F.col(text).alias("text"))
    totals = rows.groupBy("host").agg(F.count("*").alias("pages"))
    seen = (
        rows.select("host", F.explode(line_fingerprints(F.col("text"))).alias("line"))
        .groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    )
    return (
        seen.withColumnRenamed("host", "seen_host").join(totals, F.col("seen_host").eqNullSafe(F.col("host")))
        .filter(F.col("n") > ratio * F.col("pages"))
        .groupBy("host").agg(F.collect_list("line").alias("hot"))
    )


def drop_boilerplate(pages: DataFrame, text: str = "text", host: str = "source", ratio: float = RATIO,
                     min_pages: int = MIN_PAGES, dropped: str = "lines_dropped") -> DataFrame:
    """The same pages with the boilerplate lines of their host removed and ``dropped``, their number.

    The kept lines and their order stay as they are, blank ones included; a
    page without boilerplate keeps its text to the byte. A null text stays null
    (0 dropped) and counts as a page; an empty text stays empty; rows with a
    null host form a host of their own; repeated rows are pages of their own;
    an empty table gives an empty table. Other columns pass through, whatever
    their names; one that is called like ``dropped`` is replaced.
    """
    hot = durable(boilerplate_lines(pages, text, host, ratio, min_pages)).select(
        F.col("host").alias("__hot_host"), F.col("hot").alias("__hot"))
    lines = F.split(F.col("__body"), "\n")
    hit = lambda line: (F.trim(line) != "") & F.array_contains(F.col("__hot"), _fingerprint(line))
    joined = pages.withColumn("__body", F.col(text)).join(hot, F.col(host).eqNullSafe(F.col("__hot_host")), "left")
    kept = F.when(F.col("__hot").isNotNull() & F.col("__body").isNotNull(), F.filter(lines, lambda line: ~hit(line)))
    split = joined.withColumn("__kept", kept)
    count = F.when(F.col("__kept").isNotNull(), F.size(lines) - F.size("__kept")).otherwise(0)
    return split.select(
        *[(F.when(F.col("__kept").isNotNull(), F.array_join("__kept", "\n")).otherwise(F.col(text)) if c == text
           else F.col(f"`{c}`")).alias(c) for c in pages.columns if c != dropped],
        count.cast("long").alias(dropped),
    )


def oracle(ratio: float = RATIO, min_pages: int = MIN_PAGES) -> str:
    """The same over ``documents`` in DuckDB SQL."""
    return f"""
    WITH lines AS (SELECT source, unnest(list_distinct(list_transform(
             list_filter(string_split(text, chr(10)), lambda l: trim(l) <> ''), lambda l: trim(l)))) AS line FROM documents),
    totals AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
    hot AS (SELECT s.source, list(s.line) AS hot FROM (SELECT source, line, count(*) AS n FROM lines GROUP BY ALL) s
            JOIN totals t ON s.source IS NOT DISTINCT FROM t.source
            WHERE s.n >= {min_pages} AND s.n > CAST({ratio} AS DOUBLE) * t.pages GROUP BY s.source),
    cut AS (SELECT d.doc_id, d.text, string_split(d.text, chr(10)) AS lines,
            list_filter(string_split(d.text, chr(10)), lambda l: trim(l) = '' OR NOT list_contains(coalesce(h.hot, []), trim(l))) AS kept
            FROM documents d LEFT JOIN hot h ON d.source IS NOT DISTINCT FROM h.source)
    SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE array_to_string(kept, chr(10)) END AS text,
           CAST(coalesce(len(lines) - len(kept), 0) AS BIGINT) AS lines_dropped FROM cut"""
