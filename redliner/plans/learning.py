"""Comparison with authority comments, metrics, triage and regression checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redliner.functions.text import min_token_hash, token_jaccard, token_signature
from redliner.operators.keyed import changed
from redliner.operators.matching import Tier, tiered_assignment
from redliner.operators.scan import last_value, ordered_scan, running_sum
from redliner.session import durable, growing

MATCHED_AT = 0.6
PARTIAL_AT = 0.3
WEIGHTS = {"sheet": 0.4, "citation": 0.3, "text": 0.3}

TIERS = [
    Tier("sheet+citation+text", ("project_id", "sheet_id", "citation", "signature")),
    Tier("sheet+citation+similar", ("project_id", "sheet_id", "citation", "sketch")),
    Tier("sheet+citation", ("project_id", "sheet_id", "citation")),
    Tier("sheet+text", ("project_id", "sheet_id", "signature")),
    Tier("citation+text", ("project_id", "citation", "signature")),
    Tier("sheet+similar", ("project_id", "sheet_id", "sketch")),
    Tier("sheet", ("project_id", "sheet_id")),
    Tier("citation", ("project_id", "citation")),
    Tier("text", ("project_id", "signature")),
]


def with_text_keys(df: DataFrame, text: str) -> DataFrame:
    """Keys of equal and of similar token sets; null for empty text."""
    signature = F.nullif(token_signature(F.col(text)), F.lit(""))
    return df.withColumn("signature", F.unhex(F.md5(signature))).withColumn("sketch", F.unhex(min_token_hash(F.col(text), "a")))


def alignment_score(same_sheet: Column, same_citation: Column, jaccard: Column) -> Column:
    def one(c: Column) -> Column:
        return F.coalesce(c, F.lit(False)).cast("double")

    return WEIGHTS["sheet"] * one(same_sheet) + WEIGHTS["citation"] * one(same_citation) + WEIGHTS["text"] * jaccard


def align(findings: DataFrame, comments: DataFrame, tiers: Sequence[Tier] = tuple(TIERS)) -> DataFrame:
    """One-to-one alignment: matched, partial, missed or false_positive.

    Both sides: an integer id (finding_id, comment_id), project_id, sheet_id,
    citation and text. Pairs form tier by tier from the strongest shared keys to
    the weakest and are then scored; a pair below the partial score falls apart
    into a miss and a false positive.
    """
    # read by the tiers and for the scores, whatever it takes to derive them
    f, c = durable(with_text_keys(findings, "text")), durable(with_text_keys(comments, "text"))
    pairs = tiered_assignment(f, c, tiers, "finding_id", "comment_id")
    fs = f.select("finding_id", *[F.col(x).alias(f"f_{x}") for x in ("project_id", "sheet_id", "citation", "text")])
    cs = c.select("comment_id", *[F.col(x).alias(f"c_{x}") for x in ("project_id", "sheet_id", "citation", "text")])
    both = fs.join(growing(pairs.select("finding_id", "comment_id", "tier")), "finding_id", "left").join(growing(cs), "comment_id", "full_outer")
    score = F.when(
        F.col("finding_id").isNotNull() & F.col("comment_id").isNotNull(),
        alignment_score(F.col("f_sheet_id") == F.col("c_sheet_id"), F.col("f_citation") == F.col("c_citation"),
                        token_jaccard(F.col("f_text"), F.col("c_text"))),
    )
    rows = both.withColumn("score", F.round(score, 6))
    kept = F.col("score") >= PARTIAL_AT
    bucket = (
        F.when(F.col("score") >= MATCHED_AT, "matched").when(kept, "partial")
        .when(F.col("comment_id").isNotNull() & F.col("finding_id").isNull(), "missed")
        .when(F.col("finding_id").isNotNull() & F.col("comment_id").isNull(), "false_positive")
    )
    whole = rows.withColumn("bucket", bucket).withColumn("project_id", F.coalesce("f_project_id", "c_project_id"))
    columns = ["project_id", "finding_id", "comment_id", "tier", "score", "bucket"]
    weak = whole.filter(F.col("bucket").isNull())
    none = F.lit(None)
    missed = weak.select("project_id", none.cast("long").alias("finding_id"), "comment_id", none.cast("string").alias("tier"),
                         none.cast("double").alias("score"), F.lit("missed").alias("bucket"))
    false_positive = weak.select("project_id", "finding_id", none.cast("long").alias("comment_id"), none.cast("string").alias("tier"),
                                 none.cast("double").alias("score"), F.lit("false_positive").alias("bucket"))
    return whole.filter(F.col("bucket").isNotNull()).select(*columns).unionByName(missed).unionByName(false_positive)


# --- metrics ----------------------------------------------------------------------

def _f1(p: Column, r: Column) -> Column:
    return F.try_divide(2 * p * r, p + r)


def rule_counts(outcomes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Emitted, approved, matched, missed and false positives per key.

    ``outcomes``: the keys, emitted, approved, matched, missed, false_positive as
    booleans, one row per finding or missed comment.
    """
    names = ["emitted", "approved", "matched", "missed", "false_positive"]
    return outcomes.groupBy(*keys).agg(*[F.count_if(n).alias(n) for n in names])


def with_rates(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and precision against the authority; null where undefined."""
    p = F.try_divide(F.col("approved"), F.col("emitted"))
    r = F.try_divide(F.col("matched"), F.col("matched") + F.col("missed"))
    pa = F.try_divide(F.col("matched"), F.col("matched") + F.col("false_positive"))
    return counts.withColumns(
        {"precision": F.round(p, 6), "recall": F.round(r, 6), "f1": F.round(_f1(p, r), 6), "precision_vs_authority": F.round(pa, 6),
         "sample_size": F.col("emitted") + F.col("missed")}
    )


def metrics_rollup(outcomes: DataFrame, rule: str = "rule_id", discipline: str = "discipline", jurisdiction: str = "jurisdiction") -> DataFrame:
    """Metrics per rule, discipline, jurisdiction and overall in one pass.

    The finest counts are built first and the grouping sets run over them.
    """
    names = ["emitted", "approved", "matched", "missed", "false_positive"]
    fine = rule_counts(outcomes, [rule, discipline, jurisdiction])
    sets = fine.groupingSets(
        [[F.col(discipline), F.col(rule)], [F.col(discipline)], [F.col(jurisdiction)], []],
        F.col(rule), F.col(discipline), F.col(jurisdiction),
    ).agg(F.grouping_id(F.col(rule), F.col(discipline), F.col(jurisdiction)).alias("level"), *[F.sum(n).alias(n) for n in names])
    return with_rates(sets)


def severity_profile(findings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Severity counts, licensed count and its share."""
    sev = [F.count_if(F.col("severity") == s).alias(s) for s in ("revise", "provide", "clarify", "reference_only")]
    return findings.groupBy(*keys).agg(
        *sev, F.count_if("requires_licensed_review").alias("licensed"), F.count(F.lit(1)).alias("n")
    ).withColumn("licensed_share", F.round(F.col("licensed") / F.col("n"), 6))


def edit_distances(pairs: DataFrame, keys: Sequence[str], draft: str, final: str) -> DataFrame:
    """Mean edit distance between draft and final text."""
    d = pairs.withColumn("d", F.levenshtein(draft, final).cast("long"))
    return d.groupBy(*keys).agg(F.sum("d").alias("total_distance"), F.count(F.lit(1)).alias("n")).withColumn(
        "mean_distance", F.round(F.col("total_distance") / F.col("n"), 6)
    )


def time_to_approve(created: DataFrame, approvals: DataFrame, keys: Sequence[str], row_id: str) -> DataFrame:
    """Mean seconds from creation to first approval, and the longest."""
    first = approvals.groupBy(row_id).agg(F.min("created_at").alias("approved_at"))
    both = created.join(first, row_id).withColumn("seconds", F.unix_timestamp("approved_at") - F.unix_timestamp("created_at"))
    return both.groupBy(*keys).agg(F.round(F.avg("seconds"), 3).alias("mean_seconds"), F.max("seconds").alias("max_seconds"), F.count(F.lit(1)).alias("n"))


def trend(metric: DataFrame, keys: Sequence[str], period: str, value: str, chunk: Column) -> DataFrame:
    """Metric per period with the change to the period before and the mean of all periods so far."""
    scanned = ordered_scan(
        metric, keys, [F.col(period)], chunk,
        {"previous": last_value(F.col(value), inclusive=False), "__sum": running_sum(F.col(value)), "__n": running_sum(F.lit(1))},
    )
    return scanned.withColumn("change", F.col(value) - F.col("previous")).withColumn("mean_so_far", F.col("__sum") / F.col("__n")).drop("__sum", "__n")


def promotion_drop(events: DataFrame, promotions: DataFrame, keys: Sequence[str], hours: int = 72) -> DataFrame:
    """Share of good outcomes in the hours before and after a promotion, and the drop.

    ``promotions`` has one row per key with promoted_at.
    """
    both = events.join(promotions, list(keys))
    gap = F.unix_timestamp("ts") - F.unix_timestamp("promoted_at")
    span = hours * 3600
    before, after = (gap >= -span) & (gap < 0), (gap >= 0) & (gap < span)
    counted = both.groupBy(*keys).agg(
        F.count_if(before).alias("n_before"), F.count_if(before & F.col("good")).alias("good_before"),
        F.count_if(after).alias("n_after"), F.count_if(after & F.col("good")).alias("good_after"),
    )
    b, a = F.try_divide("good_before", "n_before"), F.try_divide("good_after", "n_after")
    return counted.withColumn("drop", F.round(b - a, 6))


# --- triage -----------------------------------------------------------------------

def triage_queues(alignment: DataFrame, edits: DataFrame | None = None, min_distance: int = 40) -> DataFrame:
    """Misses, false positives and large edits as queue rows (queue, ref_id)."""
    out = alignment.filter(F.col("bucket") == "missed").select(F.lit("misses").alias("queue"), F.col("comment_id").alias("ref_id"))
    out = out.unionByName(
        alignment.filter(F.col("bucket") == "false_positive").select(F.lit("false_positives").alias("queue"), F.col("finding_id").alias("ref_id"))
    )
    if edits is not None:
        big = edits.filter(F.levenshtein("draft", "final") >= min_distance)
        out = out.unionByName(big.select(F.lit("edits").alias("queue"), F.col("finding_id").alias("ref_id")))
    return out


def override_queue(measures: DataFrame) -> DataFrame:
    """Override rate by measurement type and page class with sub-totals."""
    fine = measures.groupBy("type", "quality").agg(F.count(F.lit(1)).alias("n"), F.count_if("overridden").alias("overridden"))
    cube = fine.cube("type", "quality").agg(F.sum("n").alias("n"), F.sum("overridden").alias("overridden"))
    return cube.withColumn("rate", F.round(F.try_divide("overridden", "n"), 6))


def lost_matches(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Comments matched before and not matched now; must be empty for the gate to pass."""
    return previous.select("comment_id").distinct().exceptAll(current.select("comment_id").distinct())


def kept_matches(previous: DataFrame, current: DataFrame) -> DataFrame:
    return previous.select("comment_id").intersect(current.select("comment_id"))


def shadow_report(old: DataFrame, new: DataFrame, truth: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Agreement of a shadow run with the default one and which of them is right more often."""
    both = changed(old, new, keys, value).join(truth.select(*keys, F.col(value).alias("truth")), keys)
    old_right, new_right = F.col("old_value").eqNullSafe(F.col("truth")), F.col("new_value").eqNullSafe(F.col("truth"))
    return both.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "same").alias("agree"),
        F.count_if(new_right & ~old_right).alias("wins"), F.count_if(old_right & ~new_right).alias("losses"),
    ).withColumn("promote", F.col("wins") > F.col("losses"))


def amendment_coverage(cited: DataFrame, amended: DataFrame) -> DataFrame:
    """Cited sections per jurisdiction and how many of them are amended there."""
    keys = ["jurisdiction", "canonical_id"]
    marks = cited.select(*keys).distinct().join(amended.select(*keys).distinct().withColumn("a", F.lit(True)), keys, "left")
    return marks.groupBy("jurisdiction").agg(F.count(F.lit(1)).alias("cited"), F.count("a").alias("amended")).withColumn(
        "coverage", F.round(F.col("amended") / F.col("cited"), 6)
    )


def comment_coverage(alignment: DataFrame, comments: DataFrame, triaged: DataFrame) -> DataFrame:
    """Per project: comments, matched ones, triaged ones, and whether they add up."""
    per = comments.groupBy("project_id").agg(F.countDistinct("comment_id").alias("comments"))
    hit = alignment.filter(F.col("bucket").isin("matched", "partial")).groupBy("project_id").agg(F.countDistinct("comment_id").alias("covered"))
    t = triaged.groupBy("project_id").agg(F.countDistinct("comment_id").alias("triaged"))
    joined = per.join(hit, "project_id", "left").join(t, "project_id", "left").fillna(0, ["covered", "triaged"])
    return joined.withColumn("complete", F.col("covered") + F.col("triaged") == F.col("comments"))
