"""Cost, usage, audits, alerts in batch form, project matching and provenance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redliner.functions.text import content_hash, house_number, street_name
from redliner.operators.fuzzy import near_values
from redliner.operators.scan import DEPTH, equi_depth, last_value, ordered_scan, position, running_sum
from redliner.operators.validate import union_all
from redliner.session import durable

# Cost envelope per step of a 50-sheet project, in dollars.
ENVELOPE = {"ingestion": 4.0, "measurement": 1.0, "review": 5.0, "drafting": 1.0}

# What counts as personal data in text.
PERSONAL = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"\d{3}[-. ]\d{3}[-. ]\d{4}",
    "address": r"\d{1,5} [A-Z][a-z]+ (?:St|Street|Ave|Avenue|Rd|Road|Ln|Lane|Blvd|Dr|Drive|Ct|Court)",
    "name": r"(?:Mr|Mrs|Ms|Dr)\. [A-Z][a-z]+",
}


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


# --- calls, cost, usage -------------------------------------------------------------

def call_stats(calls: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cost, tokens, mean and exact 99th percentile latency per key.

    ``calls``: the keys, tokens_in, tokens_out, latency_ms (whole milliseconds)
    and cost_usd. Latencies are counted per value first, which bounds what the
    percentile keeps to the distinct milliseconds.
    """
    ms = calls.groupBy(*keys, "latency_ms").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("cost_usd").cast("decimal(18,6)")).alias("c"), F.sum("tokens_in").alias("ti"), F.sum("tokens_out").alias("to")
    )
    return ms.groupBy(*keys).agg(
        F.sum("n").alias("calls"), F.sum("c").alias("cost_usd"), F.sum("ti").alias("tokens_in"), F.sum("to").alias("tokens_out"),
        (F.sum(F.col("latency_ms") * F.col("n")) / F.sum("n")).alias("mean_latency"),
        F.percentile("latency_ms", F.lit(0.99), F.col("n")).alias("p99_latency"),
    )


def priced(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost from tokens and the price per million of the model; unknown models cost null."""
    per = prices.select("model", "price_in", "price_out")
    cost = (F.col("tokens_in") * F.col("price_in") + F.col("tokens_out") * F.col("price_out")) / 1_000_000
    return calls.join(per, "model", "left").withColumn("cost_usd", cost.cast("decimal(18,6)")).drop("price_in", "price_out")


def project_costs(calls: DataFrame, envelope: Mapping[str, float] | None = None) -> DataFrame:
    """Cost per project and step against the envelope of the step."""
    pairs = [F.lit(x) for item in (envelope or ENVELOPE).items() for x in item]
    per = calls.groupBy("project_id", "step").agg(F.sum(F.col("cost_usd").cast("decimal(18,6)")).alias("cost"))
    budget = F.try_element_at(F.create_map(*pairs), F.col("step"))
    return per.withColumn("budget", budget).withColumn("over", F.coalesce(F.col("cost") > F.col("budget"), F.lit(False)))


def retrieval_stats(log: DataFrame) -> DataFrame:
    """Per section: hits, mean score and spread over all retrievals."""
    hits = log.select(F.explode(F.arrays_zip("matched_section_ids", "scores")).alias("h"))
    return hits.groupBy(F.col("h.matched_section_ids").alias("section_id")).agg(
        F.count(F.lit(1)).alias("hits"), F.avg("h.scores").alias("mean_score"), (F.max("h.scores") - F.min("h.scores")).alias("spread")
    )


def throughput(events: DataFrame, stage: str, ts: str, unit: str = "HOUR") -> DataFrame:
    return events.groupBy(stage, F.date_trunc(unit, ts).alias("period")).agg(F.count(F.lit(1)).alias("n"))


def queue_depth(events: DataFrame, keys: Sequence[str], ts: str, change: Column, row_id: str) -> DataFrame:
    """Running queue depth after each event; ``change`` is +1 for enqueue and -1 for completion."""
    return ordered_scan(events, keys, [F.col(ts), F.col(row_id)], None, {"depth": running_sum(change)})


# --- alerts over logs in batch ------------------------------------------------------

def error_windows(calls: DataFrame, minutes: int = 5, limit: float = 0.10) -> DataFrame:
    """Error share per tumbling window and service with the alert flag."""
    w = F.window("ts", f"{minutes} minutes")
    per = calls.groupBy(w.alias("w"), "service").agg(F.count(F.lit(1)).alias("calls"), F.count_if("failed").alias("errors"))
    share = F.col("errors") / F.col("calls")
    return per.select(F.col("w.start").alias("window_start"), "service", "calls", "errors", (share > limit).alias("alert"))


def success_streaks(calls: DataFrame, need: int = 10) -> DataFrame:
    """Runs of successes between failures per service: length, start, and when the run reached ``need``."""
    order = [F.col("ts"), F.col("event_id")]
    # islands follow the same order, so both scans share the chunks
    cut, chunk = equi_depth(calls, ["service"], order), F.col(DEPTH)
    islands = ordered_scan(cut, ["service"], order, chunk, {"island": running_sum(F.col("failed").cast("int"))}).filter(~F.col("failed"))
    numbered = ordered_scan(islands, ["service", "island"], order, chunk, {"n": position()})
    return numbered.groupBy("service", "island").agg(
        F.max("n").alias("length"), F.min("ts").alias("started_at"), F.min(F.when(F.col("n") == need, F.col("ts"))).alias("recovered_at")
    )


def sessions(events: DataFrame, key: str, ts: str, row_id: str, gap_seconds: int = 1800) -> DataFrame:
    """Activity sessions per key: a pause longer than the gap starts a new one."""
    at = F.col(ts)
    cut, chunk = equi_depth(events, [key], [at, F.col(row_id)]), F.col(DEPTH)
    previous = ordered_scan(cut, [key], [at, F.col(row_id)], chunk, {"__prev": last_value(at, inclusive=False)})
    new = F.col("__prev").isNull() | (_micros(at) - _micros(F.col("__prev")) > gap_seconds * 1_000_000)
    marked = ordered_scan(previous, [key], [at, F.col(row_id)], chunk, {"session_no": running_sum(new.cast("int"))})
    return marked.groupBy(key, "session_no").agg(
        F.count(F.lit(1)).alias("events"), F.min(at).alias("started_at"), F.max(at).alias("ended_at")
    )


def overdue(enqueued: DataFrame, completed: DataFrame, minutes: int = 10) -> DataFrame:
    """Items not completed within the bound: completion time is null or too late."""
    done = completed.groupBy("item_id").agg(F.min("ts").alias("done_at"))
    late = F.col("done_at").isNull() | (_micros(F.col("done_at")) - _micros(F.col("ts")) > minutes * 60_000_000)
    return enqueued.join(done, "item_id", "left").filter(late)


def drain_plan(deferred: DataFrame, per_slot: int) -> DataFrame:
    """First-in-first-out position of each deferred call and the slot it drains in."""
    numbered = ordered_scan(deferred, [], [F.col("ts"), F.col("event_id")], None, {"fifo": position()})
    return numbered.withColumn("slot", F.floor((F.col("fifo") - 1) / per_slot))


def deferred_calls(attempts: DataFrame, limit: int = 3) -> DataFrame:
    """Calls that failed ``limit`` times and never succeeded."""
    per = attempts.groupBy("call_id").agg(
        F.count_if("failed").alias("failures"), F.count_if(~F.col("failed")).alias("successes"), F.max("ts").alias("last_at")
    )
    return per.filter((F.col("failures") >= limit) & (F.col("successes") == 0))


def cost_anomalies(windows: DataFrame, keys: Sequence[str], at: str, value: str, chunk: Column, factor: float = 3.0, min_history: int = 3) -> DataFrame:
    """Windows whose sum exceeds ``factor`` times the mean of all earlier windows."""
    scanned = ordered_scan(
        windows, keys, [F.col(at)], chunk,
        {"__s": running_sum(F.col(value), inclusive=False), "__n": running_sum(F.lit(1), inclusive=False)},
    )
    mean = F.try_divide("__s", "__n")
    hit = (F.col("__n") >= min_history) & (F.col(value) > mean * factor)
    return scanned.withColumn("trailing_mean", mean).withColumn("anomaly", F.coalesce(hit, F.lit(False))).drop("__s", "__n")


# --- audits -------------------------------------------------------------------------

def invariant_audit(findings: DataFrame, citations: DataFrame, measurements: DataFrame) -> DataFrame:
    """Artefacts that lack provenance, frozen text, retrieval chain or trace: one row per invariant."""
    from redliner.operators.validate import has_text, required, violations

    return union_all(
        [
            violations(findings, {
                "finding_evidence": required("evidence_id"), "finding_rule_version": required("rule_version"),
                "finding_text": has_text("draft_comment_text"),
            }),
            violations(citations, {"citation_frozen_text": has_text("frozen_text"), "citation_chain": F.col("chain_steps") > 0}),
            violations(measurements, {"measurement_trace": F.col("trace_steps") > 0, "measurement_confidence": F.col("confidence").between(0, 1)}),
        ]
    )


def citation_fidelity(citations: DataFrame, resolved: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Citations whose frozen text is not the stored text at their date."""
    stored = resolved.select(*keys, content_hash(F.col("applicable_text")).alias("stored_hash"))
    both = citations.join(stored, list(keys), "left")
    return both.filter(~content_hash(F.col("frozen_text")).eqNullSafe(F.col("stored_hash")))


def licensed_flag_audit(findings: DataFrame) -> DataFrame:
    """Findings whose licensed flag is not exactly the membership in the critical set."""
    from redliner.functions.review import needs_license

    return findings.filter(F.col("requires_licensed_review") != needs_license(F.col("rule_id")))


def personal_data(df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """Rows with each kind of personal data per key, in one pass over the text."""
    return df.groupBy(*keys).agg(
        *[F.count_if(F.col(text).rlike(p)).alias(k) for k, p in PERSONAL.items()], F.count(F.lit(1)).alias("n")
    )


# --- matching and provenance ----------------------------------------------------------

def match_project(submitted: DataFrame, projects: DataFrame) -> DataFrame:
    """Submittals to projects: permit number, then parcel number, then address, then similar street.

    Every tier is an equi-join with one representative project per key, so no
    submittal meets more than one candidate per tier. ``candidates`` says how
    many projects share the winning key.
    """
    def keyed(df: DataFrame) -> DataFrame:
        street = street_name(F.col("address"))
        number = house_number(F.col("address"))
        return df.withColumns({
            "k_permit": F.concat_ws("|", "permit_number", "jurisdiction"),
            "k_apn": F.concat_ws("|", "apn", "jurisdiction"),
            "k_address": F.when(number.isNotNull() & street.isNotNull(), F.concat_ws("|", number, street)),
            "k_sound": F.when(number.isNotNull() & street.isNotNull(), F.concat_ws("|", number, F.soundex(street))),
        }).withColumn("k_permit", F.when(F.col("permit_number").isNotNull(), F.col("k_permit"))).withColumn(
            "k_apn", F.when(F.col("apn").isNotNull(), F.col("k_apn")))

    p, s = keyed(projects), keyed(submitted)
    tiers = ["permit", "apn", "address", "sound"]
    for tier in tiers:
        rep = p.filter(F.col(f"k_{tier}").isNotNull()).groupBy(f"k_{tier}").agg(
            F.min("project_id").alias(f"p_{tier}"), F.count(F.lit(1)).alias(f"n_{tier}")
        )
        # rows without the key of a tier match nothing; each looks under a name of its own, so that they do not meet in one task
        own = F.coalesce(f"k_{tier}", F.concat(F.lit("\0"), F.xxhash64(*submitted.columns).cast("string")))
        s = s.withColumn(f"k_{tier}", own).join(rep, f"k_{tier}", "left")
    how = F.lit(None).cast("string")
    count = F.lit(None).cast("long")
    for tier in reversed(tiers):
        how = F.when(F.col(f"p_{tier}").isNotNull(), tier).otherwise(how)
        count = F.when(F.col(f"p_{tier}").isNotNull(), F.col(f"n_{tier}")).otherwise(count)
    return s.select(
        *submitted.columns, F.coalesce(*[F.col(f"p_{tier}") for tier in tiers]).alias("project_id"), how.alias("matched_by"), count.alias("candidates")
    )


def match_project_near(submitted: DataFrame, projects: DataFrame, key: str, edits: int = 2) -> DataFrame:
    """``match_project``, and for what it leaves open the street of the same house number that is at most ``edits`` edits away.

    The nearest street wins, then the smallest project; ``matched_by`` is "near".
    ``key`` names a row of ``submitted``.
    """
    first = durable(match_project(submitted, projects))
    split = lambda df: df.withColumns({"__number": house_number(F.col("address")), "__street": street_name(F.col("address"))})
    streets = split(projects).filter("__number is not null and __street is not null").groupBy("__number", "__street").agg(F.min("project_id").alias("__p"), F.count(F.lit(1)).alias("__n"))
    open_ = split(first.filter("project_id is null"))
    pairs = near_values(open_, streets, "__number", "__street", edits).join(streets.withColumnRenamed("__street", "near"), ["__number", "near"])
    best = pairs.groupBy("__number", "__street").agg(F.min(F.struct("edits", "__p", "__n")).alias("__best"))
    later = open_.filter("__number is not null").join(best, ["__number", "__street"]).select(F.col(key).alias("__key"), "__best")
    found = first.join(later, F.col(key) == F.col("__key"), "left")
    return found.withColumns({
        "matched_by": F.coalesce("matched_by", F.when(F.col("__best").isNotNull(), "near")), "candidates": F.coalesce("candidates", "__best.__n"),
        "project_id": F.coalesce("project_id", "__best.__p")}).drop("__key", "__best")


def provenance_chain(findings: DataFrame, evidence: DataFrame, measurements: DataFrame, retrievals: DataFrame) -> DataFrame:
    """Finding to evidence to measurement to sheet, and finding to citation to retrieval; gaps stay null."""
    e = findings.join(evidence, "finding_id", "left").join(
        measurements.select("measurement_id", "sheet_id", "value", "confidence"), "measurement_id", "left"
    )
    r = retrievals.select("citation", F.col("retrieval_id"))
    first = r.groupBy("citation").agg(F.min("retrieval_id").alias("retrieval_id"))
    return e.join(first, "citation", "left")


def typed_view(entities: DataFrame, kind: str, fields: str, where: Column | None = None) -> DataFrame:
    """Entities of one type with their payload as columns; ``fields`` is a DDL list."""
    chosen = entities.filter(F.col("type") == kind).withColumn("p", F.from_json("payload", fields))
    out = chosen.select("entity_id", "sheet_id", "confidence", "p.*")
    return out if where is None else out.filter(where)
