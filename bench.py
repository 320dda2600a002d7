"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs over its whole tables into a sink that discards the rows. A
small warm-up keeps JVM start and first compilation out of the first figure.
"""

from __future__ import annotations

import json
import os
import sys
import time

from redliner.catalog import load
from redliner.session import local_session, remove_durables

HEADLINE = [
    "projects_sheet_count", "sheets_by_project", "payload_json_filter", "dedupe_documents", "narrative_segments", "review_letter_comments",
    "title_block_extraction", "index_reconcile", "callout_vs_schedule", "bbox_overlap", "plan_integrity_rules", "claims_resolved", "claims_conflicts",
    "asof_section", "amendment_fold", "lookup_section", "vector_topk", "vector_topk_batch", "scale_resolution", "nearest_dimension_line", "exit_separation",
    "routed_egress", "confidence_gate", "discipline_row_rules", "threshold_rules", "round_manager", "letter_numbering", "letter_bundle", "alignment",
    "rule_metrics", "metrics_rollup", "edit_distance", "error_rate_5min", "success_streak", "reviewer_sessions", "fk_audit", "pii_inventory", "match_project",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus)
    registry = load()
    registry["projects_sheet_count"].run(spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        registry[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        remove_durables(spark)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
