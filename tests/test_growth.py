"""Work that must not grow faster than its input: what is joined, broadcast and written."""

from datetime import date, timedelta

from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from redliner.operators.matching import Tier, tiered_assignment
from redliner.operators.nearest import nearest_place
from redliner.plans import codekb, measure, review


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_versions_are_not_collected_for_a_broadcast(spark):
    sections = spark.range(200).select(F.col("id").alias("section_id"), (F.col("id") % 5).alias("canonical_id"), F.lit(date(2020, 1, 1)).alias("effective_date"),
                                       F.when(F.col("id") % 50 == 0, F.col("id") + 1).alias("superseded_by_id"), F.lit("x").alias("body_text"))
    assert "BroadcastHashJoin" not in plan(codekb.closing_dates(sections))


def test_replaced_patches_meet_no_interval(spark):
    first, n = date(2020, 1, 1), 200
    made = [(2 * k + i, 1, "J", op, f"{op} {k}", k, first + timedelta(days=k), None) for k in range(n) for i, op in enumerate(("replace", "append"))]
    amendments = spark.createDataFrame(made, "amendment_id long, canonical_id long, jurisdiction string, operation string, amendment_text string, ordinal long, effective_date date, closes_at date")
    keys = spark.createDataFrame([(1, "J", first + timedelta(days=k)) for k in range(-1, n)], "canonical_id long, jurisdiction string, as_of date")
    held = codekb.segments(keys, amendments)
    last, after = codekb.live_fragments(held, amendments)
    # one patch stands behind each day's replacement, whatever was replaced before
    assert last.count() == n and after.count() == n
    folded = codekb.folded_fragments(keys, keys.withColumn("body_text", F.lit("base")), amendments).orderBy("as_of", "pos").collect()
    assert [(r["pos"], r["fragment"]) for r in folded] == [(0, "base"), *[x for k in range(n) for x in ((0, f"replace {k}"), (1, f"append {k}"))]]


def test_policies_of_a_section_are_summed_up_once(spark):
    keys = spark.createDataFrame([(c, "J", date(2020, 1, d)) for c in (1, 2) for d in (1, 2, 3)], "canonical_id long, jurisdiction string, as_of date")
    sections = spark.createDataFrame([(10, 1, date(2019, 1, 1), None, "text")], "section_id long, canonical_id long, effective_date date, superseded_by_id long, body_text string")
    amendments = spark.createDataFrame([(5, 1, "J", "append", "more", 1, date(2020, 1, 2), None)],
                                       "amendment_id long, canonical_id long, jurisdiction string, operation string, amendment_text string, ordinal long, effective_date date, closes_at date")
    policies = spark.range(9, 12).select(F.col("id").alias("policy_id"), F.lit("t").alias("title"), F.array(F.lit(1), F.lit(1)).cast("array<bigint>").alias("applies_to_sections"))
    got = codekb.chain_summary(keys, sections, amendments, policies)
    chain = codekb.retrieval_chain(keys, sections, amendments, policies).groupBy(*codekb.KEY, "kind").agg(F.count(F.lit(1)), F.min("ref"), F.max("ref"))
    rows = sorted(map(tuple, got.collect()), key=str)
    assert rows == sorted(map(tuple, chain.collect()), key=str)
    assert (1, "J", date(2020, 1, 1), "policy", 6, "10", "9") in rows and (2, "J", date(2020, 1, 1), "state_section", 1, None, None) in rows


def test_a_summary_reads_every_step_of_every_lookup(spark, monkeypatch):
    keys = spark.createDataFrame([(c, "J", date(2020, 1, d)) for c in (1, 2, 3) for d in (1, 2, 3)] + [(1, None, date(2020, 1, 1)), (None, "J", date(2020, 1, 1))],
                                 "canonical_id long, jurisdiction string, as_of date")
    sections = spark.createDataFrame([(10, 1, date(2019, 1, 1), None, "text")], "section_id long, canonical_id long, effective_date date, superseded_by_id long, body_text string")
    amendments = spark.createDataFrame([(5, 1, "J", "append", "more", 1, date(2020, 1, 2), None)],
                                       "amendment_id long, canonical_id long, jurisdiction string, operation string, amendment_text string, ordinal long, effective_date date, closes_at date")
    # section 1 has 11 policies, one of them without id, section 2 has two
    policies = spark.createDataFrame([(i if i else None, "t", [1, 2] if i > 8 else [1]) for i in range(11)], "policy_id long, title string, applies_to_sections array<bigint>")
    monkeypatch.setattr(codekb, "STEPS", 2)
    monkeypatch.setattr(codekb, "STRETCH", 2)
    read, whole = [], codekb.retrieval_chain
    monkeypatch.setattr(codekb, "retrieval_chain", lambda *args, **how: read.append(whole(*args, **how)) or read[-1])
    got = sorted(map(str, codekb.chain_summary(keys, sections, amendments, policies).collect()))
    steps = {(r["canonical_id"], r["jurisdiction"], r["as_of"], r["kind"]): [] for r in read[0].collect()}
    for r in read[0].collect():
        assert len(r["refs"]) <= 2
        steps[r["canonical_id"], r["jurisdiction"], r["as_of"], r["kind"]] += r["refs"]
    assert len(steps[1, "J", date(2020, 1, 2), "policy"]) == len(steps[1, None, date(2020, 1, 1), "policy"]) == 11 and (None, "J", date(2020, 1, 1), "state_section") in steps
    rows = whole(keys, sections, amendments, policies).collect()
    assert sum(map(len, steps.values())) == len(rows) == 11 + 2 + 4 * 11 + 3 * 2
    want = spark.createDataFrame(rows, "canonical_id long, jurisdiction string, as_of date, stage int, ord long, kind string, ref string").groupBy(*codekb.KEY, "kind").agg(
        F.count(F.lit(1)).alias("steps"), F.min("ref").alias("first_ref"), F.max("ref").alias("last_ref"))
    assert got == sorted(map(str, want.collect()))


def test_positions_of_one_point_are_one_point(spark):
    points = spark.createDataFrame(
        [(1, "a", 0.0, 0.0), (1, "a", 3.0, 0.0), (1, "b", 9.0, 0.0), (1, "b", 9.0, 0.0), (1, "c", None, 1.0), (2, "a", 0.0, 0.0)], "sheet_id int, point_id string, x double, y double")
    exits = spark.createDataFrame([(1, "e", 4.0, 0.0), (1, "f", 20.0, 0.0), (1, "g", 4.0, 0.0)], "sheet_id int, exit_id string, x double, y double")
    found = nearest_place(points, exits, ["sheet_id"], "point_id", "exit_id")
    assert sorted(map(tuple, found.collect())) == [(1, "a", "e", 1.0), (1, "b", "e", 5.0), (1, "c", None, None), (2, "a", None, None)]
    rows = measure.egress_nearest(points, exits).orderBy("sheet_id").collect()
    assert [(r["sheet_id"], r["travel"], r["points"], r["unserved"], r["exits_used"]) for r in rows] == [(1, 5.0, 3, 1, 1), (2, None, 1, 1, 0)]


def test_tiers_read_what_the_tier_before_left_over(spark, monkeypatch):
    side = lambda name, rows: spark.createDataFrame(rows, f"{name} long, p long, s string")
    left, right = side("l", [(1, 1, "a"), (2, 1, "a"), (3, 1, None), (4, None, "a")]), side("r", [(7, 1, "a"), (8, 1, "b"), (9, 1, None)])
    hows, join = [], DataFrame.join
    monkeypatch.setattr(DataFrame, "join", lambda self, other, on=None, how=None: hows.append(how) or join(self, other, on, how))
    got = tiered_assignment(left, right, [Tier("both", ("p", "s")), Tier("p", ("p",)), Tier("s", ("s",))], "l", "r")
    # no row is held against all pairs found so far
    assert "left_anti" not in hows
    assert sorted(map(tuple, got.collect())) == [(1, 7, "both", 1), (2, 8, "p", 2), (3, 9, "p", 2)]


def test_letters_write_no_column_they_do_not_show(spark, monkeypatch):
    from redliner.operators import scan

    written, durable = [], scan.durable
    monkeypatch.setattr(scan, "durable", lambda df: written.append(set(df.columns)) or durable(df))
    rows = [(f"f{i}", 1, "structural", "R", i % 2, 0, 1 + i % 2, "approved", None if i % 2 else "final", "draft", None, 0.5) for i in range(4)]
    findings = spark.createDataFrame(rows, "finding_id string, project_id long, discipline string, rule_id string, sheet_id long, tag long, round int, approval_state string, "
                                     "final_text string, draft_comment_text string, crop_uri string, confidence double")
    columns = ["project_id", "round", "finding_id", "comment_text", "style"]
    got = review.assembled_letter(findings, ["project_id", "round"], ["sheet_id", "finding_id"], columns)
    assert written and not written[0] & {"confidence", "draft_comment_text", "final_text", "rule_id", "crop_uri"}
    whole = review.assembled_letter(findings, ["project_id", "round"], ["sheet_id", "finding_id"]).select(*columns, "comment_number")
    assert got.columns == whole.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))


def test_wide_rows_are_numbered_in_one_move(spark, monkeypatch):
    from redliner.operators import scan

    written, dense = [], scan.dense
    monkeypatch.setattr(scan, "dense", lambda df: written.append(df) or dense(df))
    # letter 1 is cut by many partitions, its comments repeat; letters without a key are none
    rows = [(1, "a" if i % 50 else None, i % 7, f"x{i // 2:04}") for i in range(600)] + [(p, "b", p % 3, "y") for p in range(2, 60)] + [(None, "a", 1, "z")]
    frame = spark.createDataFrame(rows, "p long, r string, s int, t string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [tuple(r) for r in scan.numbered(frame, ["p", "r"], [F.col("s"), F.col("t")], "n").collect()]
        depths = {r["__depth"] for r in written[0].collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want, seen = [], {}
    for r in sorted((r for r in rows if None not in r), key=str):
        seen.setdefault(r[:2], []).append(r[2:])
    want = [(*k, *x, i) for k, found in seen.items() for i, x in enumerate(sorted(found), 1)]
    assert sorted(got) == sorted(want) and len(depths) > 1
    plan = written[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Window" not in plan and written[0].columns == ["p", "r", "s", "t", "__depth", "__local"]


def test_headers_go_to_the_parts_of_their_letter(spark):
    letter = spark.createDataFrame([(1, 1, i, f"c{i}") for i in range(1, 6)] + [(2, 1, 1, "d")], "p long, r int, comment_number long, comment_text string")
    headers = spark.createDataFrame([(1, 1, "h"), (1, 2, "h"), (2, 1, "h"), (2, 1, "again"), (None, 1, "h")], "p long, r int, submittal_id string")
    bundle = review.full_bundle(letter, headers, ["p", "r"], 2)
    assert sorted(map(tuple, bundle.select("p", "r", "part", "n_findings").collect()), key=str) == sorted(
        [(1, 1, 1, 2), (1, 1, 2, 2), (1, 1, 3, 1), (1, 2, 1, 0), (2, 1, 1, 1), (2, 1, 1, 1), (None, 1, 1, 0)], key=str)
    # the nested parts are moved when they are put together and not again
    lines = bundle._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    at = next(i for i, x in enumerate(lines) if "ObjectHashAggregate" in x)
    above = [x for i, x in enumerate(lines[:at]) if all(depth(y) > depth(x) for y in lines[i + 1:at + 1])]
    assert above and not any("Exchange" in x for x in above)


def test_boxes_of_one_height_and_left_edge_are_scanned_as_one(spark, monkeypatch):
    from redliner.operators import overlap

    scanned, spans = [], overlap._spans
    monkeypatch.setattr(overlap, "_spans", lambda boxes, *rest: scanned.append(boxes.count()) or spans(boxes, *rest))
    rows = [(1, 1000 * k + i, 10.0 * k, 0.0, 10.0 * k + 1 + i % 30 / 10, 5.0) for k in range(3) for i in range(200)]
    rows += [(1, 5000, 31.0, 4.0, 40.0, 6.0), (1, 5001, 41.0, 0.0, 50.0, 5.0), (1, 5002, 90.0, 0.0, 90.0, 5.0), (1, 5003, 90.0, 0.0, 91.0, 5.0)]
    boxes = spark.createDataFrame(rows, "s long, id long, x1 double, y1 double, x2 double, y2 double")
    got = {r["id"] for r in overlap.overlapping(boxes, ["s"], "id").collect()}
    assert got == {r[1] for r in rows if r[1] < 5000} and scanned.pop() == 6
    left = boxes.withColumnRenamed("id", "a").withColumn("x1", F.col("x1") + 0.5).withColumn("x2", F.col("x1") + 1)
    found = {r["a"]: r["b"] for r in overlap.overlaps_any(left, boxes.withColumnRenamed("id", "b"), ["s"], "a", "b").collect()}
    assert scanned.pop() == 13
    for _, n, x1, y1, _, y2 in rows:
        a1, a2 = x1 + 0.5, x1 + 1.5
        want = max(((b[4], b[1]) for b in rows if b[2] < b[4] and b[2] < a2 and b[4] > a1 and b[3] < y2 and b[5] > y1), default=None)
        assert found.get(n) == (want and want[1])


def test_points_under_boxes_of_one_height_and_left_edge_meet_the_farthest(spark, monkeypatch):
    from redliner.operators import overlap

    scanned, spans = [], overlap._spans
    monkeypatch.setattr(overlap, "_spans", lambda boxes, *rest: scanned.append(boxes.count()) or spans(boxes, *rest))
    rows = [(1, 1000 * k + i, 10.0 * k, 0.0, 10.0 * k + 1 + i % 30 / 10, 5.0) for k in range(3) for i in range(50)]
    rows += [(1, 5000, 31.0, 4.0, 40.0, 6.0), (1, 5001, 41.0, 0.0, 50.0, 5.0), (1, 5002, 90.0, 0.0, 90.0, 5.0), (1, 5003, 90.0, 0.0, 91.0, 5.0)]
    boxes = spark.createDataFrame(rows, "s long, b long, x1 double, y1 double, x2 double, y2 double")
    left = boxes.withColumnRenamed("b", "a").withColumn("x1", F.col("x1") + 0.5).withColumn("x2", F.col("x1") + 1)
    found = {r["a"]: r["b"] for r in overlap.overlaps_any(left, boxes, ["s"], "a", "b").collect()}
    # six different questions, since 5002 and 5003 ask the same, and six boxes that can answer
    assert scanned == [12]
    for _, n, x1, y1, _, y2 in rows:
        a1, a2 = x1 + 0.5, x1 + 1.5
        want = max(((b[4], b[1]) for b in rows if b[2] < b[4] and b[2] < a2 and b[4] > a1 and b[3] < y2 and b[5] > y1), default=None)
        assert found.get(n) == (want and want[1])


def test_only_boxes_alone_at_their_corner_ask_for_another(spark, monkeypatch):
    from redliner.operators import overlap

    ranked, scanned, spans, scan = [], [], overlap._spans, overlap.ordered_scan
    monkeypatch.setattr(overlap, "_spans", lambda boxes, *rest: ranked.append(boxes.count()) or spans(boxes, *rest))
    monkeypatch.setattr(overlap, "ordered_scan", lambda df, keys, *rest: scanned.append(df.count() if "cell" in keys else 0) or scan(df, keys, *rest))
    # on sheet 1 every corner has several boxes of different heights; sheet 2 has boxes alone beside them, sheet None is none
    rows = [(1, 100 * k + i, 10.0 * k, 3.0 * k, 10.0 * k + 1 + i % 3, 3.0 * k + 1 + i % 7) for k in range(5) for i in range(20)]
    rows += [(2, 900 + i, 4.0, 0.0, 6.0 + i % 2, 9.0 + i) for i in range(8)]
    rows += [(2, 1000, 0.0, 0.0, 4.0, 9.0), (2, 1001, 7.0, 0.0, 9.0, 9.0), (2, 1002, 6.5, 2.0, 6.8, 3.0), (2, 1003, 3.0, 8.0, 4.5, 9.5), (2, 1004, 4.0, 20.0, 5.0, 21.0)]
    rows += [(None, 2000, 0.0, 0.0, 1.0, 1.0), (None, 2001, 0.0, 0.0, 1.0, 1.0)]
    boxes = lambda part: spark.createDataFrame(part, "s long, id long, x1 double, y1 double, x2 double, y2 double")
    want = {a[1] for a in rows if a[0] is not None and any(a[1] != b[1] and a[0] == b[0] and a[2] < b[4] and a[4] > b[2] and a[3] < b[5] and a[5] > b[3] for b in rows)}
    assert {r["id"] for r in overlap.overlapping(boxes(rows), ["s"], "id").collect()} == want and {1000, 1003} & want == {1000, 1003} and not {1001, 1004} & want
    # the boxes of sheet 1 have no one who asks for them
    assert ranked.pop() == 8 + 5
    assert {r["id"] for r in overlap.overlapping(boxes(rows[:100]), ["s"], "id").collect()} == {r[1] for r in rows[:100]}
    assert ranked.pop() == 0 and scanned[-1] == 0


def test_a_dimension_text_asks_once(spark, monkeypatch):
    from redliner.operators import asof

    scanned, scan = [], asof.ordered_scan
    monkeypatch.setattr(asof, "ordered_scan", lambda df, *rest: scanned.append(df.count()) or scan(df, *rest))
    texts = [(1, f"t{i}", "h", 7.0 * i, 10.0 + 15 * (i % 4), 12.0) for i in range(12)] + [(1, "t0", "h", 50.0, 70.0, 12.0), (1, "n", "h", None, 10.0, 12.0), (2, "o", "h", 1.0, 1.0, 12.0)]
    lines = [(1, f"l{i}", "h", 11.0 * (i % 5), 6.0 + 9 * i, 12.0 + i) for i in range(9)] + [(1, "m", "h", 0.0, 6.0, 9.0), (1, "v", "v", 7.0, 10.0, 1.0)]
    got = measure.verify_dimensions(spark.createDataFrame(texts, "sheet_id int, text_id string, orientation string, along double, across double, text_in double"),
                                    spark.createDataFrame(lines, "sheet_id int, line_id string, orientation string, along double, across double, geom_in double")).collect()
    want = {}
    for s, t, o, at, across, _ in texts:
        near = [(abs(at - x[3]), abs(x[4] // 20 - across // 20), x[3], x[1]) for x in lines if at is not None and x[0] == s and x[2] == o and abs(x[4] // 20 - across // 20) <= 1]
        want[t] = sorted([*near, *want.get(t, [])])[:1]
    assert sorted((r["text_id"], r["line_id"], r["gap"]) for r in got) == sorted((t, *((want[t][0][3], want[t][0][0]) if want[t] else (None, None))) for _, t, *_ in texts)
    # one scan of a row per text and of a row per place that a line is seen at
    assert scanned == [len(texts) + len({(x[0], x[2], x[4] // 20 + d, x[3]) for x in lines for d in (-1, 0, 1)})]


def test_a_lookup_meets_blocks_of_its_section_and_not_steps(spark, monkeypatch):
    scanned, scan = [], codekb.ordered_scan
    monkeypatch.setattr(codekb, "ordered_scan", lambda df, *rest: scanned.append(df.count()) or scan(df, *rest))
    monkeypatch.setattr(codekb, "STRETCH", 2)
    keys = spark.createDataFrame([(c, "J", date(2020, 1, d)) for c in range(1, 7) for d in range(1, 9)], "canonical_id long, jurisdiction string, as_of date")
    sections = spark.createDataFrame([(10 + c, c, date(2019, 1, 1), None, "text") for c in (1, 2, 3, 5)], "section_id long, canonical_id long, effective_date date, superseded_by_id long, body_text string")
    amendments = spark.createDataFrame([(100 * c + d, c, "J", "insert_before" if d % 3 else "append", "more", d, date(2020, 1, d), None) for c in (1, 2, 4) for d in range(2, 9)],
                                       "amendment_id long, canonical_id long, jurisdiction string, operation string, amendment_text string, ordinal long, effective_date date, closes_at date")
    # section 1 has 23 policies, section 2 exactly two pages, 3 and 4 one each, 5 none, 6 only references
    policies = spark.createDataFrame([(i, "t", [1]) for i in range(17)] + [(50 + i, "t", [1, 2]) for i in range(6)] + [(90, "t", [3, 4])], "policy_id long, title string, applies_to_sections array<bigint>")
    references = spark.createDataFrame([(1, 5), (1, 2), (1, 2), (6, 1), (6, None), (None, 3)], "canonical_id long, target_id long")
    told = codekb.retrieval_chain(keys, sections, amendments, policies, references)
    want = sorted(map(str, codekb.retrieval_log(told, 3).collect()))
    scanned.clear()
    assert sorted(map(str, codekb.lookup_log(keys, sections, amendments, policies, references, 3).collect())) == want
    # 31 policies of sections and 3 references, not one for each of the eight lookups of a section
    assert scanned[-1] == 23 + 6 + 2 + 3
    pages = {(r["query"], r["effective_date"], r["part"]): r["matched_section_ids"] for r in codekb.retrieval_log(told, 3).collect()}
    got = codekb.lookup_sections_full(keys, sections, amendments, policies, references, 3).collect()
    lists = {(str(r["canonical_id"]), r["as_of"], r["part"]): (r["amendments"], r["agency_policies"], r["cross_refs"]) for r in got if r["chain"]}
    assert {k: sum(v, []) for k, v in lists.items()} == {k: [x for x in v if not (k[2] == 1 and x == str(10 + int(k[0])))] for k, v in pages.items()}
    assert sum(r["unamended_text"] is not None for r in got) == 4 * 8


def test_only_entries_that_repeat_are_numbered_by_a_scan(spark, monkeypatch):
    from redliner.plans import integrity

    scanned, scan = [], integrity.ordered_scan
    monkeypatch.setattr(integrity, "ordered_scan", lambda df, *rest: scanned.append(df.count()) or scan(df, *rest))
    index = lambda rows: spark.createDataFrame(rows, "project_id long, ord long, declared_id string, declared_title string")
    sheets = lambda rows: spark.createDataFrame(rows, "project_id long, ord long, sheet_id string, canonical_id string, sheet_title string")
    entries = [(p, n, f"A-{n}" if n != 2 else "B", "Plan") for p in range(3) for n in range(4)]
    found = [(p, n, f"{p}:{n}", f"A-{n}", "plan" if n else "x") for p in range(3) for n in range(5)]
    got = sorted(integrity.reconcile_index(index(entries), sheets(found)).groupBy("status").count().collect())
    assert got == [("match", 6), ("mismatched_id", 3), ("mismatched_title", 3), ("orphan", 3)] and scanned == []
    # one id three times in the index, twice in the set; an entry and a sheet without an id stay as they are
    entries += [(0, 7, "A-1", "Plan"), (0, 8, "A-1", "Plan"), (1, 9, None, "Plan")]
    found += [(0, 6, "0:6", "A-1", "Plan"), (2, 6, "2:6", None, "Plan")]
    got = sorted(integrity.reconcile_index(index(entries), sheets(found)).groupBy("status").count().collect())
    assert got == [("match", 7), ("mismatched_id", 3), ("mismatched_title", 3), ("missing", 1), ("orphan", 5)]
    assert scanned == [3, 2]


def test_busy_tasks_do_not_grow_with_the_table(spark, monkeypatch, tmp_path):
    from redliner import session

    monkeypatch.setattr(session, "SPREAD_ROWS", 100)
    spark.range(2_000).coalesce(1).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    parts = session.spread(table, "id").rdd.glom().map(len).collect()
    assert len(parts) == 20 and sum(parts) == 2_000 and max(parts) < 200
    assert session.spread(table.limit(90), "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_joins_of_entities_do_not_compute_them_again(spark):
    parts = spark.createDataFrame([(1, 1, 0.0, 1.0), (1, 1, 2.0, 1.0), (1, 2, 5.0, 1.0), (2, 2, 0.0, 0.0)], "sheet_id int, entity_id int, x double, y double")
    entities = parts.groupBy("sheet_id", "entity_id").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    entities = entities.select("sheet_id", "entity_id", F.array(F.col("x"), F.col("y"), F.col("x") + 1, F.col("y") + 2).alias("bbox"))
    requests = spark.createDataFrame([(1, 1, 2), (1, 2, 1), (1, 1, 3), (2, 1, 2)], "sheet_id int, entity_a int, entity_b int")
    got = measure.measure_between(requests, entities)
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, got.collect())) == [(1, 1, 2, 5.0, 4.0), (1, 2, 1, 5.0, 4.0)]


def test_boxes_of_a_small_sheet_move_once(spark, monkeypatch):
    from redliner.operators import overlap

    scanned, spans = [], overlap._spans
    monkeypatch.setattr(overlap, "_spans", lambda boxes, *rest: scanned.append(boxes.select("s").distinct().collect()) or spans(boxes, *rest))
    # sheets of six boxes each, one without a right box, one of 400 boxes, one with a null key
    x, y = lambda s, i: (s * 11 + i * 7) % 31, lambda s, i: (s * 3 + i * 5) % 17
    at = lambda s, i: (s, f"{s}/{i}", float(x(s, i)), float(y(s, i)), float(x(s, i) + 1 + (s + i) % 9), float(y(s, i) + 4 + i % 4))
    left = [at(s, i) for s in range(1, 40) for i in range(0, 15, 5)] + [at(50, 1), (1, "1/0", 500.0, 0.0, 501.0, 1.0), (1, "p", 0.0, 0.0, 0.0, 1.0), (2, "q", None, 0.0, 9.0, 9.0)]
    right = [at(s, i + 3 + s % 4) for s in range(1, 40) for i in range(0, 15, 5)] + [(3, "tie", *at(3, 3)[2:]), (None, "n", 0.0, 0.0, 99.0, 99.0)]
    frames = lambda a, b: [spark.createDataFrame(rows, f"s long, {n} string, x1 double, y1 double, x2 double, y2 double") for rows, n in ((a, "a"), (b, "b"))]

    def want(a, b):
        best = {}
        for s, n, x1, y1, x2, y2 in a:
            met = [(o[4], o[1]) for o in b if o[0] == s and None not in (x1, y1, x2, y2) and x1 < x2 and o[2] < x2 and o[4] > x1 and o[3] < y2 and o[5] > y1]
            if met:
                best[s, n] = max([*met, *([best[s, n]] if (s, n) in best else [])])
        return {(s, n, b[1]) for (s, n), b in best.items()}

    got = overlap.overlaps_any(*frames(left, right), ["s"], "a", "b")
    assert {tuple(r) for r in got.collect()} == want(left, right) and got.count() == len(want(left, right)) > 20
    # no cell is made, and nothing is ranked
    assert not scanned and "Window" not in plan(got)
    hot = [at(60, i) for i in range(200)]
    got = overlap.overlaps_any(*frames(left + hot, right + [at(60, i) for i in range(200, 400)]), ["s"], "a", "b")
    assert {tuple(r) for r in got.collect()} == want(left + hot, right + [at(60, i) for i in range(200, 400)])
    # only the busy sheet goes through cells
    assert [[r["s"] for r in rows] for rows in scanned] == [[60]]
    # nor does it matter which way a sheet goes
    monkeypatch.setattr(overlap, "SMALL_SHEET", 0)
    got = overlap.overlaps_any(*frames(left, right), ["s"], "a", "b")
    assert {tuple(r) for r in got.collect()} == want(left, right) and len(scanned) == 2


def test_tall_boxes_fill_no_cell_that_a_flat_one_cannot_hold(spark, monkeypatch):
    from redliner.operators import overlap

    events, keys, scan, durable = [], [], overlap.ordered_scan, overlap.durable
    monkeypatch.setattr(overlap, "SMALL_SHEET", 0)
    monkeypatch.setattr(overlap, "ordered_scan", lambda df, by, *rest: events.append(df) or scan(df, by, *rest))
    monkeypatch.setattr(overlap, "durable", lambda df: (df.columns == ["__key"] and keys.append(df.count())) or durable(df))
    # flat boxes under tall ones; one id has three boxes, of which two meet a tall one
    left = [(1, f"a{k}", 3.0 * k, float(k), 3.0 * k + 2, k + 1.0) for k in range(40)] + [(1, "a3", 90.0, 7.0, 91.0, 8.0), (1, "a3", 900.0, 7.0, 901.0, 8.0)]
    right = [(1, f"b{j}", 5.0 * j, float(j), 5.0 * j + 7 + j % 3, j + 25.0) for j in range(30)]
    frame = lambda rows, n: spark.createDataFrame(rows, f"s long, {n} string, x1 double, y1 double, x2 double, y2 double")
    got = sorted((r["a"], r["b"]) for r in overlap.overlaps_any(frame(left, "a"), frame(right, "b"), ["s"], "a", "b").collect())
    want = {}
    for _, n, x1, y1, x2, y2 in left:
        for _, m, u1, v1, u2, v2 in right:
            if u1 < x2 and u2 > x1 and v1 < y2 and v2 > y1:
                want[n] = max(want.get(n, (0.0, "")), (u2, m))
    assert got == sorted((n, m) for n, (_, m) in want.items()) and "a3" in want
    cells = events[-1].filter("__side = 1")
    # a flat box holds single ranks only, which a tall one holds or misses
    assert cells.count() > 30 and cells.filter("not hold").isEmpty()
    # only the id with several boxes is grouped
    assert keys == [1]


def test_fields_that_nobody_reads_are_not_searched(spark):
    from redliner.functions import text, titleblock
    from redliner.plans import extraction

    spans = "array<struct<ord:int,block_type:int,text:string,bbox:array<double>>>"
    line = lambda i, t, kind=0: (i, kind, t, [70.0, 1.0 + i, 90.0, 2.0 + i])
    rows = [(1, 1, 100.0, 90.0, [line(2, "APN: 022-211"), line(1, " Project: Ann "), line(3, "Scale: 1/4"), line(4, "apn: 7", 1), line(5, "x")], None, None, None)]
    pages = spark.createDataFrame(rows, f"document_id long, page int, width double, height double, spans {spans}, full_text string, images array<struct<w:int,h:int>>, canonical_address string")
    answers = spark.createDataFrame([(1, 1, '```json\n{"apn": {"value": "022-211", "bbox_frac": [0, 0, 1, 1]}, "sheet_title": {"value": "Plan"}}\n```')], "document_id long, page int, response_json string")
    blocks = extraction.extract_title_blocks(pages, answers)
    got = blocks.select("apn", "sheet_title", "project_name", "scale_declared").first()
    assert (got["apn"]["value"], got["apn"]["confidence"], got["apn"]["bbox"]) == ("022-211", 0.95, [70.0, 3.0, 90.0, 4.0])
    assert (got["sheet_title"]["value"], got["sheet_title"]["source_track"], got["project_name"]["value"]) == ("Plan", "vision", "Ann")
    assert got["scale_declared"]["value"] == "1/4"
    one = blocks.select("apn.value")._jdf.queryExecution().executedPlan().toString()
    assert "apn[" in one and "scale[" not in one and "architect" not in one
    # the words of a text are split once
    pair = spark.range(1).select(F.col("id").cast("string").alias("a"), F.lit("b").alias("b")).repartition(1)
    assert pair.select(text.token_jaccard(F.col("a"), F.col("b")).alias("j"))._jdf.queryExecution().analyzed().toString().count("split(") == 2
    # words that stand for a pattern leave out no text that it finds
    lows = ["iſſued: 1/2/2020", "deſıgner: bo", "ſcale: 1/8", "dated 1/2/2020", "permit no b25-0001", "ref b25-0001", "drawn by al", "building permit: 9", "parcel # 1-2", "", None]
    texts = spark.createDataFrame([(t,) for t in lows], "t string")
    plain = lambda f: F.coalesce(*[F.nullif(F.regexp_extract("t", titleblock.FLAGS + p, 1), F.lit("")) for p in titleblock.LABEL_PATTERNS[f]])
    for f in titleblock.FIELDS:
        assert all(r[0] == r[1] for r in texts.select(titleblock.label_value(F.col("t"), f), text.strip(plain(f))).collect()), f
