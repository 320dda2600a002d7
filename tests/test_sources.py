"""Files, append-only tables, packs, bundles and ingest."""

import hashlib
import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from redliner.plans import claims, codekb, extraction, findings, integrity, review
from redliner.plans import rules as rl
from redliner.sources import documents as docs
from redliner.sources import packs, parsing


def test_file_hashes_and_dedupe(spark, tmp_path):
    for name, body in [("a.pdf", b"one"), ("b.pdf", b"two"), ("c.pdf", b"one")]:
        (tmp_path / name).write_bytes(body)
    files = docs.read_files(spark, str(tmp_path), "*.pdf")
    got = {r["content_hash"] for r in files.collect()}
    assert got == {hashlib.sha256(b).hexdigest() for b in (b"one", b"two")}
    known = files.filter(F.col("uri").endswith("b.pdf"))
    ledger = {r["copies"]: r for r in docs.dedupe_ledger(files, known, "uri").collect()}
    assert ledger[2]["kept_id"].endswith("a.pdf") and not ledger[2]["skipped"]
    assert ledger[1]["skipped"]


def test_append_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "1.0"), (2, "1.0"), (2, "1.0")], "id long, v string")
    for _ in range(2):
        docs.append_versioned(df, path, ["id", "v"], ["v"])
    docs.append_versioned(df.withColumn("v", F.lit("1.1")), path, ["id", "v"], ["v"])
    assert spark.read.parquet(path).count() == 4


SPANS = "array<struct<ord:int,block_type:int,text:string,bbox:array<double>>>"


def plan_pages(spark):
    def span(i, text):
        return (i, 0, text, [600.0, 20.0 * i + 10, 700.0, 20.0 * i + 20])

    texts = [["Project Address: 2008 DENNIS LANE, ST ROSA,", "A-1.1", "Sheet Title: Floor Plan", "Permit No: B25-2734"],
             ["Project Address: 1966 Dennis Ln, Santa Rosa", "A-1.2", "B25-2734"], ["x", "nothing"]]
    rows = [("d1", p + 1, 1000.0, 500.0, [span(i, s) for i, s in enumerate(ts)], "State of California", [], "2008 Dennis Ln, Santa Rosa, CA") for p, ts in enumerate(texts)]
    return spark.createDataFrame(rows, f"document_id string, page int, width double, height double, spans {SPANS}, full_text string, images array<struct<w:int,h:int>>, canonical_address string")


def test_title_blocks_text_only(spark):
    out = {r["page"]: r for r in extraction.extract_title_blocks(plan_pages(spark), None).collect()}
    assert out[1]["project_address"]["value"] == "2008 DENNIS LANE, ST ROSA,"
    assert out[1]["project_address"]["bbox"] == [600.0, 10.0, 700.0, 20.0]
    assert out[1]["permit_number"]["value"] == "B25-2734"
    assert not out[1]["address_mismatch"] and out[2]["address_mismatch"]
    assert out[1]["stamp_present"] and out[1]["source_track"] == "text"
    assert abs(out[1]["confidence"] - 0.7) < 1e-9
    assert out[3]["confidence"] == 0.0 and out[3]["bbox"] == [0.0, 0.0, 1000.0, 175.0]
    assert out[1]["sheet_id"] == "d1:p001"


def test_value_across_spans_keeps_lower_case_and_no_box(spark):
    spans = [(0, 0, "Scale:", [600.0, 0.0, 700.0, 10.0]), (1, 0, "ARCHITECT: Jo", [600.0, 20.0, 700.0, 30.0])]
    page = spark.createDataFrame([("d", 1, 1000.0, 500.0, spans, "", [], "x")], plan_pages(spark).schema)
    r = extraction.extract_title_blocks(page, None).first()
    assert r["designer_of_record"]["value"] == "Jo"
    assert r["scale_declared"]["value"] == "ARCHITECT: Jo"


def test_plan_set_ingest_twice_adds_nothing(spark, tmp_path):
    root = str(tmp_path / "lake")
    dims = [(1000.0, 500.0)] * 3
    documents = spark.createDataFrame([("d1", "h1", dims), ("d2", "h1", dims)], "document_id string, content_hash string, pages array<struct<width:double,height:double>>")
    log = spark.createDataFrame([("c1", 5)], "call_id string, tokens_in int")
    answers = spark.createDataFrame([("d1", 1, '{"project_address": {"value": "2008 Dennis Lane, St Rosa,"}}')], "document_id string, page int, response_json string")
    first = extraction.ingest_plan_set(documents, plan_pages(spark), answers, log, root).collect()
    assert [(r["kept_id"], r["copies"], r["skipped"]) for r in first] == [("d1", 2, False)]

    def counts():
        return {t: spark.read.parquet(f"{root}/{t}").count() for t in ("documents", "sheets", "entities", "call_log")}

    once = counts()
    assert once == {"documents": 1, "sheets": 3, "entities": 3, "call_log": 1}
    assert extraction.ingest_plan_set(documents, plan_pages(spark), answers, log, root).first()["skipped"]
    assert counts() == once
    payload = spark.read.parquet(f"{root}/entities").filter("page = 1").first()["payload"]
    assert json.loads(payload)["project_address"]["confidence"] == 0.95


def test_ensure_dim_keeps_existing_ids(spark):
    old = spark.createDataFrame([("B1", "x", "id-1")], "permit string, jurisdiction string, project_id string")
    new = spark.createDataFrame([("B1", "x"), ("B2", "x"), ("B2", "x")], "permit string, jurisdiction string")
    out = {r["permit"]: r["project_id"] for r in docs.ensure_dim(new, old, ["permit", "jurisdiction"], "project", "project_id").collect()}
    assert out["B1"] == "id-1" and len(out) == 2


def test_ensure_dim_takes_whole_rows(spark):
    new = spark.createDataFrame([("B2", "b", "1"), ("B2", "a", "2")], "permit string, owner string, phone string")
    old = spark.createDataFrame([], "permit string, owner string, phone string, project_id string")
    row = docs.ensure_dim(new, old, ["permit"], "project", "project_id").first()
    assert (row["owner"], row["phone"]) == ("a", "2")


def test_append_reports_errors_other_than_a_new_table(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "b", "x"), (1, "a", "y")], "id long, a string, b string")
    docs.append_versioned(df, path, ["id"])
    assert spark.read.parquet(path).collect() == [(1, "a", "y")]
    with pytest.raises(AnalysisException):
        docs.append_versioned(df.withColumnRenamed("id", "other"), path, ["other"])


def test_index_with_repeated_ids_and_positions_loses_nothing(spark):
    index = spark.createDataFrame(
        [("p", 1, "A-1", "one"), ("p", 2, "A-1", "two"), ("p", 3, "X", "x"), ("p", 3, "Y", "y")], "project_id string, ord long, declared_id string, declared_title string")
    sheets = spark.createDataFrame(
        [("p", 1, "s1", "A-1", "one"), ("p", 3, "s3", "Z", "z")], "project_id string, ord long, sheet_id string, canonical_id string, sheet_title string")
    got = sorted((r["declared_id"] or "", r["canonical_id"] or "", r["status"]) for r in integrity.reconcile_index(index, sheets).collect())
    assert len(got) == 4 and ("A-1", "A-1", "match") in got and ("A-1", "", "missing") in got
    assert [g[2] for g in got if g[0] in "XY"].count("mismatched_id") == 1 and [g[2] for g in got if g[0] in "XY"].count("missing") == 1


def test_a_row_of_two_sizes_agrees_with_both(spark):
    callouts = spark.createDataFrame([("p", "t", "2x10"), ("p", "t", "2x12"), ("p", "t", "4x4")], "project_id string, tag string, size string")
    rows = spark.createDataFrame([("p", "t", "2x10"), ("p", "t", "2x12")], "project_id string, tag string, size string")
    got = integrity.callouts_vs_schedule(callouts, rows, ["project_id", "tag"], "size").collect()
    assert [(r["callout_size"], r["severity"]) for r in got] == [("4x4", "revise")]


def test_questions_without_comparison_are_unknown(spark):
    q = spark.createDataFrame([(1, ">=", 5.0), (2, None, 5.0), (3, "=", 5.0), (4, "=", 6.0)], "k long, comparison string, threshold double").withColumn("min_confidence", F.lit(0.0))
    m = spark.createDataFrame([(i, v, 1.0) for i in range(1, 5) for v in (5.0, 5.0)], "k long, value double, confidence double")
    assert [r["status"] for r in review.checklist_answers(q, m, ["k"]).orderBy("k").collect()] == ["green", "unknown", "green", "red"]


def test_references_of_a_target_with_versions(spark):
    s = spark.createDataFrame([(1, "A", "a", "2020-01-01", ["B"]), (2, "B", "old", "2019-01-01", []), (3, "B", "new", "2021-01-01", [])],
                              "section_id long, canonical_id string, title string, effective_date string, cross_references array<string>")
    assert codekb.cross_references(s).collect() == [("A", "B", "new")]


def test_hot_section_goes_through_the_scan_once_a_day(spark):
    sections = spark.createDataFrame([(1, "S", "2020-01-01", None, "v1"), (2, "S", "2021-01-01", None, "v2")],
                                     "section_id long, canonical_id string, effective_date string, superseded_by_id long, body_text string").withColumn("effective_date", F.to_date("effective_date"))
    asked = spark.range(900).select("id", F.lit("S").alias("canonical_id"), F.date_add(F.lit("2020-12-30").cast("date"), (F.col("id") % 4).cast("int")).alias("as_of"))
    got = codekb.section_as_of(asked, sections)
    assert got.count() == 900
    assert {(str(r["as_of"]), r["section_id"]) for r in got.collect()} == {("2020-12-30", 1), ("2020-12-31", 1), ("2021-01-01", 2), ("2021-01-02", 2)}


def test_archive_and_retention(spark, tmp_path):
    p = spark.createDataFrame([(1, "a", "2015-03-01"), (2, "a", None), (3, "b", "2017-06-01")], "project_id long, jurisdiction string, closed_at string").withColumn("closed_at", F.to_date("closed_at"))
    index = docs.archive_cold(p, str(tmp_path / "cold"))
    assert index.count() == 2
    assert spark.read.parquet(str(tmp_path / "cold")).filter("jurisdiction = 'a' and year = 2015").count() == 1
    due = {r["project_id"]: r["stage"] for r in docs.retention_due(p, F.lit("2024-07-01").cast("date")).collect()}
    assert due == {1: "hard", 3: "soft"}


def test_packs_and_fixtures(spark, tmp_path):
    good = {"pack_id": "p", "jurisdiction": "j", "version": "1", "effective_date": "2025-01-01",
            "amendments": [{"base_section_id": "CBC-1", "operation": "append", "amendment_text": "x", "effective_date": "2025-01-01"}],
            "agency_policies": [{"title": "t", "source_url": "http://x", "applies_to_sections": ["CBC-1"]}],
            "submittal_checklists": [{"question": "q?", "citation": "c"}], "drafter_examples": [{"discipline": "d"}] * 20}
    bad = {**good, "pack_id": "q", "amendments": [{"operation": "drop"}]}
    (tmp_path / "a.json").write_text(json.dumps(good, indent=1))
    (tmp_path / "b.json").write_text(json.dumps(bad))
    valid, quarantine = packs.split_valid(packs.read_packs(spark, str(tmp_path)))
    assert [r["pack_id"] for r in valid.collect()] == ["p"]
    assert quarantine.first()["problems"] == ["bad operation"]
    assert packs.pack_amendments(valid).first()["ordinal"] == 0
    assert packs.pack_policies(valid).count() == packs.pack_checklists(valid).count() == 1
    assert packs.pack_readiness(valid, spark.createDataFrame([("CBC-1",)], "canonical_id string")).first()["ready"]
    assert not packs.pack_readiness(valid, spark.createDataFrame([("CBC-2",)], "canonical_id string")).first()["ready"]
    fixture = tmp_path / "fx"
    fixture.mkdir()
    (fixture / "expected-letter.parsed.json").write_text(json.dumps([{"project_id": "p", "comment_number": i} for i in range(58)]))
    (fixture / "expected-output.json").write_text(json.dumps([{"project_id": "p", "rule_id": "PI-ADDR-001"}]))
    comments, found = packs.read_fixture(spark, str(fixture))
    assert comments.count() == 58 and found.count() == 1
    (tmp_path / "list.jsonl").write_text(json.dumps({"checklist_id": "c", "question": "Is the door at least 32 in wide?", "citation": "x"}))
    assert packs.read_checklist(spark, str(tmp_path / "list.jsonl")).count() == 1


def test_letter_bundle_is_split_without_loss(spark, tmp_path):
    f = spark.createDataFrame([(1, "architectural" if i % 2 else "energy", i, "t") for i in range(25)], "project_id long, discipline string, sheet_id long, comment_text string")
    letter = review.number_letter(f, ["project_id"], ["sheet_id"], F.floor(F.col("sheet_id") / 4))
    assert [r["comment_number"] for r in letter.orderBy("comment_number").collect()] == list(range(1, 26))
    assert letter.orderBy("comment_number").first()["discipline"] == "architectural"
    bundle = review.letter_bundle(letter, ["project_id"], 10)
    review.write_letter_bundle(bundle, str(tmp_path / "out"))
    parts = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(n["comment_number"] for p in parts for n in p["findings"]) == list(range(1, 26))
    assert {p["part"] for p in parts} == {1, 2, 3} and parts[0]["round_typography"]["round_2"] == "bold"


def test_claim_example(spark):
    rows = [(1, "r_value_wall", "R-0", "e1", "plans", 0.9), (1, "r_value_wall", "R-19", "e2", "t24", 0.95), (1, "stories", "2", "e3", "plans", 0.9)]
    a = spark.createDataFrame(rows, "project_id long, claim_type string, value string, entity_id string, document_id string, confidence double")
    resolved = claims.resolve_claims(a)
    conflict = claims.claim_conflicts(a, resolved).collect()
    assert [(c["entity_id_a"], c["entity_id_b"], c["delta"]) for c in conflict] == [("e1", "e2", "R-0 <> R-19")]
    assert resolved.filter("claim_type = 'r_value_wall'").first()["resolved_value"] == "R-19"


def test_amendment_orders(spark):
    d = "2024-01-01"
    rows = [(1, "append", "A", 1), (2, "replace", "R", 2), (3, "insert_before", "B1", 3), (4, "insert_after", "C", 4), (5, "insert_before", "B2", 5)]
    am = spark.createDataFrame([(i, "s", "j", op, t, o, d, None) for i, op, t, o in rows],
                               "amendment_id long, canonical_id string, jurisdiction string, operation string, amendment_text string, ordinal long, effective_date string, closes_at string")
    am = am.withColumns({c: F.to_date(c) for c in ("effective_date", "closes_at")})
    q = spark.createDataFrame([("s", "j", "2025-01-01"), ("s", "j", "2023-06-01"), ("s", "j", "2019-01-01")], "canonical_id string, jurisdiction string, as_of string").withColumn("as_of", F.to_date("as_of"))
    s = spark.createDataFrame([(7, "s", "2020-01-01", None, "base")], "section_id long, canonical_id string, effective_date string, superseded_by_id long, body_text string").withColumn("effective_date", F.to_date("effective_date"))
    out = {str(r["as_of"]): r for r in codekb.lookup_sections(q, s, am).collect()}
    assert out["2025-01-01"]["applicable_text"] == "B2\nB1\nR\nC" and out["2025-01-01"]["unamended_text"] == "base"
    assert out["2023-06-01"]["applicable_text"] == "base" and out["2023-06-01"]["n_amendments"] == 0
    assert out["2019-01-01"]["applicable_text"] is None
    assert len(out) == 3


def test_superseded_section_is_closed(spark):
    s = spark.createDataFrame([(1, "a", "2020-01-01", 2, "x"), (2, "b", "2022-01-01", None, "y")], "section_id long, canonical_id string, effective_date string, superseded_by_id long, body_text string").withColumn("effective_date", F.to_date("effective_date"))
    q = spark.createDataFrame([("a", "2021-01-01"), ("a", "2022-01-01")], "canonical_id string, as_of string").withColumn("as_of", F.to_date("as_of"))
    got = {str(r["as_of"]): r["section_id"] for r in codekb.section_as_of(q, s).collect()}
    assert got == {"2021-01-01": 1, "2022-01-01": None}


def test_rule_examples(spark):
    w = spark.createDataFrame([(1, "A-1.2", "w1", "W-4", "Bedroom 2", "bedroom", True, 4.2, 0.88, 0.97), (1, "A-1.2", "w2", "W-5", "Bedroom 3", "bedroom", True, 6.0, 0.9, 0.97)],
                              "project_id long, sheet_id string, window_id string, tag string, room_label string, room_use string, is_new boolean, nco_sqft double, confidence double, section_confidence double")
    hit = rl.BOOK.run({"windows": w}).collect()
    assert [(h["rule_id"], h["evidence_id"], h["severity"], h["confidence"], h["requires_licensed_review"]) for h in hit] == [("ARCH-EGRESS-010", "w1", "revise", 0.88, False)]
    fl = spark.createDataFrame([(1, "A-1.2", 12.0, 60.0, 100.0, 250.0, 0.9), (1, "A-1.3", 30.0, 60.0, 100.0, 250.0, 0.9)],
                               "project_id long, sheet_id string, exit_distance_ft double, diagonal_ft double, travel_ft double, travel_limit_ft double, confidence double")
    assert [h["sheet_id"] for h in rl.BOOK.run({"floors": fl}).collect()] == ["A-1.2"]
    c = spark.createDataFrame([(1, "A-1.2", "b1", 16.0, 0.95), (1, "A-1.2", "b2", 18.0, 0.85)], "project_id long, sheet_id string, clearance_id string, side_clearance_in double, confidence double")
    hit = rl.BOOK.run({"clearances": c}).collect()
    assert [h["evidence_id"] for h in hit] == ["b1"] and not hit[0]["needs_attention"]
    callouts = spark.createDataFrame([(1, "SW-1", "a"), (1, "SW-2", "a"), (1, "SW-3", "a")], "project_id long, tag string, size string")
    gaps = rl.BOOK.run({"shear_callouts": callouts, "shear_schedule": callouts.filter("tag <> 'SW-3'")}).collect()
    assert [(h["rule_id"], h["evidence_id"], h["severity"]) for h in gaps] == [("STR-SHEAR-001", "SW-3", "provide")]
    merged = rl.run_rules({"windows": w, "clearances": c})
    assert merged.count() == 2 and set(findings.FINDING_COLUMNS) == set(merged.columns)


def test_every_rule_id_is_unique_and_named_rules_exist():
    from redliner.plans.integrity import BOOK as integrity

    ids = integrity.ids() + rl.BOOK.ids()
    assert len(ids) == len(set(ids))
    for rule in ["PI-TITLE-001", "PI-STAMP-001", "PI-SCALE-001", "PI-NORTH-001", "PI-SHEET-NUMBERING", "PI-CODECYCLE-001", "PI-ADDR-001", "PI-PERMIT-001",
                 "PI-DATE-001", "PI-TEXT-OVERLAP-001", "PI-REV-CLOUD-001", "PI-CROSSDOC-001", "ARCH-EGRESS-010", "ARCH-EGRESS-020", "ACC-BATH-030", "ACC-TURNING-005",
                 "STR-HOLDOWN-005", "MECH-OCCUPANCY-001", "ENERGY-PATH-001", "FIRE-SEP-001"]:
        assert rule in ids


def test_letter_parsing(spark):
    text = ["City letterhead", "ARCHITECTURAL", "1. Provide exits.", "See CBC §1007.1.1.", "2. Label doors.", "Structural:", "3. Add SW-3 per §R602.10."]
    lines = spark.createDataFrame([("L", i + 1, t, "italic") for i, t in enumerate(text)], "letter string, line_no int, line string, style string")
    got = sorted((r["comment_number"], r["discipline"], r["citation"], r["n_lines"]) for r in parsing.parse_review_letter(lines, "letter").collect())
    assert got == [(1, "architectural", "CBC-1007.1.1", 2), (2, "architectural", None, 1), (3, "structural", "CRC-R602.10", 1)]
    texts = {r["comment_seq"]: r["comment_text"] for r in parsing.letter_comment_texts(lines, "letter", 1).filter("part = 2").collect()}
    assert texts == {1: "See CBC §1007.1.1."}


def test_question_parsing(spark):
    q = 'Does every new bedroom have an egress window with at least 5.7 sqft net clear opening per CRC §R310.2.1?'
    r = spark.range(1).select(*[v.alias(k) for k, v in parsing.parse_question(F.lit(q)).items()]).first()
    assert (r["target"], r["only_new"], r["measure"], r["comparison"], r["threshold"], r["section"]) == ("bedroom", True, "net clear opening", ">=", 5.7, "CRC-R310.2.1")


def test_paragraphs_and_extractor_contract(spark):
    df = spark.createDataFrame([("d", "One\nline\n\n \nTwo\n\nThree")], "id string, text string")
    assert [r["body"] for r in parsing.split_paragraphs(df, "id", "text").orderBy("paragraph_no").collect()] == ["One\nline", "Two", "Three"]
    ex = findings.Extractor("paragraphs", "1.0.0", lambda d: parsing.split_paragraphs(d, "id", "text"), ("id", "body", "extractor_version"))
    assert ex(df).first()["extractor_version"] == "paragraphs:1.0.0"


def test_read_queries(spark):
    from redliner.plans import access

    sheets = spark.createDataFrame([(1, "d:p001", 1), (1, "d:p002", 2), (2, "e:p001", 1)], "project_id long, sheet_id string, page int")
    assert access.sheet_of_project(sheets, 1, "d:p002").count() == 1
    assert access.sheet_of_project(sheets, 2, "d:p002").count() == 0
    assert {r["project_id"]: r["first_sheet_id"] for r in access.first_sheet(sheets, ["project_id"]).collect()} == {1: "d:p001", 2: "e:p001"}
    entities = spark.createDataFrame([("d:p001", "e1", "title_block", "{}", "2025-01-02", 0.7), ("d:p001", "e2", "title_block", "{}", "2025-01-01", 0.7)],
                                     "sheet_id string, entity_id string, type string, payload string, created_at string, confidence double")
    assert {r["sheet_id"]: r["entity_id"] for r in access.with_title_block(sheets, entities).collect()} == {"d:p001": "e1", "d:p002": None, "e:p001": None}
    assert codekb.get_table(spark.createDataFrame([("CBC-TBL-508.4",), ("CBC-508.4",)], "canonical_id string"), "CBC-TBL-508.4").count() == 1


def test_gate_of_a_project_without_sheets_is_unchecked(spark):
    from redliner.plans import access

    projects = spark.createDataFrame([(1,), (2,)], "project_id long")
    sheets = spark.createDataFrame([(1, i) for i in range(19)], "project_id long, page int")
    blocks = spark.createDataFrame([(1, "1966 Dennis Ln" if i == 3 else "2008 DENNIS LANE", i == 3) for i in range(19)], "project_id long, address string, address_mismatch boolean")
    got = {(r["project_id"], r["check"]): r["verdict"] for r in access.ingest_gate(blocks, sheets, projects).collect()}
    assert [got[1, c] for c in ("sheets", "addresses", "mismatches")] == ["PASS"] * 3
    assert [got[2, c] for c in ("sheets", "addresses", "mismatches")] == ["UNCHECKED"] * 3


def test_licensed_audit_and_citation_fidelity(spark):
    from redliner.plans import ops

    f = spark.createDataFrame([("STR-SHEAR-ADEQUACY", True), ("STR-SHEAR-ADEQUACY", False), ("PI-ADDR-001", False), ("FIRE-SEP-001", True)], "rule_id string, requires_licensed_review boolean")
    assert ops.licensed_flag_audit(f).count() == 2
    c = spark.createDataFrame([("a", "text"), ("b", "paraphrase"), ("z", "unknown")], "canonical_id string, frozen_text string")
    stored = spark.createDataFrame([("a", "text"), ("b", "text")], "canonical_id string, applicable_text string")
    assert {r["canonical_id"] for r in ops.citation_fidelity(c, stored, ["canonical_id"]).collect()} == {"b", "z"}


def test_durable_writes_below_the_named_folder(spark):
    from redliner.session import durable, durable_folder

    named = spark.conf.get("spark.checkpoint.dir", None)
    folder = durable_folder(spark)
    assert folder == named or (named is None and folder == spark.sparkContext.getCheckpointDir())
    kept = durable(spark.range(5))
    assert kept.count() == 5 and all(f.replace("file:", "").lstrip("/").startswith(folder.replace("file:", "").lstrip("/")) for f in kept.inputFiles())


def test_durable_tables_are_removed_at_the_end_of_a_job(spark):
    from redliner.session import durable, remove_durables

    remove_durables(spark)
    kept = durable(spark.range(5))
    assert kept.count() == 5 and remove_durables(spark) == 1
    with pytest.raises(Exception):
        spark.read.parquet(kept.inputFiles()[0]).count()
