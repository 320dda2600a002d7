"""Whole finding records: rounds, measures, frozen text in parts, sections not in force, awkward rows."""

from datetime import date

from redliner.plans import provenance


def context(spark):
    d = date
    return {
        "rooms": spark.createDataFrame(
            [(1, 10, "Bedroom 1", "bedroom", True), (2, 10, "Bedroom 2", "bedroom", False), (3, 10, "Kitchen", "kitchen", True), (4, 20, "Bedroom 4", "bedroom", True),
             (5, None, "Bedroom 5", "bedroom", True)],
            "room_id long, project_id long, room_label string, room_use string, is_new boolean"),
        "windows": spark.createDataFrame(
            [("w1", 1, "s1", "W-1", [0.0, 0.0, 1.0, 1.0], "windows:1"), ("w2", 2, "s1", "W-1", None, "windows:1"), ("w3", 3, "s1", "W-1", None, "windows:1"),
             ("w4", 4, "s2", "W-1", None, "windows:1"), ("w5", 1, "s1", "W-9", None, "windows:1"), ("w6", 1, "s1", "W-2", None, "windows:1"), ("w7", 5, "s1", "W-1", None, "windows:1"),
             ("w8", None, None, None, None, None)],
            "window_id string, room_id long, sheet_id string, tag string, bbox array<double>, extractor_version string"),
        "specs": spark.createDataFrame(
            [("m2", "s1", "W-1", 4.0, 0.9, ["t"], "specs:1"), ("m1", "s1", "W-1", 5.0, 0.9, ["u"], "windows:1"), ("m3", "s1", "W-1", 9.0, 0.5, None, "specs:1"),
             ("m0", "s1", "W-1", 8.0, None, None, "specs:1"), ("m4", "s2", "W-1", 2.0, 0.99, None, "specs:1"), ("m5", "s1", "W-2", 5.7, 1.0, None, "specs:1")],
            "measurement_id string, sheet_id string, tag string, nco_sqft double, confidence double, trace array<string>, extractor_version string"),
        "submittals": spark.createDataFrame(
            [(10, 100, 1, 7, "x", d(2020, 1, 1), d(2020, 1, 1)), (10, 101, 2, 7, "x", d(2021, 6, 1), d(2021, 6, 1)), (10, 99, 2, 7, "x", d(2022, 6, 1), d(2022, 6, 1)),
             (20, 200, 1, 7, "x", d(2010, 1, 1), d(2010, 1, 1))],
            "project_id long, submittal_id long, review_round int, canonical_id long, jurisdiction string, as_of date, created_at date"),
        "sections": spark.createDataFrame(
            [(70, 7, d(2019, 1, 1), None, "old", 0.8), (71, 7, d(2021, 1, 1), None, "new", 0.7), (72, 7, d(2022, 1, 1), None, "later", 0.7)],
            "section_id long, canonical_id long, effective_date date, superseded_by_id long, body_text string, confidence double"),
        "amendments": spark.createDataFrame(
            [(900, 7, "x", "append", "tail", 2, d(2021, 2, 1), None), (901, 7, "x", "insert_before", "head", 1, d(2021, 2, 1), None), (902, 7, "x", "append", "gone", 3, d(2021, 2, 1), d(2021, 3, 1)),
             (903, 7, "y", "append", "elsewhere", 4, d(2021, 2, 1), None)],
            "amendment_id long, canonical_id long, jurisdiction string, operation string, amendment_text string, ordinal int, effective_date date, closes_at date"),
    }


def test_records_of_the_egress_rule(spark):
    rows = {r["evidence"][0]["entity_id"]: r for r in provenance.egress_findings(context(spark)).collect()}
    assert rows.keys() == {"w1", "w4"}
    one, four = rows["w1"], rows["w4"]
    assert (one["submittal_id"], one["review_round"], one["sheet_reference"]["sheet_id"], one["part"]) == (101, 2, "s1", 1)
    assert one["evidence"][0]["bbox"] == [0, 0, 1, 1] and one["evidence"][1].asDict() == {
        "entity_id": None, "bbox": None, "raster_crop_uri": None, "measurement_id": "m1", "value": 5.0, "unit": "sqft", "confidence": 0.9, "trace": ["u"]}
    cited = one["citations"][0]
    assert (cited["code"], cited["section"], cited["jurisdiction"], cited["effective_date"], cited["frozen_text"]) == ("CRC", "R310.2.1", "x", date(2021, 1, 1), "head\nnew\ntail")
    assert cited["amendments_applied"] == ["901", "900"]
    assert [tuple(s) for s in cited["retrieval_chain"]] == [("state_section", "71"), ("amendment", "901"), ("amendment", "900")]
    assert one["confidence"] == 0.7 and one["extractor_versions_used"] == ["windows:1"] and "NCO of 5.0 sqft" in one["draft_comment_text"]
    # no section was in force for the other project: kept, uncited, to be looked at
    assert four["citations"] == [] and four["part"] == 1 and four["confidence"] == 0.99 and four["needs_attention"]
    assert four["extractor_versions_used"] == ["specs:1", "windows:1"]


def test_long_texts_go_on_in_parts(spark):
    c = context(spark)
    keys = c["submittals"].filter("submittal_id = 101")
    rows = provenance.frozen_citations(keys, c["sections"].drop("confidence"), c["amendments"], "CRC", "R310.2.1", per_part=2).orderBy("part").collect()
    assert [(r["part"], r["cited"]["frozen_text"], r["cited"]["amendments_applied"], r["section_confidence"]) for r in rows] == [
        (1, "head\nnew", ["901"], 1.0), (2, "tail", ["900"], 1.0)]


def test_empty_tables(spark):
    c = context(spark)
    for name in ("rooms", "specs", "submittals"):
        assert provenance.egress_findings({**c, name: c[name].limit(0)}).collect() == []
    for name in ("sections", "amendments"):
        assert {r["evidence"][0]["entity_id"] for r in provenance.egress_findings({**c, name: c[name].limit(0)}).collect()} == {"w1", "w4"}
