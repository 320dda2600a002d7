"""Worked examples of the column expressions."""

import datetime

import pytest
from pyspark.sql import functions as F

from redliner.functions import codes, review, text, titleblock
from redliner.functions import geometry as g

HOME = "2008 Dennis Ln, Santa Rosa, CA"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("found, differs", [
    ("2008 DENNIS LANE, ST ROSA,", False),
    ("2008 Dennis Lane, Santa Rosa, CA 95403", False),
    ("2008 Bonita Lane, Santa Rosa, CA", True),
    ("1966 Dennis Ln, Santa Rosa, CA", True),
    ("2080 Dennis Lane, Santa Rosa, CA", True),
    ("", False),
    (None, False),
])
def test_address_differs(spark, found, differs):
    assert value(spark, text.address_differs(F.lit(found).cast("string"), F.lit(HOME))) is differs


def test_address_without_house_number_uses_word_overlap(spark):
    official = "Dennis Lane Santa Rosa"
    assert value(spark, text.address_differs(F.lit("dennis ln santa rosa"), F.lit(official))) is False
    assert value(spark, text.address_differs(F.lit("Oak Street Modesto"), F.lit(official))) is True


def test_address_key(spark):
    assert value(spark, text.house_number(F.lit(HOME))) == "2008"
    assert value(spark, text.street_name(F.lit(HOME))) == "dennis"
    assert value(spark, text.house_number(F.lit("12 Oak St"))) is None
    assert value(spark, text.street_words(F.lit("2008 Lane"))) is None


@pytest.mark.parametrize("a, b, score", [("", "", 1.0), ("a", "", 0.0), ("A b", "b a", 1.0), ("a, b", "a b", 1 / 3)])
def test_jaccard(spark, a, b, score):
    assert value(spark, text.token_jaccard(F.lit(a), F.lit(b))) == pytest.approx(score)


@pytest.mark.parametrize("raw, canonical", [
    ("§1017.2", "CBC-1017.2"), ("Table 508.4", "CBC-TBL-508.4"), ("§11B-404.2.3", "CBC-11B-404.2.3"), ("R310.2.1", "CRC-R310.2.1"),
    ("§150.0(f)", "CEnC-150.0-f"), ("CMC §505.2", "CMC-505.2"), ("HSC §13131.5", "HSC-13131.5"), ("see plans", None),
    ("CalGreen §4.408", "CalGreen-4.408"), ("Table 716.1(2)", "CBC-TBL-716.1-2"), ("NFPA 13R", "NFPA-13R"),
])
def test_citation(spark, raw, canonical):
    assert value(spark, codes.canonical_citation(F.lit(raw))) == canonical


def test_citation_takes_the_book_of_the_discipline(spark):
    assert value(spark, codes.canonical_citation(F.lit("§505.2"), F.lit("mechanical"))) == "CMC-505.2"
    assert value(spark, codes.display_citation(F.lit("CRC-R310.2.1"))) == "CRC §R310.2.1"
    assert value(spark, codes.display_citation(F.lit("CBC-TBL-508.4"))) == "CBC Table 508.4"


@pytest.mark.parametrize("raw, inches", [
    ("24'-6\"", 294.0), ("24'-6 1/2\"", 294.5), ("24' 6\"", 294.0), ("24ft-6in", 294.0), ("24.5'", 294.0), ('5/8"', 0.625), ("3'-7 3/4\"", 43.75),
    ("NTS", None),
])
def test_dimension(spark, raw, inches):
    assert value(spark, g.parse_dimension(F.lit(raw))) == inches


def test_scale(spark):
    assert value(spark, g.parse_scale(F.lit("1/4\" = 1'-0\""))) == 48.0
    assert value(spark, g.parse_scale(F.lit("3/16\" = 1'-0\""))) == 64.0
    assert value(spark, g.parse_scale(F.lit("NTS"))) is None


def test_polygon(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in [(0, 0), (4, 0), (4, 3), (0, 3)]])
    assert value(spark, g.polygon_area(ring)) == 12.0
    assert value(spark, g.polygon_diagonal(ring)) == 5.0


def test_confidence_is_capped_and_floored(spark):
    assert value(spark, g.composed_confidence(F.array(F.lit(1.0), F.lit(1.0)))) == 0.99
    assert value(spark, g.composed_confidence(F.array(F.lit(0.2), F.lit(0.5)))) == 0.30
    assert value(spark, g.composed_confidence(F.array(F.lit(0.9), F.lit(0.9)))) == pytest.approx(0.81)


def test_licensed_flag_is_membership(spark):
    ids = spark.createDataFrame([(r,) for r in [*review.CRITICAL_PATH_RULES, "FIRE-SEP-001", None]], "rule_id string")
    flags = [r["f"] for r in ids.select(review.needs_license(F.col("rule_id")).alias("f")).collect()]
    assert flags == [True] * 11 + [False, False]


@pytest.mark.parametrize("raw, canonical", [("A-1.1", "A-1.1"), ("a1.2", "A-1.2"), ("S2", "S-2"), ("X-1.0", None), ("", None)])
def test_sheet_id(spark, raw, canonical):
    assert value(spark, review.canonical_sheet(F.lit(raw))) == canonical


@pytest.mark.parametrize("raw", ["03/15/2025", "3-15-2025", "3.15.25", "March 15, 2025", "mar 15 2025"])
def test_dates(spark, raw):
    assert value(spark, review.parse_date(F.lit(raw))) == datetime.date(2025, 3, 15)


def test_badges(spark):
    assert value(spark, review.confidence_color(F.lit(0.9))) == "green"
    assert value(spark, review.confidence_color(F.lit(0.6))) == "yellow"
    assert value(spark, review.confidence_percent(F.lit(0.955))) == 96
    assert value(spark, review.typography(F.lit(2))) == "underlined"
    assert value(spark, review.round_from_typography(F.lit("bold"))) == 2
    assert value(spark, review.designer_severity(F.lit("clarify"))) == "recommend"


def _field(v, bbox=(1.0, 2.0, 3.0, 4.0), conf=0.7, track="text"):
    return titleblock.field(F.lit(v).cast("string"), g.box(*bbox), F.lit(conf), F.lit(track))


@pytest.mark.parametrize("t, v, conf, track, shown", [
    ("a b c", "A B C", 0.95, "merged", "a b c"), ("a b", "x y", 0.40, "merged", "a b"), ("a", None, 0.70, "text", "a"),
    (None, "b", 0.70, "vision", "b"), (None, None, 0.0, "text", None), ("", "b", 0.70, "vision", "b"),
])
def test_merge(spark, t, v, conf, track, shown):
    m = value(spark, titleblock.merged_field(_field(t), _field(v, (9.0, 9.0, 9.0, 9.0), 0.85, "vision")))
    assert (m["confidence"], m["source_track"], m["value"]) == (conf, track, shown)
    assert (m["text_raw"] is not None) == (track == "merged")


def test_merge_takes_the_vision_box_when_text_has_none(spark):
    m = value(spark, titleblock.merged_field(_field("a", (0.0, 0.0, 0.0, 0.0)), _field("a", (9.0, 9.0, 9.0, 9.0), 0.85, "vision")))
    assert m["bbox"] == [9.0, 9.0, 9.0, 9.0]


@pytest.mark.parametrize("name, low, out", [
    ("permit_number", "permit no: b25-2734", "b25-2734"),
    ("permit_number", "permit no. b25-2734", "no"),
    ("permit_number", "ref b25-2734", "b25-2734"),
    ("sheet_identifier_raw", "sheet a1.2", "a1.2"),
    ("scale_declared", "scale: 1/4\" = 1'-0\"\nnext", "1/4\" = 1'-0\""),
    ("date_issued", "date: 03/15/2025", "03/15/2025"),
    ("project_address", "site\n2008 dennis lane, santa rosa", "2008 dennis lane, santa rosa"),
    ("project_name", "nothing here", None),
    ("apn", "apn:\n022-211-012", "022-211-012"),
    ("project_name", "project: café lane", "café lane"),
])
def test_labels(spark, name, low, out):
    assert value(spark, titleblock.label_value(F.lit(low), name)) == out


def test_clip_of_square_page_is_the_bottom(spark):
    assert value(spark, titleblock.clip_rect(F.lit(100.0), F.lit(100.0))) == [0.0, 65.0, 100.0, 100.0]
    assert value(spark, titleblock.clip_rect(F.lit(200.0), F.lit(100.0))) == [120.0, 0.0, 200.0, 100.0]


def test_rotated_box_goes_back_to_points(spark):
    b = value(spark, titleblock.frac_to_points(g.box(0.1, 0.2, 0.3, 0.4), F.lit(1000.0), F.lit(500.0)))
    assert b == pytest.approx([840.0, 350.0, 880.0, 450.0])


@pytest.mark.parametrize("answer, name", [
    ('{"apn": {"value": "1-2", "bbox_frac": [0, 0, 1, 1]}}', "1-2"), ('```json\n{"apn": {"value": " 1-2 "}}\n```', " 1-2 "), ("not json", None), ("[1]", None),
])
def test_recorded_answers(spark, answer, name):
    out = value(spark, titleblock.parse_response(F.lit(answer)))
    assert (out["apn"]["value"] if out else None) == name


def test_stamp(spark):
    none = F.array().cast("array<struct<w:int,h:int>>")
    assert value(spark, titleblock.stamp_present(F.lit("LICENSED\nARCHITECT"), none)) is True
    assert value(spark, titleblock.stamp_present(F.lit("x"), none)) is False
    seal = F.array(F.struct(F.lit(100).alias("w"), F.lit(110).alias("h")))
    assert value(spark, titleblock.stamp_present(F.lit("x"), seal)) is True


def test_citations_found_and_resolved_in_steps_are_the_same(spark):
    import re

    from redliner.functions import codes
    from redliner.sources.parsing import code_notes

    notes = ["CBC § 1007.1.1, CRC§R310.2.1(a)(2); HSC  §13131.5 Table 508.4 table 3 CBC Table 5", "§11B-604.2(B) §150.0(f) CalGreen §4.408 CEnC §150.1(c)", "none", "", "C H T § CBC CBC §1", None, "§ 9 §\n11.2 Tables Table  7.1.2.", "§150.0(f)(2)(z9)"]
    df = spark.createDataFrame(list(enumerate(notes)), "i int, note string")
    got = code_notes(df, "i", "note")
    # no value is bound inside one interpreted expression
    assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()
    rows = sorted(map(tuple, got.collect()))
    assert [(i, n, c) for i, n, c, _ in rows] == [(i, k + 1, c) for i, t in enumerate(notes) for k, c in enumerate(re.findall(codes.CITATION, t or ""))]
    whole = got.select("i", "citation_no", codes.canonical_citation(F.col("citation")).alias("x")).collect()
    assert sorted(map(tuple, whole)) == [(i, n, x) for i, n, _, x in rows] and (7, 1, "§150.0(f)(2)(z9)", "CEnC-150.0-f-2-z9") in rows
