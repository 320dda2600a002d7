"""Title-block fields from positioned text and recorded vision answers."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from redliner.functions.geometry import box, is_zero_box, zero_box
from redliner.functions.text import let, none_if_empty, strip, token_jaccard, truthy

VERSION = "1.4.0"

# Label patterns per field, tried in order on lower-cased text.
LABEL_PATTERNS = {
    "project_name": [
        r"project\s*(?:name)?[:\s]+(.+)",
        r"project\s*title[:\s]+(.+)",
    ],
    "project_address": [
        r"(?:project\s*)?address[:\s]+([^\n]+)",
        r"site\s*address[:\s]+([^\n]+)",
        r"(\d+\s+\w[\w\s]{1,30}?\b(?:ln|lane|street|avenue|blvd|boulevard|road|drive|way|court|place)\b[^\n]{0,40})",
    ],
    "apn": [
        r"apn[:\s#]+([0-9\-]+)",
        r"assessor[\'s]*\s*parcel\s*(?:number)?[:\s]+([0-9\-]+)",
        r"parcel\s*(?:no|number|#)[:\s]+([0-9\-]+)",
    ],
    "permit_number": [
        r"permit\s*(?:no|number|#)?[:\s]+([A-Z0-9\-]+)",
        r"(?:bldg|building)\s*permit[:\s]+([A-Z0-9\-]+)",
        r"(B\d{2}-\d{4})",
    ],
    "sheet_identifier_raw": [
        r"\b([A-Z]-\d+\.\d+)\b",
        r"\b([A-Z]\d+\.\d+)\b",
        r"\bsheet\s*(?:no|number|#)?[:\s]+([A-Z0-9\.\-]+)",
    ],
    "sheet_title": [
        r"(?:sheet\s*title|drawing\s*title)[:\s]+(.+)",
    ],
    "designer_of_record": [
        r"(?:architect|designer|drawn\s*by|prepared\s*by)[:\s]+(.+)",
        r"(?:licensed\s*architect|architect\s*of\s*record)[:\s]+(.+)",
    ],
    "date_issued": [
        r"(?:date|issued|issue\s*date)[:\s]+(\d{1,2}[\/\-\.]\d{1,2}[\/\-\.]\d{2,4})",
        r"(?:date|issued)[:\s]+(\w+\s+\d{1,2},?\s+\d{4})",
    ],
    "scale_declared": [
        r"scale[:\s]+(.+?)(?:\s{2,}|\n|$)",
        r'(1[\/\"]?\s*[=:]\s*[\d\'"]+(?:\s*[-\'\"]\s*0[\'\""]?)?)',
    ],
}
# Words of which a text must hold one, of each pattern above, to be searched by it.
LABEL_WORDS = {
    "project_name": [["project"], ["project"]],
    "project_address": [["address"], ["address"], []],
    "apn": [["apn"], ["parcel"], ["parcel"]],
    "permit_number": [["permit"], ["permit"], []],
    "sheet_identifier_raw": [[], [], ["sheet"]],
    "sheet_title": [["title"]],
    "designer_of_record": [["architect", "designer", "drawn", "prepared"], ["architect"]],
    "date_issued": [["date", "issue"], ["date", "issue"]],
    "scale_declared": [["scale"], []],
}
STAMP_WORDS = r"licensed\s+architect|state\s+of\s+california"
FIELDS = list(LABEL_PATTERNS)
SCORED_FIELDS = FIELDS[:6]

# Confidences of the tracks and of their merge, and the agreement threshold.
TEXT_CONFIDENCE = 0.70
VISION_CONFIDENCE = 0.85
AGREE_CONFIDENCE = 0.95
DISAGREE_CONFIDENCE = 0.40
SINGLE_CONFIDENCE = 0.70
AGREE_JACCARD = 0.7

# i: any case, m: ^ and $ at line ends, U: Unicode classes, d: only \n ends a line.
FLAGS = "(?imUd)"
FIELD_TYPE = (
    "struct<value:string,bbox:array<double>,confidence:double,source_track:string,text_raw:string,vision_raw:string>"
)
RESPONSE_TYPE = "struct<" + ",".join(f"{f}:struct<value:string,bbox_frac:array<double>>" for f in FIELDS) + ">"


def field(value: Column, bbox: Column, conf: Column, track: Column, text_raw=None, vision_raw=None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        value.alias("value"), bbox.alias("bbox"), conf.cast("double").alias("confidence"), track.alias("source_track"),
        (none if text_raw is None else text_raw).alias("text_raw"),
        (none if vision_raw is None else vision_raw).alias("vision_raw"),
    )


def empty_field(track: str = "text") -> Column:
    return field(F.lit(None).cast("string"), zero_box(), F.lit(0.0), F.lit(track))


def clip_rect(w: Column, h: Column) -> Column:
    """Region searched for text: right 40% of landscape sheets, bottom 35% of the others."""
    return F.when(w > h, box(w * 0.60, F.lit(0.0), w, h)).otherwise(box(F.lit(0.0), h * 0.65, w, h))


def crop_rect(w: Column, h: Column) -> Column:
    """Region read by the vision track: right 20% of landscape sheets (rotated), bottom 35% of the others."""
    return F.when(w > h, box(w * 0.80, F.lit(0.0), w, h)).otherwise(box(F.lit(0.0), h * 0.65, w, h))


def spans_in_clip(spans: Column, w: Column, h: Column) -> Column:
    """Text spans inside the clip in reading order, stripped, at least two characters long."""
    def inside(s: Column, clip: Column) -> Column:
        b = s["bbox"]
        return (b[0] >= clip[0]) & (b[1] >= clip[1]) & (b[2] <= clip[2]) & (b[3] <= clip[3])

    kept = let(clip_rect(w, h), lambda clip: F.filter(spans, lambda s: (s["block_type"] == 0) & inside(s, clip)))
    bare = F.transform(kept, lambda s: F.struct(s["ord"].alias("ord"), strip(s["text"]).alias("text"), s["bbox"].alias("bbox")))
    ordered = F.sort_array(F.filter(bare, lambda s: F.length(s["text"]) >= 2))
    return F.transform(ordered, lambda s: F.struct(s["text"].alias("text"), F.lower(s["text"]).alias("low"), s["bbox"].alias("bbox")))


def joined_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: s["low"]), "\n")


def label_value(text: Column, name: str) -> Column:
    """Group 1 of the first pattern that matches, stripped; null when none does."""
    def tried(pattern: str, words: list[str]) -> Column:
        found = let(F.regexp_extract(text, FLAGS + pattern, 1), none_if_empty)
        # a pattern without case takes two more letters for s and i
        return F.when(reduce(or_, [F.contains(text, F.lit(w)) for w in [*words, "\u017f", "\u0131"]]), found) if words else found

    return strip(F.coalesce(*[tried(p, words) for p, words in zip(LABEL_PATTERNS[name], LABEL_WORDS[name], strict=True)]))


def home_span(low_value: Column, spans: Column) -> Column:
    """First span that contains a matched value."""
    return F.when(low_value.isNotNull(), F.get(F.filter(spans, lambda s: F.contains(s["low"], low_value)), F.lit(0)))


def spelled(low_value: Column, home: Column) -> Column:
    """A matched value in the spelling of its span."""
    return F.coalesce(strip(F.substring(home["text"], F.position(low_value, home["low"]), F.length(low_value))), low_value)


def text_field(value: Column, home: Column) -> Column:
    """Field of a spelled value, with the box of its span."""
    conf = F.when(truthy(value), F.lit(TEXT_CONFIDENCE)).otherwise(F.lit(0.0))
    found = field(value, F.coalesce(home["bbox"], zero_box()), conf, F.lit("text"))
    return F.when(value.isNull(), empty_field()).otherwise(found)


def frac_to_points(frac: Column, w: Column, h: Column) -> Column:
    """Box in fractions of the (rotated) crop to a box in page points."""
    crop = crop_rect(w, h)
    cw, ch = crop[2] - crop[0], crop[3] - crop[1]
    turned = box(
        crop[0] + frac[1] * cw, crop[1] + (1.0 - frac[2]) * ch, crop[0] + frac[3] * cw, crop[1] + (1.0 - frac[0]) * ch
    )
    straight = box(crop[0] + frac[0] * cw, crop[1] + frac[1] * ch, crop[0] + frac[2] * cw, crop[1] + frac[3] * ch)
    return F.when(w > h, turned).otherwise(straight)


def parse_response(answer: Column) -> Column:
    """Recorded vision answer to a struct; code fences are removed, unreadable answers give null."""
    def unfenced(text: Column) -> Column:
        return F.when(text.contains("```"), F.regexp_replace(text, r"^```(?:json)?\s*|\s*```$", "")).otherwise(text)

    def read(bare: Column) -> Column:
        return F.when(bare.startswith("{") & F.try_parse_json(bare).isNotNull(), F.from_json(bare, RESPONSE_TYPE))

    return F.when(answer.isNotNull(), let(let(strip(answer), unfenced), read))


def vision_field(raw: Column, w: Column, h: Column) -> Column:
    """Field of a vision answer: a struct of value and bbox_frac, or null."""
    four = F.coalesce(F.size(raw["bbox_frac"]) == 4, F.lit(False))
    frac = F.when(four, raw["bbox_frac"]).otherwise(zero_box())
    found = field(strip(raw["value"]), frac_to_points(frac, w, h), F.lit(VISION_CONFIDENCE), F.lit("vision"))
    return F.when(truthy(raw["value"]), found).otherwise(empty_field("vision"))


def merged_field(text: Column, vision: Column) -> Column:
    """Agreement 0.95, disagreement 0.40 with the text value, one track 0.70, none empty."""
    tv, vv = text["value"], vision["value"]
    has_text, has_vision = F.coalesce(truthy(tv), F.lit(False)), F.coalesce(truthy(vv), F.lit(False))
    place = F.when(is_zero_box(text["bbox"]), vision["bbox"]).otherwise(text["bbox"])
    score = F.when(token_jaccard(tv, vv) >= AGREE_JACCARD, F.lit(AGREE_CONFIDENCE)).otherwise(F.lit(DISAGREE_CONFIDENCE))
    return (
        F.when(has_text & has_vision, field(tv, place, score, F.lit("merged"), tv, vv))
        .when(has_text, field(tv, text["bbox"], F.lit(SINGLE_CONFIDENCE), F.lit("text")))
        .when(has_vision, field(vv, vision["bbox"], F.lit(SINGLE_CONFIDENCE), F.lit("vision")))
        .otherwise(empty_field())
    )


def stamp_present(full_text: Column, images: Column) -> Column:
    """A stamp-sized, nearly square image or the words of a stamp."""
    seal = F.exists(images, lambda i: (F.abs(i["w"] - i["h"]) < 20) & (i["w"] > 50) & (i["w"] < 300))
    return F.coalesce(seal, F.lit(False)) | F.coalesce(full_text.rlike("(?iU)" + STAMP_WORDS), F.lit(False))
