"""Labels, flags and vocabularies of the review domain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rules whose findings always need a licensed reviewer.
CRITICAL_PATH_RULES = [
    "STR-SHEAR-ADEQUACY",
    "STR-HOLDOWN-CAPACITY",
    "STR-FRAMING-SIZING-ADEQUACY",
    "STR-FOUNDATION-ADEQUACY",
    "ARCH-OCCUPANT-LOAD-CALC",
    "ARCH-EGRESS-CAPACITY-HIGH-LOAD",
    "FIRE-SEP-RATING-ADEQUACY",
    "FIRE-R21-TYPE-V-ONE-HOUR",
    "FIRE-OPENING-PROTECTIVE-ADEQUACY",
    "ELEC-SERVICE-SIZE-ADEQUACY",
    "MECH-LOAD-CALC-ADEQUACY",
]

# Letter order of the disciplines, plan integrity first.
DISCIPLINE_ORDER = [
    "plan_integrity",
    "architectural",
    "accessibility",
    "energy",
    "electrical",
    "mechanical",
    "plumbing",
    "structural",
    "fire_life_safety",
    "calgreen",
]
SEVERITIES = ["revise", "provide", "clarify", "reference_only"]
DESIGNER_SEVERITY = {
    "revise": "attention",
    "provide": "recommend",
    "clarify": "recommend",
    "reference_only": "optional",
}
TYPOGRAPHY = ["italic", "bold", "underlined"]

# Minimum confidence by measurement type and by discipline.
MIN_CONFIDENCE = {
    "door_clear_width": 0.90,
    "accessible_route_width": 0.90,
    "turning_space_diameter": 0.90,
    "window_nco": 0.85,
    "room_area": 0.80,
    "area": 0.80,
    "egress_travel_distance": 0.75,
}
DISCIPLINE_CONFIDENCE = {"accessibility": 0.90, "architectural": 0.80}

# Model names per role.
MODEL_ROLES = {
    "primary": "claude-sonnet-4-5",
    "escalation": "claude-opus-4-5",
    "classifier": "claude-haiku-4-5-20251001",
}
ESCALATE_BELOW = 0.70

# Sheet type keywords, first hit wins.
SHEET_TYPES = [
    ("site_plan", "site plan|plot plan"),
    ("floor_plan", "floor plan|framing plan|foundation plan|roof plan"),
    ("elevation", "elevation"),
    ("section", "section"),
    ("schedule", "schedule"),
    ("details", "detail"),
    ("code_notes", "code|general notes|notes"),
    ("cover", "cover|title sheet|sheet index"),
]


def lookup(table: dict, key: Column, default=None) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    hit = F.try_element_at(F.create_map(*pairs), key)
    return hit if default is None else F.coalesce(hit, F.lit(default))


def needs_license(rule_id: Column) -> Column:
    """True for the critical-path rules and for no other rule."""
    return F.coalesce(rule_id.isin(CRITICAL_PATH_RULES), F.lit(False))


def may_auto_approve(licensed: Column) -> Column:
    return ~licensed


def confidence_color(conf: Column) -> Column:
    return F.when(conf >= 0.9, "green").when(conf >= 0.6, "yellow").otherwise("red")


def confidence_percent(conf: Column) -> Column:
    return F.floor(conf * 100 + 0.5).cast("int")


def tracks_disagree(track: Column, text_raw: Column, vision_raw: Column, conf: Column) -> Column:
    """Merged field whose two raw readings differ and whose confidence is low."""
    hit = (
        (track == "merged")
        & (text_raw != "")
        & (vision_raw != "")
        & (text_raw != vision_raw)
        & (conf < 0.6)
    )
    return F.coalesce(hit, F.lit(False))


def needs_attention(conf: Column, kind: Column, default: float = 0.0) -> Column:
    return conf < lookup(MIN_CONFIDENCE, kind, default)


def discipline_rank(discipline: Column) -> Column:
    return F.coalesce(
        F.nullif(F.array_position(F.array(*[F.lit(d) for d in DISCIPLINE_ORDER]), discipline), F.lit(0)),
        F.lit(len(DISCIPLINE_ORDER) + 1),
    ).cast("int")


def severity_rank(severity: Column) -> Column:
    return F.coalesce(
        F.nullif(F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity), F.lit(0)),
        F.lit(len(SEVERITIES) + 1),
    ).cast("int")


def designer_severity(severity: Column) -> Column:
    return lookup(DESIGNER_SEVERITY, severity)


def typography(age: Column) -> Column:
    """Letter style by rounds since the comment was first raised."""
    return F.when(age <= 0, "italic").when(age == 1, "bold").otherwise("underlined")


def round_from_typography(style: Column) -> Column:
    return F.when(style == "italic", 1).when(style == "bold", 2).when(style == "underlined", 3)


def model_for(role: Column) -> Column:
    return lookup(MODEL_ROLES, role)


def escalation_role(conf: Column, rule_id: Column) -> Column:
    return F.when((conf < ESCALATE_BELOW) | needs_license(rule_id), "escalation").otherwise("primary")


def sheet_discipline(raw: Column) -> Column:
    return F.when(_sheet_part(raw, 1) != "", _sheet_part(raw, 1))


def _sheet_part(raw: Column, group: int) -> Column:
    return F.regexp_extract(F.upper(F.btrim(raw)), r"^([GASMEPTF])-?(\d+(?:\.\d+)?)$", group)


def sheet_number(raw: Column) -> Column:
    return F.when(_sheet_part(raw, 2) != "", _sheet_part(raw, 2))


def canonical_sheet(raw: Column) -> Column:
    """``a1.1`` and ``A-1.1`` -> ``A-1.1``; null for other forms."""
    return F.concat(sheet_discipline(raw), F.lit("-"), sheet_number(raw))


def sheet_type(title: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, words in reversed(SHEET_TYPES):
        out = F.when(F.lower(title).rlike(words), name).otherwise(out)
    return out


def parse_date(c: Column) -> Column:
    """Title-block date in any of the accepted spellings, null otherwise."""
    text = F.regexp_replace(F.btrim(c), r"[.\-]", "/")
    words = F.initcap(F.regexp_replace(F.btrim(c), ",", ""))
    return F.coalesce(
        F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(text, "M/d/yyyy")),
        F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{2}$"), F.try_to_date(text, "M/d/yy")),
        F.when(words.rlike(r"^[A-Z][a-z]{2} \d{1,2} \d{4}$"), F.try_to_date(words, "MMM d yyyy")),
        F.when(words.rlike(r"^[A-Z][a-z]{3,} \d{1,2} \d{4}$"), F.try_to_date(words, "MMMM d yyyy")),
    )


def is_stale_date(title_date: Column, received: Column, days: int = 90) -> Column:
    return F.datediff(received, title_date) > days
