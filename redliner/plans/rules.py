"""Discipline rules. Row checks share one scan per frame; frame rules join or aggregate."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redliner.functions.codes import display_citation
from redliner.operators.overlap import overlaps_any
from redliner.plans.findings import RuleBook, emit
from redliner.plans.integrity import callouts_vs_schedule

BOOK = RuleBook()

# Limits of the measured rules (inches, square feet, percent, CFM).
MIN_NCO_SQFT = 5.7
MIN_SIDE_CLEARANCE_IN = 18.0
MIN_TURNING_IN = 60.0
MIN_DOOR_CLEAR_IN = 32.0
REACH_IN = (15.0, 48.0)
MIN_EXIT_SEPARATION = 0.5
MAX_HOOD_CFM = 400.0
MIN_HEATER_HEIGHT_IN = 18.0
MIN_DIVERSION_PCT = 65.0
MAX_R21_OCCUPANTS = 6

# Items a room of a use must have, with the severity of a miss.
ROOM_NEEDS = {
    "bathroom": [("gfci_receptacle", "provide"), ("dedicated_20a_circuit", "provide"), ("switched_light", "provide")],
    "bedroom": [("afci_protection", "revise"), ("switched_light", "provide")],
    "kitchen": [("gfci_receptacle", "provide"), ("switched_light", "provide")],
    "living": [("afci_protection", "revise"), ("switched_light", "provide")],
}
GREEN_NEEDS = {
    "sfr": ["4.106.4.1", "4.303", "4.408", "4.410"],
    "multifamily": ["4.106.4.2", "4.303", "4.408", "4.410"],
}
FIXTURE_RATIO = {"water_closet": 25, "lavatory": 40, "drinking_fountain": 100}


def limit_check(value: Column, comparison: Column, limit: Column) -> Column:
    """True when a value keeps its limit."""
    return F.when(comparison == ">=", value >= limit).when(comparison == "<=", value <= limit).when(comparison == "=", value == limit)


def threshold_findings(facts: DataFrame, thresholds: DataFrame, default_severity: str = "revise") -> DataFrame:
    """Facts that break a threshold of their measurement type.

    ``facts``: project_id, sheet_id, fact_id, type, value, confidence.
    ``thresholds``: type, rule_id, discipline, comparison, threshold, citation.
    An equi-join on the type with the small rule table; the comparison follows.
    """
    both = facts.join(thresholds, "type")
    hit = both.filter(~limit_check(F.col("value"), F.col("comparison"), F.col("threshold")))
    text = F.format_string(
        "Measured %.1f; %s requires %s %.1f.", F.col("value"), display_citation(F.col("citation")), F.col("comparison"), F.col("threshold")
    )
    return emit(hit, F.col("rule_id"), "architectural", default_severity, text, F.col("fact_id"), F.col("confidence"), F.col("citation")).withColumn(
        "discipline", F.substring_index("rule_id", "-", 1)
    )


def _conf() -> Column:
    return F.col("confidence")


# --- architectural ---------------------------------------------------------------

@BOOK.check("ARCH-EGRESS-010", "windows", "architectural", "revise", citation="CRC-R310.2.1",
            confidence=lambda: F.least("confidence", "section_confidence"))
def egress_window():
    broken = (F.col("room_use") == "bedroom") & F.col("is_new") & (F.col("nco_sqft") < MIN_NCO_SQFT)
    text = F.format_string("Window %s in %s has NCO of %.1f sqft; CRC §R310.2.1 requires ≥ 5.7 sqft.", "tag", "room_label", "nco_sqft")
    return broken, text, F.col("window_id")


@BOOK.check("ARCH-EGRESS-020", "floors", "architectural", "revise", citation="CBC-1007.1.1", confidence=_conf)
def exit_separation():
    broken = F.try_divide("exit_distance_ft", "diagonal_ft") < MIN_EXIT_SEPARATION
    text = F.format_string("Exits are %.1f ft apart; half of the diagonal is %.1f ft.", "exit_distance_ft", F.col("diagonal_ft") / 2)
    return broken, text, F.col("sheet_id")


@BOOK.check("ARCH-TRAVEL-DISTANCE", "floors", "architectural", "revise", citation="CBC-1017.2", confidence=_conf)
def travel_distance():
    text = F.format_string("Travel distance of %.1f ft exceeds %.1f ft.", "travel_ft", "travel_limit_ft")
    return F.col("travel_ft") > F.col("travel_limit_ft"), text, F.col("sheet_id")


@BOOK.check("ARCH-SEPARATION-RATING", "separations", "architectural", "revise", citation="CBC-TBL-508.4")
def separation_rating():
    broken = F.coalesce("provided_hours", F.lit(0.0)) < F.col("required_hours")
    text = F.concat(F.lit("Separation of "), F.col("occupancy_a"), F.lit(" and "), F.col("occupancy_b"), F.lit(" lacks the required rating."))
    return broken, text, F.col("separation_id")


# --- accessibility ---------------------------------------------------------------

@BOOK.check("ACC-BATH-030", "clearances", "accessibility", "revise", citation="CBC-11B-604.2", confidence=_conf)
def side_clearance():
    text = F.format_string("Side clearance of %.1f in; 18 in are required.", "side_clearance_in")
    return F.col("side_clearance_in") < MIN_SIDE_CLEARANCE_IN, text, F.col("clearance_id")


@BOOK.check("ACC-DOOR-WIDTH", "doors", "accessibility", "revise", citation="CBC-11B-404.2.3", confidence=_conf)
def door_width():
    text = F.format_string("Door %s has a clear width of %.1f in; 32 in are required.", "tag", "clear_width_in")
    return F.col("clear_width_in") < MIN_DOOR_CLEAR_IN, text, F.col("door_id")


@BOOK.check("ACC-REACH-RANGE", "controls", "accessibility", "revise", citation="CBC-11B-308", confidence=_conf)
def reach_range():
    text = F.format_string("Control at %.1f in is outside of 15 to 48 in.", "height_in")
    return ~F.col("height_in").between(*REACH_IN), text, F.col("control_id")


@BOOK.check("ACC-SIGNAGE", "signs", "accessibility", lambda: F.when(F.col("state") == "missing", "provide").otherwise("revise"), citation="CBC-11B-703")
def signage():
    return F.col("state").isin("missing", "incorrect"), F.concat(F.lit("Signage is "), F.col("state"), F.lit(".")), F.col("sign_id")


@BOOK.rule("ACC-TURNING-005", "turning_spaces", "door_swings")
def turning_space(ctx: Mapping[str, DataFrame]) -> DataFrame:
    """A turning space that meets a door swing, both given as boxes in inches."""
    keys = ["project_id", "sheet_id"]
    hit = overlaps_any(ctx["turning_spaces"], ctx["door_swings"], keys, "space_id", "door_id")
    text = F.concat(F.lit("The turning space is obstructed by the swing of door "), F.col("door_id").cast("string"), F.lit(". Revise."))
    return emit(hit, "ACC-TURNING-005", "accessibility", "revise", text, F.col("space_id"), citation="CBC-11B-304.3")


# --- structural ------------------------------------------------------------------

@BOOK.rule("STR-SHEAR", "shear_callouts", "shear_schedule")
def shear_schedule(ctx: Mapping[str, DataFrame]) -> DataFrame:
    """STR-SHEAR-001 for callouts without a row; rows without callouts and size conflicts next to it."""
    odd = callouts_vs_schedule(ctx["shear_callouts"], ctx["shear_schedule"], ["project_id", "tag"], "size")
    rule = F.when(F.col("severity") == "provide", "STR-SHEAR-001").when(F.col("severity") == "clarify", "STR-SCHEDULE-ORPHAN").otherwise("STR-SIZE-CONFLICT")
    text = F.concat(F.lit("Shear wall type "), F.col("tag").cast("string"), F.lit(": callouts and schedule disagree."))
    out = emit(odd.withColumn("sheet_id", F.lit(None).cast("string")), rule, "structural", F.col("severity"), text, F.col("tag"))
    return out.withColumn("advisory_licensed_note", F.col("rule_id") == "STR-SIZE-CONFLICT")


@BOOK.rule("STR-HOLDOWN-005", "wall_ends", "holdowns")
def holdowns(ctx: Mapping[str, DataFrame]) -> DataFrame:
    keys = ["project_id", "sheet_id", "wall_id", "wall_end"]
    bare = ctx["wall_ends"].join(ctx["holdowns"].select(*keys).distinct(), keys, "left_anti")
    text = F.concat(F.lit("Shear wall "), F.col("wall_id").cast("string"), F.lit(" shows no holdown at its "), F.col("wall_end"), F.lit(" end. Provide."))
    return emit(bare, "STR-HOLDOWN-005", "structural", "provide", text, F.concat_ws("/", "wall_id", "wall_end"))


# --- mechanical ------------------------------------------------------------------

@BOOK.rule("MECH-OCCUPANCY-001", "occupancies", "hvac_units")
def hvac_per_occupancy(ctx: Mapping[str, DataFrame]) -> DataFrame:
    """Mixed occupancy with fewer units than occupancies."""
    uses = ctx["occupancies"].groupBy("project_id").agg(F.countDistinct("occupancy").alias("n_occupancies"))
    units = ctx["hvac_units"].groupBy("project_id").agg(F.countDistinct("unit_id").alias("n_units"), F.min("sheet_id").alias("sheet_id"))
    hit = uses.join(units, "project_id").filter((F.col("n_occupancies") > 1) & (F.col("n_units") < F.col("n_occupancies")))
    text = F.format_string("%d occupancies are served by %d HVAC units; each needs its own.", "n_occupancies", "n_units")
    return emit(hit, "MECH-OCCUPANCY-001", "mechanical", "revise", text, F.col("project_id"), citation="CMC-403")


@BOOK.check("MECH-HOOD-MAKEUP", "hoods", "mechanical", "provide", citation="CMC-505.2")
def makeup_air():
    broken = (F.col("cfm") > MAX_HOOD_CFM) & ~F.col("has_makeup_air")
    return broken, F.format_string("Range hood of %.0f CFM needs makeup air.", "cfm"), F.col("hood_id")


@BOOK.check("MECH-BATH-EXHAUST", "exhausts", "mechanical", "revise", citation="CMC-504.4")
def bath_exhaust():
    return F.col("terminates") != "outside", F.concat(F.lit("Exhaust ends in the "), F.col("terminates"), F.lit(".")), F.col("exhaust_id")


@BOOK.check("MECH-ATTIC-VENT", "attics", "mechanical", "revise", citation="CRC-R806.2")
def attic_vent():
    return ~F.col("ok"), F.format_string("Attic vent ratio %.4f is too low.", "ratio"), F.col("sheet_id")


# --- electrical ------------------------------------------------------------------

def missing_room_items(rooms: DataFrame, present: DataFrame) -> DataFrame:
    """Required items a room does not have."""
    needs = F.lit(None).cast("array<struct<item:string,severity:string>>")
    for use, items in ROOM_NEEDS.items():
        listed = F.array(*[F.struct(F.lit(i).alias("item"), F.lit(s).alias("severity")) for i, s in items])
        needs = F.when(F.col("room_use") == use, listed).otherwise(needs)
    required = rooms.select("*", F.explode(needs).alias("n")).select(*rooms.columns, "n.item", "n.severity")
    return required.join(present.select("room_id", "item").distinct(), ["room_id", "item"], "left_anti")


@BOOK.rule("ELEC-ROOM-ITEMS", "rooms", "room_items")
def room_items(ctx: Mapping[str, DataFrame]) -> DataFrame:
    hit = missing_room_items(ctx["rooms"], ctx["room_items"])
    text = F.concat(F.lit("No "), F.replace(F.col("item"), F.lit("_"), F.lit(" ")), F.lit(" in the "), F.col("room_use"), F.lit("."))
    return emit(hit, "ELEC-ROOM-ITEMS", "electrical", F.col("severity"), text, F.concat_ws("/", "room_id", "item"), citation="CEC-210.12")


# --- plumbing --------------------------------------------------------------------

def missing_fixtures(loads: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Fixture kinds with fewer pieces than the occupants need."""
    required = F.array(*[F.struct(F.lit(k).alias("kind"), F.ceil(F.col("occupants") / r).cast("long").alias("required")) for k, r in FIXTURE_RATIO.items()])
    need = loads.select("project_id", F.inline(required))
    have = fixtures.groupBy("project_id", "kind").agg(F.count(F.lit(1)).alias("provided"))
    both = need.join(have, ["project_id", "kind"], "left").withColumn("provided", F.coalesce("provided", F.lit(0)).cast("long"))
    return both.filter(F.col("provided") < F.col("required"))


@BOOK.rule("PLUMB-FIXTURE-COUNT", "occupant_loads", "fixtures")
def fixture_counts(ctx: Mapping[str, DataFrame]) -> DataFrame:
    hit = missing_fixtures(ctx["occupant_loads"], ctx["fixtures"]).withColumn("sheet_id", F.lit(None).cast("string"))
    text = F.format_string("%d of %d required fixtures (%s) are shown.", "provided", "required", "kind")
    return emit(hit, "PLUMB-FIXTURE-COUNT", "plumbing", "provide", text, F.col("kind"), citation="CPC-422.1")


@BOOK.check("PLUMB-HEATER-HEIGHT", "water_heaters", "plumbing", "revise", citation="CPC-507.13")
def heater_height():
    broken = F.col("in_garage") & (F.col("height_in") < MIN_HEATER_HEIGHT_IN) & ~F.col("fvir_listed")
    return broken, F.format_string("Water heater at %.1f in above the garage floor needs 18 in.", "height_in"), F.col("heater_id")


@BOOK.check("PLUMB-HEATER-STRAP", "water_heaters", "plumbing", "revise", citation="CPC-507.2")
def heater_straps():
    return F.col("straps") < 2, F.lit("Water heater needs seismic straps in the upper and lower third."), F.col("heater_id")


@BOOK.check("PLUMB-BACKFLOW", "water_services", "plumbing", "provide", citation="CPC-603.5")
def backflow():
    return F.col("needs_backflow") & ~F.col("has_backflow"), F.lit("No backflow preventer is shown."), F.col("service_id")


# --- energy ----------------------------------------------------------------------

@BOOK.rule("ENERGY-PATH-001", "filed_paths", "occupancy_claims")
def compliance_path(ctx: Mapping[str, DataFrame]) -> DataFrame:
    """Filed as single family although an occupancy claim says otherwise."""
    claims = ctx["occupancy_claims"].filter(~F.col("occupancy").isin("R-3", "U")).groupBy("project_id").agg(F.min("occupancy").alias("occupancy"))
    hit = ctx["filed_paths"].filter(F.col("path") == "single_family").join(claims, "project_id")
    text = F.concat(F.lit("The energy report is filed as single family, other documents state "), F.col("occupancy"), F.lit("."))
    return emit(hit, "ENERGY-PATH-001", "energy", "revise", text, F.col("document_id"), citation="CEnC-100.0-f")


@BOOK.rule("ENERGY-HERS-NOTE", "hers_measures", "plan_notes")
def hers_measures(ctx: Mapping[str, DataFrame]) -> DataFrame:
    keys = ["project_id", "measure"]
    hit = ctx["hers_measures"].join(ctx["plan_notes"].select(*keys).distinct(), keys, "left_anti").withColumn("sheet_id", F.lit(None).cast("string"))
    return emit(hit, "ENERGY-HERS-NOTE", "energy", "provide", F.concat(F.lit("HERS measure "), F.col("measure").cast("string"), F.lit(" is not on the plans.")), F.col("measure"))


# --- fire ------------------------------------------------------------------------

@BOOK.check("FIRE-SEP-001", "separation_doors", "fire_life_safety", "revise", citation="CBC-TBL-508.4", licensed_note=True)
def separation_door():
    broken = F.col("rating_min").isNull() | ~F.col("self_closing")
    return broken, F.lit("The separation door lacks a fire rating or self-closing hardware."), F.col("door_id")


@BOOK.check("FIRE-R21-CONSTRUCTION", "care_facilities", "fire_life_safety", "revise", citation="HSC-13131.5", licensed_note=True)
def care_construction():
    broken = (F.col("occupancy") == "R-2.1") & (F.col("occupants") > MAX_R21_OCCUPANTS) & (F.col("construction_type") != "VA")
    return broken, F.format_string("R-2.1 with %d occupants requires Type V one-hour construction.", "occupants"), F.col("project_id")


@BOOK.rule("FIRE-DEFERRED-NOTE", "deferred_items", "plan_notes")
def deferred_notes(ctx: Mapping[str, DataFrame]) -> DataFrame:
    keys = ["project_id", "measure"]
    hit = ctx["deferred_items"].join(ctx["plan_notes"].select(*keys).distinct(), keys, "left_anti").withColumn("sheet_id", F.lit(None).cast("string"))
    return emit(hit, "FIRE-DEFERRED-NOTE", "fire_life_safety", "provide", F.lit("The plans lack the deferred-submittal note."), F.col("measure"), citation="NFPA-13R")


# --- green building --------------------------------------------------------------

def missing_green_measures(projects: DataFrame, shown: DataFrame) -> DataFrame:
    needs = F.lit(None).cast("array<string>")
    for kind, items in GREEN_NEEDS.items():
        needs = F.when(F.col("dwelling") == kind, F.array(*[F.lit(i) for i in items])).otherwise(needs)
    required = projects.select("project_id", "dwelling", F.explode(needs).alias("section"))
    return required.join(shown.select("project_id", "section").distinct(), ["project_id", "section"], "left_anti")


@BOOK.rule("GREEN-MANDATORY", "dwellings", "green_measures")
def green_measures(ctx: Mapping[str, DataFrame]) -> DataFrame:
    hit = missing_green_measures(ctx["dwellings"], ctx["green_measures"]).withColumn("sheet_id", F.lit(None).cast("string"))
    return emit(hit, "GREEN-MANDATORY", "calgreen", "provide", F.concat(F.lit("Mandatory measure §"), F.col("section"), F.lit(" is not on the plans.")), F.col("section"),
                citation=F.concat(F.lit("CalGreen-"), F.col("section")))


@BOOK.check("GREEN-WASTE", "waste_plans", "calgreen", "revise", citation="CalGreen-4.408")
def waste_diversion():
    return F.col("diversion_pct") < MIN_DIVERSION_PCT, F.format_string("Waste diversion of %.0f%%; 65%% is mandatory.", "diversion_pct"), F.col("project_id")


def run_rules(context: Mapping[str, DataFrame]) -> DataFrame:
    """Findings of all disciplines for the frames at hand."""
    from redliner.operators.validate import union_all
    from redliner.plans.integrity import BOOK as INTEGRITY

    parts = []
    for book in (INTEGRITY, BOOK):
        able = any(all(n in context for n in needs) for _, needs in book.rules.values()) or any(f in context for f in book.checks)
        if able:
            parts.append(book.run(context))
    return union_all(parts)
