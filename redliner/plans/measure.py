"""Scales, measurements, confidence and overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redliner.functions import geometry as g
from redliner.functions.review import lookup
from redliner.operators.asof import neighbours_join
from redliner.operators.keyed import latest_per_key, parsed
from redliner.operators.hull import farthest_pair
from redliner.operators.isotonic import isotonic_fit, isotonic_values
from redliner.operators.nearest import nearest_place
from redliner.operators.routing import shortest_to_sources
from redliner.operators.scan import every, last_value, ordered_scan
from redliner.session import durable, growing

POINTS_PER_INCH = 72.0
CALIBRATION_DELTA = 0.02
MISMATCH_FACTOR = 0.8

# Confidence factor per page class, and measures switched off per class.
CLASS_FACTOR = {"vector": 1.0, "hybrid": 1.0, "raster": 0.8, "low_quality_scan": 0.8}
DISABLED = {
    "raster": ["egress_travel_distance"],
    "low_quality_scan": [
        "area", "room_area", "door_clear_width", "window_nco", "egress_travel_distance", "exit_separation",
        "accessible_route_width", "turning_space_diameter", "stair_rise", "stair_run", "ramp_slope", "ceiling_height",
    ],
}


# --- scale ------------------------------------------------------------------------

def best_anchors(anchors: DataFrame) -> DataFrame:
    """Per viewport the anchor with the best reading, longest first among equals.

    ``anchors``: sheet_id, viewport, dim_text, drawn_pts, confidence.
    """
    usable = parsed(anchors, "dim_text", g.parse_dimension, "inches").filter(
        F.col("inches").isNotNull() & (F.col("drawn_pts") > 0)
    )
    row = F.struct("confidence", "drawn_pts", "inches", "dim_text")
    return usable.groupBy("sheet_id", "viewport").agg(F.max(row).alias("a")).select("sheet_id", "viewport", "a.*")


def resolve_scale(viewports: DataFrame, anchors: DataFrame) -> DataFrame:
    """Declared against calibrated ratio per viewport.

    A difference over 2% takes the calibrated ratio at 0.8 of the confidence.
    Without a readable declared scale the calibrated one stands, and the other
    way round.
    """
    best = best_anchors(anchors).select(
        "sheet_id", "viewport", F.col("confidence").alias("anchor_confidence"),
        (F.col("inches") / (F.col("drawn_pts") / POINTS_PER_INCH)).alias("calibrated_ratio"),
    )
    both = parsed(viewports, "scale_text", g.parse_scale, "declared_ratio").join(best, ["sheet_id", "viewport"], "left")
    delta = F.try_divide(F.abs(F.col("declared_ratio") - F.col("calibrated_ratio")), F.col("declared_ratio"))
    off = delta > CALIBRATION_DELTA
    return both.withColumn("delta", delta).select(
        "sheet_id", "viewport", "declared_ratio", "calibrated_ratio", "delta",
        F.when(off | F.col("declared_ratio").isNull(), F.col("calibrated_ratio")).otherwise(F.col("declared_ratio")).alias("ratio"),
        F.when(off, F.col("anchor_confidence") * MISMATCH_FACTOR).otherwise(F.coalesce("anchor_confidence", F.lit(0.7))).alias("confidence"),
    )


def real_inches(points: Column, ratio: Column) -> Column:
    return points / POINTS_PER_INCH * ratio


# --- measures ---------------------------------------------------------------------

def measure_distance(requests: DataFrame, scales: DataFrame) -> DataFrame:
    """Straight line in inches between two points of a sheet."""
    drawn = g.distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    return requests.join(scales.select("sheet_id", "ratio"), "sheet_id").withColumn("inches", real_inches(drawn, F.col("ratio")))


def room_dimensions(rooms: DataFrame) -> DataFrame:
    """Width, length, diagonal and area of room polygons in real units; ``ratio`` is on the row."""
    xs, ys = F.transform("points", lambda p: p["x"]), F.transform("points", lambda p: p["y"])
    w, h = F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys)
    k = F.col("ratio") / POINTS_PER_INCH
    return rooms.withColumns(
        {
            "width_in": F.least(w, h) * k,
            "length_in": F.greatest(w, h) * k,
            "diagonal_in": g.polygon_diagonal(F.col("points")) * k,
            "area_sqft": g.square_feet(g.polygon_area(F.col("points")) * k * k),
        }
    )


def opening_specs(schedule: DataFrame, drawn: DataFrame, keys: list[str]) -> DataFrame:
    """Door or window sizes: per size the reading with the higher confidence, schedule on ties.

    Both sides have the keys, width_in, height_in and confidence. NCO is the
    opening area in square feet.
    """
    s = schedule.select(*keys, *[F.col(c).alias(f"s_{c}") for c in ("width_in", "height_in", "confidence")])
    d = drawn.select(*keys, *[F.col(c).alias(f"d_{c}") for c in ("width_in", "height_in", "confidence")])
    both = s.join(d, keys, "full_outer")
    from_schedule = F.col("s_confidence").isNotNull() & (F.col("d_confidence").isNull() | (F.col("s_confidence") >= F.col("d_confidence")))

    def take(c: str) -> Column:
        return F.when(from_schedule, F.coalesce(f"s_{c}", f"d_{c}")).otherwise(F.coalesce(f"d_{c}", f"s_{c}"))

    out = both.select(*keys, take("width_in").alias("width_in"), take("height_in").alias("height_in"), take("confidence").alias("confidence"),
                      F.when(from_schedule, "schedule").otherwise("geometry").alias("source"))
    return out.withColumn("nco_sqft", g.square_feet(F.col("width_in") * F.col("height_in")))


def measure_between(requests: DataFrame, entities: DataFrame) -> DataFrame:
    """Centre and edge distance of two named entities of one sheet, in points."""
    # written once, so that no task that sorts for a join also computes the entities; four numbers take half of an array's room
    boxes = durable(entities.select("sheet_id", "entity_id", *[F.col("bbox")[i].alias(f"b{i}") for i in range(4)]))

    def side(tag: str) -> DataFrame:
        return growing(boxes.select("sheet_id", F.col("entity_id").alias(f"entity_{tag}"), *[F.col(f"b{i}").alias(f"{tag}{i}") for i in range(4)]))

    both = requests.select("sheet_id", "entity_a", "entity_b").join(side("a"), ["sheet_id", "entity_a"]).join(side("b"), ["sheet_id", "entity_b"])
    a, b = [[F.col(f"{tag}{i}") for i in range(4)] for tag in "ab"]
    centre = g.distance((a[0] + a[2]) / 2, (a[1] + a[3]) / 2, (b[0] + b[2]) / 2, (b[1] + b[3]) / 2)
    dx = F.greatest(a[0] - b[2], b[0] - a[2], F.lit(0.0))
    dy = F.greatest(a[1] - b[3], b[1] - a[3], F.lit(0.0))
    return both.select("sheet_id", "entity_a", "entity_b", centre.alias("centre"), F.sqrt(dx * dx + dy * dy).alias("edge"))


def egress_straight(points: DataFrame, exits: DataFrame) -> DataFrame:
    """Straight-line travel per floor: the farthest point from the exit it discharges to.

    ``points``: sheet_id, exit_id, x, y; ``exits``: sheet_id, exit_id, x, y.
    Where points do not name their exit, ``egress_routed`` finds it.
    """
    e = exits.select("sheet_id", "exit_id", F.col("x").alias("ex"), F.col("y").alias("ey"))
    joined = points.join(e, ["sheet_id", "exit_id"])
    return joined.groupBy("sheet_id").agg(F.max(g.distance(F.col("x"), F.col("y"), F.col("ex"), F.col("ey"))).alias("travel"))


def egress_nearest(points: DataFrame, exits: DataFrame) -> DataFrame:
    """Straight-line travel per floor from every point to its nearest exit; points need not name one.

    ``points``: sheet_id, point_id, x, y; ``exits``: sheet_id, exit_id, x, y.
    ``travel`` is the longest way, null on a floor without exits; ``unserved``
    counts the points of such a floor.
    """
    found = nearest_place(points, exits, ["sheet_id"], "point_id", "exit_id")
    return found.groupBy("sheet_id").agg(
        F.max("distance").alias("travel"), F.count(F.lit(1)).alias("points"), F.count_if(F.col("distance").isNull()).alias("unserved"),
        F.count_distinct("exit_id").alias("exits_used"))


def egress_routed(doors: DataFrame, exits: DataFrame, rooms: DataFrame | None = None) -> DataFrame:
    """Travel distance per floor routed through doorways: the longest of the shortest room-to-exit paths."""
    reach = shortest_to_sources(doors, exits, ["sheet_id"])
    if rooms is not None:
        reach = reach.join(rooms.select("sheet_id", "node"), ["sheet_id", "node"], "left_semi")
    return reach.groupBy("sheet_id").agg(F.max("distance").alias("travel"), F.count(F.lit(1)).alias("reached"))


def exit_separation(exits: DataFrame, floors: DataFrame) -> DataFrame:
    """Exit distance over floor diagonal; ``floors`` has sheet_id and diagonal. Below one half is a finding."""
    d = farthest_pair(exits, ["sheet_id"])
    return floors.join(d, "sheet_id").select("sheet_id", "farthest", "diagonal", F.try_divide("farthest", "diagonal").alias("separation"))


def route_limits(routes: DataFrame) -> DataFrame:
    """Narrowest width and steepest slope of each accessible route."""
    return routes.groupBy("sheet_id", "route_id").agg(
        F.min("width_in").alias("width_min_in"), F.max("slope_pct").alias("slope_max_pct"), F.max("cross_slope_pct").alias("cross_slope_max_pct")
    )


def verify_dimensions(texts: DataFrame, lines: DataFrame, lane_height: float = 20.0, tolerance: float = 0.02, width: float = 500.0) -> DataFrame:
    """Dimension texts against the drawn line next to them.

    ``texts``: sheet_id, text_id, orientation, along, across, text_in. ``lines``:
    sheet_id, line_id, orientation, along, across, geom_in, where ``along`` is
    the midpoint in drawing direction and ``across`` the offset from it. A text
    pairs with the line of its orientation whose midpoint is nearest along the
    direction, among lines in its lane or the lanes next to it; ties go to the
    nearer lane, then to the smaller position and line.
    """
    lane = F.floor(F.col("across") / lane_height)
    # a line is seen from its own lane and those next to it, so that a text asks once
    lanes = F.explode(F.array(*[F.struct((lane + d).alias("lane"), F.lit(abs(d)).alias("off")) for d in (0, -1, 1)]))
    placed = lines.select("sheet_id", "orientation", lanes.alias("__l"), F.col("along").alias("line_at"), "line_id", "geom_in").select("*", "__l.*").drop("__l")
    asked = texts.select("sheet_id", "orientation", lane.alias("lane"), "along", "text_id")
    near = neighbours_join(asked, placed, ["sheet_id", "orientation", "lane"], "along", "line_at", ["off", "line_at", "line_id", "geom_in"], width)
    gap = lambda side: F.when(F.col(side).isNotNull(), F.struct(F.abs(F.col("along") - F.col(side)["line_at"]).alias("gap"), f"{side}.*"))
    found = near.withColumn("near", F.least(gap("below"), gap("above"))).filter(F.col("near").isNotNull())
    best = found.groupBy("sheet_id", "text_id").agg(F.min("near").alias("m")).select(
        "sheet_id", "text_id", F.col("m.line_id").alias("line_id"), F.col("m.gap").alias("gap"), F.col("m.geom_in").alias("geom_in"))
    out = texts.join(best, ["sheet_id", "text_id"], "left")
    delta = F.try_divide(F.abs(F.col("geom_in") - F.col("text_in")), F.col("text_in"))
    return out.withColumn("delta_pct", delta * 100).withColumn("matches", delta <= tolerance)


def member_spans(bearings: DataFrame, keys: list[str], width: float = 1000.0) -> DataFrame:
    """Span between each bearing point and the one before it on the same member line."""
    scanned = ordered_scan(
        bearings, keys, [F.col("at")], every(F.col("at"), width), {"previous": last_value(F.col("at"), inclusive=False)}
    )
    return scanned.filter(F.col("previous").isNotNull()).withColumn("span", F.col("at") - F.col("previous"))


def heights(plans: DataFrame, sections: DataFrame, elevations: DataFrame, keys: list[str]) -> DataFrame:
    """Height of a space from the plan, else a section, else an elevation, with its source."""
    def best(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.max_by("height_in", F.struct("confidence", "height_in")).alias(name))

    all_ = best(plans, "p").join(best(sections, "s"), keys, "full_outer").join(best(elevations, "e"), keys, "full_outer")
    source = F.when(F.col("p").isNotNull(), "plan").when(F.col("s").isNotNull(), "section").when(F.col("e").isNotNull(), "elevation")
    return all_.select(*keys, F.coalesce("p", "s", "e").alias("height_in"), source.alias("source"))


def pdf_class(text_share: Column, dpi: Column, min_dpi: int = 100) -> Column:
    """Page class from the share of text coverage; a low resolution makes it a poor scan."""
    return (
        F.when(text_share >= 0.9, "vector").when(text_share >= 0.3, "hybrid").when(dpi < min_dpi, "low_quality_scan").otherwise("raster")
    )


# --- confidence -------------------------------------------------------------------

def compose_confidence(trace: Column, quality: Column) -> Column:
    """Product of the trace, scaled by the page class, capped at 0.99 and floored at 0.30."""
    factor = lookup(CLASS_FACTOR, quality, 1.0)
    return g.composed_confidence(F.concat(trace, F.array(factor)))


def is_disabled(kind: Column, quality: Column) -> Column:
    out = F.lit(False)
    for name, kinds in DISABLED.items():
        out = out | ((quality == name) & kind.isin(kinds))
    return out


def apply_overrides(measurements: DataFrame, actions: DataFrame) -> DataFrame:
    """Measurements with the latest reviewer override; the original value stays next to it.

    An overridden measure has confidence 1. ``actions``: measurement_id,
    new_value, reviewer_id, created_at, action_id.
    """
    newest = latest_per_key(
        actions.select("measurement_id", "new_value", "reviewer_id", "created_at", "action_id"), ["measurement_id"],
        [F.col("created_at"), F.col("action_id")],
    )
    counts = actions.groupBy("measurement_id").agg(F.count(F.lit(1)).alias("n_overrides"))
    joined = measurements.join(newest, "measurement_id", "left").join(counts, "measurement_id", "left")
    return joined.select(
        *[c for c in measurements.columns if c not in ("value", "confidence")],
        F.col("value").alias("original_value"),
        F.coalesce("new_value", "value").alias("value"),
        F.when(F.col("new_value").isNotNull(), F.lit(1.0)).otherwise(F.col("confidence")).alias("confidence"),
        F.coalesce("n_overrides", F.lit(0)).cast("long").alias("n_overrides"),
    )


def override_history(actions: DataFrame, measurements: DataFrame) -> DataFrame:
    """Every override with the value it replaced, oldest first."""
    scanned = ordered_scan(
        actions, ["measurement_id"], [F.col("created_at"), F.col("action_id")], F.date_trunc("MONTH", F.col("created_at")),
        {"before": last_value(F.col("new_value"), inclusive=False)},
    )
    return scanned.join(measurements.select("measurement_id", "value"), "measurement_id").select(
        "measurement_id", "action_id", "reviewer_id", "created_at", F.coalesce("before", "value").alias("old_value"), "new_value"
    )


def recalibrate(outcomes: DataFrame) -> DataFrame:
    """Isotonic fit of correctness on stated confidence: one row per different confidence.

    ``outcomes``: confidence and kept (1 when the reviewer left the value alone).
    """
    return durable(isotonic_fit(outcomes))


def recalibrated(df: DataFrame, fit: DataFrame) -> DataFrame:
    """``df`` with its recalibrated confidence as ``prediction``."""
    return isotonic_values(df, fit)


# --- aggregates -------------------------------------------------------------------

def occupant_load(rooms: DataFrame, factors: DataFrame, keys: list[str]) -> DataFrame:
    """Occupants per group: the sum over rooms of area over load factor, each rounded up.

    ``factors`` is a table of uses; rooms of an unknown use count no occupants.
    """
    per_room = rooms.join(factors, "use", "left").withColumn(
        "occupants", F.coalesce(F.ceil(F.try_divide("area_sqft", "factor")), F.lit(0)).cast("long")
    )
    return per_room.groupBy(*keys).agg(F.sum("occupants").alias("occupants"), F.count(F.lit(1)).alias("rooms"))


def measurement_error(measured: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """Mean absolute error per measurement type."""
    both = measured.join(reference.select(*keys, F.col("value").alias("truth")), keys)
    return both.groupBy("type").agg(F.avg(F.abs(F.col("value") - F.col("truth"))).alias("mae"), F.count(F.lit(1)).alias("n"))


def attic_ratio(attics: DataFrame, keys: list[str]) -> DataFrame:
    """Free vent area over attic area with the rule it meets: 1:150, or 1:300 for balanced venting."""
    t = attics.groupBy(*keys).agg(F.sum("vent_sqft").alias("vent_sqft"), F.max("attic_sqft").alias("attic_sqft"), F.max("balanced").alias("balanced"))
    need = F.when(F.col("balanced"), 1.0 / 300).otherwise(1.0 / 150)
    return t.withColumn("ratio", F.try_divide("vent_sqft", "attic_sqft")).withColumn("ok", F.col("ratio") >= need)
