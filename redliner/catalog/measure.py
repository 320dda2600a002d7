"""Measurement queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from redliner.catalog import adapters as a
from redliner.catalog.base import Tables, query
from redliner.functions import geometry as g
from redliner.functions import review as r
from redliner.plans import measure as m
from redliner.plans.findings import gate_confidence

ROW_ID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"


def row_id():
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("H22 H23 H33", """WITH p AS (SELECT p_partkey, p_size AS s, p_partkey % 6 AS f FROM part)
SELECT p_partkey, CASE f WHEN 0 THEN s * 12 + 6.0 WHEN 1 THEN s * 12 + 6.5 WHEN 2 THEN s * 12 + 6.0 WHEN 3 THEN s * 12 + 6.0 WHEN 4 THEN (s + 0.5) * 12 ELSE s / 8.0 END::DOUBLE AS inches,
  CASE f WHEN 0 THEN s / 0.25 * 12 WHEN 1 THEN s / 0.1875 * 12 WHEN 2 THEN s * 12.0 END::DOUBLE AS ratio FROM p""")
def dimension_parsing(t: Tables):
    s, f = F.col("p_size").cast("string"), F.col("p_partkey") % 6
    dim = (
        F.when(f == 0, F.concat(s, F.lit("'-6\""))).when(f == 1, F.concat(s, F.lit("'-6 1/2\""))).when(f == 2, F.concat(s, F.lit("' 6\"")))
        .when(f == 3, F.concat(s, F.lit("ft-6in"))).when(f == 4, F.concat(s, F.lit(".5'"))).otherwise(F.concat(s, F.lit('/8"')))
    )
    scale = (
        F.when(f == 0, F.concat(F.lit("1/4\" = "), s, F.lit("'-0\""))).when(f == 1, F.concat(F.lit("3/16\" = "), s, F.lit("'-0\"")))
        .when(f == 2, F.concat(F.lit("1\" = "), s, F.lit("'"))).otherwise(F.lit("NTS"))
    )
    return t.busy("part").select("p_partkey", g.parse_dimension(dim).alias("inches"), g.parse_scale(scale).alias("ratio"))


@query("L1 E10", """WITH v AS (SELECT DISTINCT l_orderkey AS sheet_id, l_linenumber AS viewport FROM lineitem),
d AS (SELECT *, CASE WHEN viewport % 5 <> 0 THEN (viewport * 12) / 0.25 END AS declared FROM v),
an AS (SELECT l_orderkey AS sheet_id, l_linenumber AS viewport, max((1 - l_discount::DECIMAL(4,2), l_quantity, l_partkey % 40 * 12 + 6)) AS b FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1, 2),
j AS (SELECT d.sheet_id, d.viewport, declared, b[1]::DOUBLE AS c, b[3]::DOUBLE / (b[2] / 72.0) AS cal FROM d LEFT JOIN an USING (sheet_id, viewport))
SELECT sheet_id, viewport, round(declared, 6) AS declared_ratio, round(cal, 6) AS calibrated_ratio,
  round(CASE WHEN abs(declared - cal) / declared > 0.02 OR declared IS NULL THEN cal ELSE declared END, 6) AS ratio,
  round(CASE WHEN abs(declared - cal) / declared > 0.02 THEN c * 0.8 ELSE coalesce(c, 0.7) END, 6) AS confidence FROM j""")
def scale_resolution(t: Tables):
    viewports = t.lineitem.select(F.col("l_orderkey").alias("sheet_id"), F.col("l_linenumber").alias("viewport")).distinct()
    n = F.col("viewport")
    viewports = viewports.withColumn("scale_text", F.when(n % 5 != 0, F.concat(F.lit("1/4\" = "), n.cast("string"), F.lit("'-0\""))))
    anchors = t.lineitem.filter(F.col("l_returnflag") != "A").select(
        F.col("l_orderkey").alias("sheet_id"), F.col("l_linenumber").alias("viewport"),
        F.concat((F.col("l_partkey") % 40).cast("string"), F.lit("'-6\"")).alias("dim_text"), F.col("l_quantity").alias("drawn_pts"),
        (F.lit(1) - F.col("l_discount").cast("decimal(4,2)")).cast("double").alias("confidence"))
    s = m.resolve_scale(viewports, anchors)
    return s.select("sheet_id", "viewport", *[F.round(c, 6).alias(c) for c in ("declared_ratio", "calibrated_ratio", "ratio", "confidence")])


@query("L2 H31", f"""SELECT {ROW_ID} AS room_id, round(l_quantity * 48 / 72 , 6) AS width_in, round((l_quantity + l_linenumber) * 48 / 72, 6) AS length_in,
  round(sqrt(l_quantity * l_quantity + (l_quantity + l_linenumber) * (l_quantity + l_linenumber)) * 48 / 72, 6) AS diagonal_in,
  round((l_quantity * (l_quantity + l_linenumber) - l_quantity / 2) * 48 / 72 * 48 / 72 / 144, 6) AS area_sqft FROM lineitem""")
def room_area(t: Tables):
    q, n = F.col("l_quantity"), F.col("l_linenumber").cast("double")

    def p(x, y):
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    # a rectangle with one corner cut off by a triangle of width q and height 1
    ring = F.array(p(F.lit(0), F.lit(0)), p(q, F.lit(0)), p(q, q + n - 1), p(F.lit(0), q + n))
    rooms = t.lineitem.select(row_id().alias("room_id"), ring.alias("points"), F.lit(48.0).alias("ratio"))
    d = m.room_dimensions(rooms)
    return d.select("room_id", *[F.round(c, 6).alias(c) for c in ("width_in", "length_in", "diagonal_in", "area_sqft")])


@query("L2 C25", f"""WITH e AS (SELECT l_orderkey AS sheet_id, l_linenumber AS n, min(l_quantity) AS q FROM lineitem GROUP BY 1, 2)
SELECT a.sheet_id, a.n AS entity_a, b.n AS entity_b, round(sqrt((a.n * 10 + 2 - b.n * 10 - 2) ** 2 + (a.q - b.q) ** 2), 6) AS centre,
  round(sqrt((greatest(abs(a.n - b.n) * 10 - 4, 0)) ** 2 + (greatest(abs(a.q - b.q) - 6, 0)) ** 2), 6) AS edge
FROM e a JOIN e b ON a.sheet_id = b.sheet_id AND b.n = a.n + 1""")
def measure_between(t: Tables):
    e = t.lineitem.groupBy(F.col("l_orderkey").alias("sheet_id"), F.col("l_linenumber").alias("entity_id")).agg(F.min("l_quantity").alias("q"))
    n, q = F.col("entity_id").cast("double"), F.col("q")
    boxes = e.select("sheet_id", "entity_id", g.box(n * 10, q - 3, n * 10 + 4, q + 3).alias("bbox"))
    requests = e.select("sheet_id", F.col("entity_id").alias("entity_a"), (F.col("entity_id") + 1).alias("entity_b"))
    d = m.measure_between(requests, boxes)
    return d.select("sheet_id", "entity_a", "entity_b", F.round("centre", 6).alias("centre"), F.round("edge", 6).alias("edge"))


@query("L3", """WITH s AS (SELECT p_partkey AS tag, p_size + 20.0 AS w, 36.0 AS h, 0.9 AS c FROM part WHERE p_partkey % 3 <> 0),
d AS (SELECT l_partkey AS tag, min(l_quantity) + 10 AS w, max(l_quantity) + 20 AS h, CASE WHEN l_partkey % 2 = 0 THEN 0.95 ELSE 0.8 END AS c FROM lineitem GROUP BY 1, 4),
j AS (SELECT coalesce(s.tag, d.tag) AS tag, s.w AS sw, s.h AS sh, s.c AS sc, d.w AS dw, d.h AS dh, d.c AS dc, s.c IS NOT NULL AND (d.c IS NULL OR s.c >= d.c) AS fs FROM s FULL OUTER JOIN d ON s.tag = d.tag)
SELECT tag, CASE WHEN fs THEN sw ELSE dw END::DOUBLE AS width_in, CASE WHEN fs THEN sh ELSE dh END::DOUBLE AS height_in, CASE WHEN fs THEN sc ELSE dc END::DOUBLE AS confidence,
  CASE WHEN fs THEN 'schedule' ELSE 'geometry' END AS source, round(CASE WHEN fs THEN sw * sh ELSE dw * dh END / 144, 6)::DOUBLE AS nco_sqft FROM j""")
def window_specs(t: Tables):
    p = F.col("p_partkey")
    schedule = t.part.filter(p % 3 != 0).select(p.alias("tag"), (F.col("p_size") + 20.0).alias("width_in"), F.lit(36.0).alias("height_in"), F.lit(0.9).alias("confidence"))
    drawn = t.lineitem.groupBy(F.col("l_partkey").alias("tag")).agg(
        (F.min("l_quantity") + 10).alias("width_in"), (F.max("l_quantity") + 20).alias("height_in"),
    ).withColumn("confidence", F.when(F.col("tag") % 2 == 0, 0.95).otherwise(0.8))
    return m.opening_specs(schedule, drawn, ["tag"]).withColumn("nco_sqft", F.round("nco_sqft", 6))


@query("L4", """WITH e AS (SELECT l_orderkey AS s, l_linenumber AS x, min(l_quantity) AS y, l_linenumber % 2 AS k FROM lineitem GROUP BY 1, 2)
SELECT p.s AS sheet_id, round(max(sqrt((p.x - e.x) ** 2 + (p.y - e.y) ** 2)), 6) AS travel FROM e p JOIN e ON p.s = e.s AND e.x = p.k + 1 GROUP BY 1""")
def egress_straight(t: Tables):
    nodes = t.lineitem.groupBy(F.col("l_orderkey").alias("sheet_id"), F.col("l_linenumber").alias("x")).agg(F.min("l_quantity").alias("y"))
    points = nodes.withColumn("exit_id", F.col("x") % 2 + 1)
    exits = nodes.withColumn("exit_id", F.col("x"))
    return m.egress_straight(points, exits).withColumn("travel", F.round("travel", 6))


SQL_PLACES = f"""pt AS (SELECT l_suppkey AS sheet_id, {ROW_ID} AS point_id, l_partkey % 701 + l_discount AS x, l_orderkey % 523 + l_tax AS y, l_partkey % 37 = 0 AND l_suppkey % 10 <> 3 AS is_exit FROM lineitem)"""


@query("L4", f"""WITH {SQL_PLACES}, e AS (SELECT DISTINCT sheet_id, point_id AS exit_id, x AS ex, y AS ey FROM pt WHERE is_exit),
d AS (SELECT p.sheet_id, p.point_id, min(sqrt((x - ex) * (x - ex) + (y - ey) * (y - ey))) AS distance,
  arg_min(exit_id, (sqrt((x - ex) * (x - ex) + (y - ey) * (y - ey)), exit_id)) AS exit_id FROM (SELECT DISTINCT * FROM pt) p LEFT JOIN e ON e.sheet_id = p.sheet_id GROUP BY 1, 2)
SELECT sheet_id, round(max(distance), 6) AS travel, count(*) AS points, count(*) FILTER (WHERE distance IS NULL) AS unserved, count(DISTINCT exit_id) AS exits_used FROM d GROUP BY 1""")
def egress_nearest(t: Tables):
    points = t.lineitem.select(
        F.col("l_suppkey").alias("sheet_id"), row_id().alias("point_id"), (F.col("l_partkey") % 701 + F.col("l_discount")).alias("x"), (F.col("l_orderkey") % 523 + F.col("l_tax")).alias("y"),
        ((F.col("l_partkey") % 37 == 0) & (F.col("l_suppkey") % 10 != 3)).alias("is_exit"))
    exits = points.filter("is_exit").withColumnRenamed("point_id", "exit_id")
    return m.egress_nearest(points, exits).withColumn("travel", F.round("travel", 6))


@query("L5", """WITH RECURSIVE n AS (SELECT l_orderkey AS s, l_linenumber AS n, min(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
ed AS (SELECT a.s, a.n AS a, b.n AS b, a.q + b.q AS len FROM n a JOIN n b ON a.s = b.s AND b.n IN (a.n + 1, a.n + 3)),
b2 AS (SELECT s, a, b, len FROM ed UNION ALL SELECT s, b, a, len FROM ed),
r AS (SELECT s, min(n) AS node, 0.0::DOUBLE AS d, 0 AS hops FROM n GROUP BY 1
  UNION SELECT r.s, b2.b, r.d + b2.len, hops + 1 FROM r JOIN b2 ON r.s = b2.s AND r.node = b2.a WHERE hops < 7),
k AS (SELECT s, node, min(d) AS d FROM r GROUP BY 1, 2)
SELECT s AS sheet_id, max(d) AS travel, count(*) AS reached FROM k GROUP BY 1""")
def routed_egress(t: Tables):
    nodes = t.lineitem.groupBy(F.col("l_orderkey").alias("sheet_id"), F.col("l_linenumber").alias("n")).agg(F.min("l_quantity").alias("q"))
    to = nodes.select("sheet_id", F.col("n").alias("b"), F.col("q").alias("qb"))
    doors = nodes.select("sheet_id", F.col("n").alias("a"), "q", F.explode(F.array(F.col("n") + 1, F.col("n") + 3)).alias("b")).join(to, ["sheet_id", "b"])
    exits = nodes.groupBy("sheet_id").agg(F.min("n").alias("node"))
    return m.egress_routed(doors.select("sheet_id", "a", "b", (F.col("q") + F.col("qb")).alias("length")), exits)


@query("L6 H31 ARCH-EGRESS-020", """WITH p AS (SELECT l_suppkey AS s, l_quantity AS x, (l_partkey % 50)::DOUBLE AS y FROM lineitem GROUP BY 1, 2, 3),
d AS (SELECT s, sqrt(50.0 * 50 + (s % 30 + 20) * (s % 30 + 20)) AS diagonal FROM (SELECT DISTINCT s FROM p))
SELECT a.s AS sheet_id, round(max(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)), 6) AS farthest, round(max(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) / d.diagonal, 6) AS separation
FROM p a JOIN p b ON a.s = b.s JOIN d ON d.s = a.s GROUP BY a.s, d.diagonal
UNION ALL SELECT l_orderkey + 1000000, round(max(sqrt((a.l_quantity - b.q) ** 2 + (a.l_partkey % 50 - b.y) ** 2)), 6), NULL FROM lineitem a JOIN (SELECT l_orderkey AS k, l_quantity AS q, l_partkey % 50 AS y FROM lineitem) b ON a.l_orderkey = b.k GROUP BY 1""")
def exit_separation(t: Tables):
    points = t.lineitem.select(F.col("l_suppkey").alias("sheet_id"), F.col("l_quantity").alias("x"), (F.col("l_partkey") % 50).cast("double").alias("y"))
    k = F.col("sheet_id") % 30 + 20
    floors = points.select("sheet_id").distinct().withColumn("diagonal", F.sqrt(F.lit(2500.0) + k * k))
    big = m.exit_separation(points, floors).select("sheet_id", F.round("farthest", 6).alias("farthest"), F.round("separation", 6).alias("separation"))
    small = m.farthest_pair(
        t.lineitem.select((F.col("l_orderkey") + 1000000).alias("sheet_id"), F.col("l_quantity").alias("x"), (F.col("l_partkey") % 50).cast("double").alias("y")), ["sheet_id"])
    return big.unionByName(small.select("sheet_id", F.round("farthest", 6).alias("farthest"), F.lit(None).cast("double").alias("separation")))


@query("L7", """SELECT l_orderkey AS sheet_id, l_linenumber AS route_id, min(l_quantity) AS width_min_in, max(l_discount) AS slope_max_pct, max(l_tax) AS cross_slope_max_pct FROM lineitem GROUP BY 1, 2""")
def accessible_routes(t: Tables):
    routes = t.lineitem.select(
        F.col("l_orderkey").alias("sheet_id"), F.col("l_linenumber").alias("route_id"), F.col("l_quantity").alias("width_in"),
        F.col("l_discount").alias("slope_pct"), F.col("l_tax").alias("cross_slope_pct"))
    return m.route_limits(routes)


SQL_DIMS = f"""x AS (SELECT DISTINCT l_suppkey AS sheet_id, {ROW_ID} AS text_id, CASE WHEN l_linenumber % 2 = 0 THEN 'h' ELSE 'v' END AS orientation, (l_partkey % 701)::DOUBLE AS along,
  (l_orderkey % 300)::DOUBLE AS across, l_quantity AS text_in FROM lineitem WHERE l_returnflag <> 'N'),
ln AS (SELECT DISTINCT l_suppkey AS sheet_id, {ROW_ID} AS line_id, CASE WHEN l_linenumber % 2 = 0 THEN 'h' ELSE 'v' END AS orientation, (l_partkey % 701)::DOUBLE AS along, (l_orderkey % 300)::DOUBLE AS across, l_quantity AS geom_in
  FROM lineitem WHERE l_returnflag = 'N')"""


@query("C16 L8 E11", f"""WITH {SQL_DIMS}, c AS (SELECT x.sheet_id, x.text_id, x.text_in, ln.line_id, ln.geom_in, row_number() OVER (PARTITION BY x.sheet_id, x.text_id
   ORDER BY abs(x.along - ln.along), abs(floor(ln.across / 20) - floor(x.across / 20)), ln.along, ln.line_id, ln.geom_in) AS rn, abs(x.along - ln.along) AS gap
 FROM x JOIN ln ON x.sheet_id = ln.sheet_id AND x.orientation = ln.orientation AND abs(floor(ln.across / 20) - floor(x.across / 20)) <= 1)
SELECT x.sheet_id, x.text_id, c.line_id, c.gap, round(abs(c.geom_in - x.text_in) / x.text_in * 100, 6) AS delta_pct, abs(c.geom_in - x.text_in) / x.text_in <= 0.02 AS matches
FROM x LEFT JOIN c ON c.sheet_id = x.sheet_id AND c.text_id = x.text_id AND rn = 1""")
def nearest_dimension_line(t: Tables):
    def rows(df, name, value):
        return df.select(
            F.col("l_suppkey").alias("sheet_id"), row_id().alias(name), F.when(F.col("l_linenumber") % 2 == 0, "h").otherwise("v").alias("orientation"),
            (F.col("l_partkey") % 701).cast("double").alias("along"), (F.col("l_orderkey") % 300).cast("double").alias("across"), F.col("l_quantity").alias(value))

    texts = rows(t.lineitem.filter(F.col("l_returnflag") != "N"), "text_id", "text_in")
    lines = rows(t.lineitem.filter(F.col("l_returnflag") == "N"), "line_id", "geom_in")
    v = m.verify_dimensions(texts, lines)
    return v.select("sheet_id", "text_id", "line_id", "gap", F.round("delta_pct", 6).alias("delta_pct"), "matches")


@query("L12", """WITH b AS (SELECT DISTINCT l_suppkey AS sheet_id, l_linenumber AS member, (l_partkey % 997)::DOUBLE AS "at" FROM lineitem), w AS (SELECT *, lag("at") OVER (PARTITION BY sheet_id, member ORDER BY "at") AS previous FROM b)
SELECT sheet_id, member, "at", "at" - previous AS span FROM w WHERE previous IS NOT NULL""")
def member_spans(t: Tables):
    b = t.lineitem.select(F.col("l_suppkey").alias("sheet_id"), F.col("l_linenumber").alias("member"), (F.col("l_partkey") % 997).cast("double").alias("at")).distinct()
    return m.member_spans(b, ["sheet_id", "member"], 100.0).drop("previous")


@query("L13", """WITH b AS (SELECT l_orderkey AS space, l_returnflag AS f, arg_max(l_quantity, (1 - l_discount, l_quantity)) AS h FROM lineitem GROUP BY 1, 2)
SELECT space, coalesce(max(h) FILTER (WHERE f = 'A'), max(h) FILTER (WHERE f = 'N'), max(h) FILTER (WHERE f = 'R')) AS height_in,
  CASE WHEN count(*) FILTER (WHERE f = 'A') > 0 THEN 'plan' WHEN count(*) FILTER (WHERE f = 'N') > 0 THEN 'section' ELSE 'elevation' END AS source FROM b GROUP BY 1""")
def space_heights(t: Tables):
    rows = t.lineitem.select(
        F.col("l_orderkey").alias("space"), "l_returnflag", F.col("l_quantity").alias("height_in"), (1 - F.col("l_discount")).alias("confidence"))
    side = {f: rows.filter(F.col("l_returnflag") == f) for f in "ANR"}
    return m.heights(side["A"], side["N"], side["R"], ["space"])


TYPES = ["door_clear_width", "window_nco", "room_area", "egress_travel_distance", "distance"]
CLASSES = ["vector", "hybrid", "raster", "low_quality_scan"]


@query("D20 B13 B22 L9 B14", f"""WITH x AS (SELECT {ROW_ID} AS measurement_id, {a.sql_pick(TYPES, 'l_linenumber')} AS type, {a.sql_pick(CLASSES, 'l_suppkey')} AS q, (1 - l_discount) * (1 - l_tax) * 0.97 AS p FROM lineitem),
y AS (SELECT *, least(0.99, greatest(0.30, p * CASE WHEN q IN ('raster', 'low_quality_scan') THEN 0.8 ELSE 1 END)) AS c,
 CASE type WHEN 'door_clear_width' THEN 0.90 WHEN 'window_nco' THEN 0.85 WHEN 'room_area' THEN 0.80 WHEN 'egress_travel_distance' THEN 0.75 ELSE 0 END AS minimum FROM x)
SELECT measurement_id, type, round(c, 6) AS confidence, round(c, 6) < minimum AS needs_attention,
 (q = 'raster' AND type = 'egress_travel_distance') OR (q = 'low_quality_scan' AND type <> 'distance') AS disabled FROM y""")
def confidence_gate(t: Tables):
    trace = F.array(1 - F.col("l_discount"), 1 - F.col("l_tax"), F.lit(0.97))
    quality = a.pick(CLASSES, F.col("l_suppkey"))
    rows = t.lineitem.select(
        row_id().alias("measurement_id"), a.pick(TYPES, F.col("l_linenumber")).alias("type"), F.round(m.compose_confidence(trace, quality), 6).alias("confidence"), quality.alias("q"))
    return gate_confidence(rows).select("measurement_id", "type", "confidence", "needs_attention", m.is_disabled(F.col("type"), F.col("q")).alias("disabled"))


SQL_OVER = """ac AS (SELECT event_id AS action_id, event_id * 7 % 2000 AS measurement_id, value AS new_value, user_id AS reviewer_id, ts AS created_at FROM events WHERE event_type = 'click'),
me AS (SELECT p_partkey AS measurement_id, p_retailprice AS value, 0.8 AS confidence FROM part)"""


def overrides(t: Tables):
    actions = t.events.filter(F.col("event_type") == "click").select(
        F.col("event_id").alias("action_id"), (F.col("event_id") * 7 % 2000).alias("measurement_id"), F.col("value").alias("new_value"), F.col("user_id").alias("reviewer_id"), F.col("ts").alias("created_at"))
    measures = t.part.select(F.col("p_partkey").alias("measurement_id"), F.col("p_retailprice").alias("value"), F.lit(0.8).alias("confidence"))
    return measures, actions


@query("L10 E1", f"""WITH {SQL_OVER}, n AS (SELECT measurement_id, arg_max(new_value, (created_at, action_id)) AS new_value, count(*) AS k FROM ac GROUP BY 1)
SELECT measurement_id, value AS original_value, coalesce(new_value, value) AS value, CASE WHEN new_value IS NOT NULL THEN 1.0 ELSE confidence END::DOUBLE AS confidence, coalesce(k, 0) AS n_overrides FROM me LEFT JOIN n USING (measurement_id)""")
def apply_overrides(t: Tables):
    return m.apply_overrides(*overrides(t))


@query("L10", f"""WITH {SQL_OVER}, w AS (SELECT *, lag(new_value) OVER (PARTITION BY measurement_id ORDER BY created_at, action_id) AS before FROM ac)
SELECT w.measurement_id, action_id, reviewer_id, coalesce(before, value) AS old_value, new_value FROM w JOIN me USING (measurement_id)""")
def override_history(t: Tables):
    measures, actions = overrides(t)
    return m.override_history(actions, measures).drop("created_at")


# fitted value at i = max over j <= i of min over k >= i of the weighted mean of points j..k
SQL_ISOTONIC = """WITH r AS (SELECT l.doc_id, (d.n_chars % 1000) / 1000 AS c, l.quality AS kept FROM labels l JOIN documents d USING (doc_id)),
p AS (SELECT row_number() OVER (ORDER BY c) AS i, c, w, s FROM (SELECT c, count(*) AS w, sum(kept) AS s FROM r GROUP BY c)),
u AS (SELECT i, c, w, s, sum(w) OVER (ORDER BY i) AS wu, sum(s) OVER (ORDER BY i) AS su FROM p),
m AS (SELECT a.i AS j, b.i AS k, (b.su - a.su + a.s)::DOUBLE / (b.wu - a.wu + a.w) AS mean FROM u a JOIN u b ON a.i <= b.i),
f AS (SELECT k, max(least_after) AS fit FROM (SELECT j, k, min(mean) OVER (PARTITION BY j ORDER BY k DESC) AS least_after FROM m) GROUP BY k)
SELECT r.doc_id, r.c AS confidence, round(f.fit, 6) AS recalibrated FROM r JOIN p ON r.c = p.c JOIN f ON f.k = p.i"""


@query("L11", SQL_ISOTONIC)
def isotonic_recalibration(t: Tables):
    """Confidence is read from the document length, correctness from its label."""
    rows = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").select(
        "doc_id", (F.col("n_chars") % 1000 / 1000).alias("confidence"), F.col("quality").alias("kept"))
    fit = m.recalibrate(rows)
    return m.recalibrated(rows, fit).select("doc_id", "confidence", F.round("prediction", 6).alias("recalibrated"))


@query("D18", """SELECT l_suppkey AS floor, sum(ceil(l_quantity * 100 / f.factor))::BIGINT AS occupants, count(*) AS rooms
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN (SELECT p_type AS use, min(p_size) * 10 + 15 AS factor FROM part GROUP BY 1) f ON f.use = p_type GROUP BY 1""")
def occupant_load(t: Tables):
    factors = t.part.groupBy(F.col("p_type").alias("use")).agg((F.min("p_size") * 10 + 15).alias("factor"))
    rooms = t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("use")), "l_partkey").select(
        F.col("l_suppkey").alias("floor"), "use", (F.col("l_quantity") * 100).alias("area_sqft"))
    return m.occupant_load(rooms, factors, ["floor"])


@query("D19", """SELECT l_returnflag AS type, round(avg(abs(l_quantity - p_size)), 6) AS mae, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1""")
def measurement_error(t: Tables):
    measured = t.lineitem.select("l_partkey", F.col("l_returnflag").alias("type"), F.col("l_quantity").alias("value"))
    truth = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("value"))
    return m.measurement_error(measured, truth, ["l_partkey"]).withColumn("mae", F.round("mae", 6))


@query("D21", """SELECT page_id, CASE WHEN s >= 0.9 THEN 'vector' WHEN s >= 0.3 THEN 'hybrid' WHEN page_id % 200 < 100 THEN 'low_quality_scan' ELSE 'raster' END AS quality
FROM (SELECT page_id, length(regexp_replace(html, '<[^>]*>', '', 'g'))::DOUBLE / length(html) AS s FROM pages)""")
def page_quality(t: Tables):
    share = F.length(F.regexp_replace("html", "<[^>]*>", "")) / F.length("html")
    return t.pages.select("page_id", m.pdf_class(share, F.col("page_id") % 200).alias("quality"))


@query("D23", """SELECT l_orderkey AS sheet_id, round(sum(l_quantity) / max(l_extendedprice), 8) AS ratio, sum(l_quantity) / max(l_extendedprice) >= CASE WHEN bool_or(l_linestatus = 'O') THEN 1.0 / 300 ELSE 1.0 / 150 END AS ok FROM lineitem GROUP BY 1""")
def attic_ratio(t: Tables):
    rows = t.lineitem.select(F.col("l_orderkey").alias("sheet_id"), F.col("l_quantity").alias("vent_sqft"), F.col("l_extendedprice").alias("attic_sqft"), (F.col("l_linestatus") == "O").alias("balanced"))
    return m.attic_ratio(rows, ["sheet_id"]).select("sheet_id", F.round("ratio", 8).alias("ratio"), "ok")
