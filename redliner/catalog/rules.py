"""Discipline rule queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from redliner.catalog import adapters as a
from redliner.catalog import codekb as code
from redliner.catalog.base import Tables, query
from redliner.functions import review as r
from redliner.plans import findings as fd
from redliner.plans import provenance, rules

LI = "lineitem"


def base(t: Tables):
    """Line items with the shared finding keys."""
    return t.lineitem.select(
        "*", F.col("l_suppkey").alias("project_id"), F.col("l_orderkey").cast("string").alias("sheet_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("rid"),
        (F.lit(1) - F.col("l_discount").cast("decimal(4,2)")).cast("double").alias("confidence"))


SQL_BASE = """b AS (SELECT *, l_suppkey AS project_id, l_orderkey::VARCHAR AS sheet_id, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rid,
  (1 - l_discount::DECIMAL(4,2))::DOUBLE AS confidence FROM lineitem)"""


def windows(t: Tables):
    return base(t).select(
        "project_id", "sheet_id", F.col("rid").alias("window_id"), F.concat(F.lit("W-"), F.col("l_linenumber").cast("string")).alias("tag"),
        F.concat(F.lit("Bedroom "), F.col("l_linenumber").cast("string")).alias("room_label"), F.when(F.col("l_returnflag") != "A", "bedroom").otherwise("kitchen").alias("room_use"),
        (F.col("l_linestatus") == "O").alias("is_new"), (F.col("l_quantity") / 5).alias("nco_sqft"), "confidence", F.lit(0.97).alias("section_confidence"))


@query("M2 ARCH-EGRESS-010 J2 M12", f"""WITH {SQL_BASE} SELECT project_id, sheet_id, rid AS evidence_id, 'revise' AS severity, false AS requires_licensed_review, least(confidence, 0.97)::DOUBLE AS confidence,
  least(confidence, 0.97) < 0.8 AS needs_attention, 'Window W-' || l_linenumber || ' in Bedroom ' || l_linenumber || ' has NCO of ' || printf('%.1f', l_quantity / 5) || ' sqft; CRC §R310.2.1 requires ≥ 5.7 sqft.' AS draft_comment_text
FROM b WHERE l_returnflag <> 'A' AND l_linestatus = 'O' AND l_quantity / 5 < 5.7""")
def egress_window_rule(t: Tables):
    found = rules.BOOK.run({"windows": windows(t)})
    return found.select("project_id", "sheet_id", "evidence_id", "severity", "requires_licensed_review", "confidence", "needs_attention", "draft_comment_text")


@query("M3 M4 M6 M8 M10 M11 M12 ACC-BATH-030 FIRE-SEP-001 B14", f"""WITH {SQL_BASE}
SELECT rule_id, count(*) AS n, min(rid) AS first_evidence, sum(CASE WHEN sev = 'revise' THEN 1 ELSE 0 END)::BIGINT AS n_revise, max(note::INT) AS any_note, false AS licensed FROM (
SELECT 'ARCH-EGRESS-020' AS rule_id, sheet_id AS rid, 'revise' AS sev, false AS note FROM b WHERE l_linenumber = 1 AND l_quantity / 60 < 0.5
UNION ALL SELECT 'ARCH-TRAVEL-DISTANCE', sheet_id, 'revise', false FROM b WHERE l_linenumber = 1 AND l_quantity * 6 > 250
UNION ALL SELECT 'ARCH-SEPARATION-RATING', rid, 'revise', false FROM b WHERE l_linenumber = 2 AND coalesce(CASE WHEN l_tax > 0.02 THEN l_tax * 50 END, 0) < 2.0
UNION ALL SELECT 'ACC-BATH-030', rid, 'revise', false FROM b WHERE l_linenumber = 3 AND l_quantity < 18
UNION ALL SELECT 'ACC-DOOR-WIDTH', rid, 'revise', false FROM b WHERE l_linenumber = 4 AND l_quantity < 32
UNION ALL SELECT 'ACC-REACH-RANGE', rid, 'revise', false FROM b WHERE l_linenumber = 5 AND NOT (l_quantity BETWEEN 15 AND 48)
UNION ALL SELECT 'ACC-SIGNAGE', rid, CASE l_returnflag WHEN 'A' THEN 'provide' ELSE 'revise' END, false FROM b WHERE l_linenumber = 6 AND l_returnflag IN ('A', 'R')
UNION ALL SELECT 'MECH-HOOD-MAKEUP', rid, 'provide', false FROM b WHERE l_linenumber = 7 AND l_quantity * 20 > 400 AND l_linestatus <> 'F'
UNION ALL SELECT 'MECH-BATH-EXHAUST', rid, 'revise', false FROM b WHERE l_linenumber = 3 AND l_returnflag = 'R'
UNION ALL SELECT 'PLUMB-HEATER-HEIGHT', rid, 'revise', false FROM b WHERE l_linenumber = 4 AND l_returnflag = 'A' AND l_quantity < 18 AND l_linestatus <> 'F'
UNION ALL SELECT 'PLUMB-HEATER-STRAP', rid, 'revise', false FROM b WHERE l_linenumber = 4 AND l_partkey % 3 < 2
UNION ALL SELECT 'PLUMB-BACKFLOW', rid, 'provide', false FROM b WHERE l_linenumber = 5 AND l_returnflag = 'N' AND l_linestatus <> 'O'
UNION ALL SELECT 'FIRE-SEP-001', rid, 'revise', true FROM b WHERE l_linenumber = 6 AND (l_tax <= 0.02 OR l_linestatus <> 'O')
UNION ALL SELECT 'FIRE-R21-CONSTRUCTION', project_id::VARCHAR, 'revise', true FROM b WHERE l_linenumber = 7 AND l_returnflag = 'R' AND l_quantity > 6 AND l_linestatus <> 'O'
UNION ALL SELECT 'GREEN-WASTE', project_id::VARCHAR, 'revise', false FROM b WHERE l_linenumber = 2 AND l_quantity * 2 < 65) GROUP BY 1""")
def discipline_row_rules(t: Tables):
    b = base(t)
    n, q = F.col("l_linenumber"), F.col("l_quantity")

    def rows(k, **cols):
        return b.filter(n == k).select("project_id", "sheet_id", "confidence", *[v.alias(c) for c, v in cols.items()])

    flag, status, rid = F.col("l_returnflag"), F.col("l_linestatus"), F.col("rid")
    context = {
        "floors": rows(1, exit_distance_ft=q, diagonal_ft=F.lit(60.0), travel_ft=q * 6, travel_limit_ft=F.lit(250.0)),
        "separations": rows(2, separation_id=rid, occupancy_a=F.lit("R-2.1"), occupancy_b=F.lit("R-3"), provided_hours=F.when(F.col("l_tax") > 0.02, F.col("l_tax") * 50), required_hours=F.lit(2.0)),
        "clearances": rows(3, clearance_id=rid, side_clearance_in=q),
        "doors": rows(4, door_id=rid, tag=rid, clear_width_in=q),
        "controls": rows(5, control_id=rid, height_in=q),
        "signs": rows(6, sign_id=rid, state=F.when(flag == "A", "missing").when(flag == "R", "incorrect").otherwise("ok")),
        "hoods": rows(7, hood_id=rid, cfm=q * 20, has_makeup_air=status == "F"),
        "exhausts": rows(3, exhaust_id=rid, terminates=F.when(flag == "R", "attic").otherwise("outside")),
        "water_heaters": rows(4, heater_id=rid, in_garage=flag == "A", height_in=q, fvir_listed=status == "F", straps=F.col("l_partkey") % 3),
        "water_services": rows(5, service_id=rid, needs_backflow=flag == "N", has_backflow=status == "O"),
        "separation_doors": rows(6, door_id=rid, rating_min=F.when(F.col("l_tax") > 0.02, 45), self_closing=status == "O"),
        "care_facilities": rows(7, occupancy=F.when(flag == "R", "R-2.1").otherwise("R-3"), occupants=q.cast("int"), construction_type=F.when(status == "O", "VA").otherwise("VB")),
        "waste_plans": rows(2, diversion_pct=q * 2),
    }
    found = rules.BOOK.run(context)
    return found.groupBy("rule_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("evidence_id").alias("first_evidence"), F.count_if(F.col("severity") == "revise").alias("n_revise"),
        F.max(F.col("advisory_licensed_note").cast("int")).alias("any_note"), F.max("requires_licensed_review").alias("licensed"))


@query("M4 C14 ACC-TURNING-005", """WITH b AS (SELECT l_suppkey AS project_id, (l_orderkey % 200)::VARCHAR AS sheet_id, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rid, (l_partkey % 100 * 8)::DOUBLE AS x, (l_orderkey % 90 * 9)::DOUBLE AS y, l_returnflag FROM lineitem)
SELECT s.project_id, s.sheet_id, s.rid AS evidence_id FROM b s WHERE s.l_returnflag = 'R' AND EXISTS (SELECT 1 FROM b d WHERE d.l_returnflag = 'A' AND d.project_id = s.project_id AND d.sheet_id = s.sheet_id
  AND d.x < s.x + 60 AND d.x + 36 > s.x AND d.y < s.y + 60 AND d.y + 36 > s.y)""")
def turning_space_rule(t: Tables):
    x, y = (F.col("l_partkey") % 100 * 8).cast("double"), (F.col("l_orderkey") % 90 * 9).cast("double")

    def boxes(flag, name, size):
        return t.lineitem.filter(F.col("l_returnflag") == flag).select(
            F.col("l_suppkey").alias("project_id"), (F.col("l_orderkey") % 200).cast("string").alias("sheet_id"),
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias(name), x.alias("x1"), y.alias("y1"), (x + size).alias("x2"), (y + size).alias("y2"))

    found = rules.BOOK.run({"turning_spaces": boxes("R", "space_id", 60), "door_swings": boxes("A", "door_id", 36)})
    return found.select("project_id", "sheet_id", "evidence_id")


@query("M5 STR-SHEAR-001 STR-HOLDOWN-005", f"""WITH {SQL_BASE}, w AS (SELECT DISTINCT project_id, sheet_id, l_linenumber AS wall_id, unnest(['left', 'right']) AS wall_end FROM b WHERE l_returnflag = 'N'),
h AS (SELECT DISTINCT project_id, sheet_id, l_linenumber AS wall_id, CASE WHEN l_partkey % 2 = 0 THEN 'left' ELSE 'right' END AS wall_end FROM b WHERE l_linestatus = 'F'),
c AS (SELECT DISTINCT project_id, l_partkey % 300 AS tag FROM b WHERE l_returnflag = 'R'), s AS (SELECT DISTINCT p_partkey % 100 AS project_id, p_size * 5 AS tag FROM part)
SELECT 'STR-HOLDOWN-005' AS rule_id, project_id, sheet_id, wall_id || '/' || wall_end AS evidence_id, 'provide' AS severity FROM w ANTI JOIN h USING (project_id, sheet_id, wall_id, wall_end)
UNION ALL SELECT 'STR-SHEAR-001', project_id, NULL, tag::VARCHAR, 'provide' FROM c ANTI JOIN s USING (project_id, tag)
UNION ALL SELECT 'STR-SCHEDULE-ORPHAN', project_id, NULL, tag::VARCHAR, 'clarify' FROM s ANTI JOIN c USING (project_id, tag)""")
def structural_rules(t: Tables):
    b = base(t)
    ends = b.filter(F.col("l_returnflag") == "N").select("project_id", "sheet_id", F.col("l_linenumber").alias("wall_id"), F.explode(F.array(F.lit("left"), F.lit("right"))).alias("wall_end")).distinct()
    held = b.filter(F.col("l_linestatus") == "F").select("project_id", "sheet_id", F.col("l_linenumber").alias("wall_id"), F.when(F.col("l_partkey") % 2 == 0, "left").otherwise("right").alias("wall_end"))
    callouts = b.filter(F.col("l_returnflag") == "R").select("project_id", (F.col("l_partkey") % 300).alias("tag"), F.lit("2x10").alias("size"))
    schedule = t.part.select((F.col("p_partkey") % 100).alias("project_id"), (F.col("p_size") * 5).cast("long").alias("tag"), F.lit("2x10").alias("size"))
    found = rules.BOOK.run({"wall_ends": ends, "holdowns": held, "shear_callouts": callouts, "shear_schedule": schedule})
    return found.select("rule_id", "project_id", "sheet_id", "evidence_id", "severity")


@query("M6 MECH-OCCUPANCY-001", """WITH o AS (SELECT l_orderkey AS p, count(DISTINCT l_returnflag) AS k FROM lineitem GROUP BY 1), u AS (SELECT l_orderkey AS p, count(DISTINCT l_suppkey % 3) AS m FROM lineitem GROUP BY 1)
SELECT p AS project_id, k || ' occupancies are served by ' || m || ' HVAC units; each needs its own.' AS draft_comment_text FROM o JOIN u USING (p) WHERE k > 1 AND m < k""")
def hvac_rule(t: Tables):
    uses = t.lineitem.select(F.col("l_orderkey").alias("project_id"), F.col("l_returnflag").alias("occupancy"))
    units = t.lineitem.select(F.col("l_orderkey").alias("project_id"), (F.col("l_suppkey") % 3).alias("unit_id"), F.col("l_linenumber").cast("string").alias("sheet_id"))
    return rules.BOOK.run({"occupancies": uses, "hvac_units": units}).select("project_id", "draft_comment_text")


@query("M7", """WITH r AS (SELECT p_partkey AS room_id, (['bathroom','bedroom','kitchen','living','garage'])[p_partkey % 5 + 1] AS u FROM part),
n AS (SELECT room_id, u, unnest(CASE u WHEN 'bathroom' THEN ['gfci_receptacle','dedicated_20a_circuit','switched_light'] WHEN 'bedroom' THEN ['afci_protection','switched_light']
  WHEN 'kitchen' THEN ['gfci_receptacle','switched_light'] WHEN 'living' THEN ['afci_protection','switched_light'] ELSE [] END) AS item FROM r),
h AS (SELECT DISTINCT l_partkey AS room_id, (['gfci_receptacle','switched_light','afci_protection','dedicated_20a_circuit'])[l_suppkey % 4 + 1] AS item FROM lineitem WHERE l_quantity > 40)
SELECT room_id || '/' || item AS evidence_id, CASE item WHEN 'afci_protection' THEN 'revise' ELSE 'provide' END AS severity FROM n ANTI JOIN h USING (room_id, item)""")
def electrical_rule(t: Tables):
    rooms = t.part.select(F.lit(1).alias("project_id"), F.lit("E-1").alias("sheet_id"), F.col("p_partkey").alias("room_id"), a.pick(["bathroom", "bedroom", "kitchen", "living", "garage"], F.col("p_partkey")).alias("room_use"))
    items = t.lineitem.filter(F.col("l_quantity") > 40).select(
        F.col("l_partkey").alias("room_id"), a.pick(["gfci_receptacle", "switched_light", "afci_protection", "dedicated_20a_circuit"], F.col("l_suppkey")).alias("item"))
    return rules.BOOK.run({"rooms": rooms, "room_items": items}).select("evidence_id", "severity")


@query("M8 D22", """WITH l AS (SELECT l_suppkey AS project_id, floor(sum(l_quantity) / 10)::BIGINT AS occ FROM lineitem GROUP BY 1),
n AS (SELECT project_id, 'water_closet' AS kind, ceil(occ / 25)::BIGINT AS required FROM l UNION ALL SELECT project_id, 'lavatory', ceil(occ / 40)::BIGINT FROM l UNION ALL SELECT project_id, 'drinking_fountain', ceil(occ / 100)::BIGINT FROM l),
h AS (SELECT l_suppkey AS project_id, (['water_closet', 'lavatory', 'drinking_fountain'])[l_linenumber % 3 + 1] AS kind, count(*) AS provided FROM lineitem WHERE l_quantity > 48 GROUP BY 1, 2)
SELECT project_id, kind AS evidence_id, coalesce(provided, 0) || ' of ' || required || ' required fixtures (' || kind || ') are shown.' AS draft_comment_text FROM n LEFT JOIN h USING (project_id, kind) WHERE coalesce(provided, 0) < required""")
def fixture_count_rule(t: Tables):
    loads = t.lineitem.groupBy(F.col("l_suppkey").alias("project_id")).agg(F.floor(F.sum("l_quantity") / 10).cast("long").alias("occupants"))
    fixtures = t.lineitem.filter(F.col("l_quantity") > 48).select(F.col("l_suppkey").alias("project_id"), a.pick(["water_closet", "lavatory", "drinking_fountain"], F.col("l_linenumber")).alias("kind"))
    return rules.BOOK.run({"occupant_loads": loads, "fixtures": fixtures}).select("project_id", "evidence_id", "draft_comment_text")


@query("M9 M10 M11 ENERGY-PATH-001", """WITH c AS (SELECT o_custkey AS p, min(CASE o_orderpriority WHEN '1-URGENT' THEN 'R-2.1' WHEN '2-HIGH' THEN 'R-2' END) AS occ FROM orders GROUP BY 1),
h AS (SELECT DISTINCT o_custkey AS p, o_orderpriority AS m FROM orders WHERE o_orderstatus = 'F'), k AS (SELECT DISTINCT o_custkey AS p, o_orderpriority AS m FROM orders WHERE o_orderstatus = 'O'),
g AS (SELECT c_custkey AS p, unnest(CASE c_custkey % 3 WHEN 0 THEN ['4.106.4.1', '4.303', '4.408', '4.410'] WHEN 1 THEN ['4.106.4.2', '4.303', '4.408', '4.410'] ELSE [] END) AS s FROM customer),
gs AS (SELECT DISTINCT o_custkey AS p, (['4.106.4.1', '4.303', '4.408', '4.410'])[o_orderkey % 4 + 1] AS s FROM orders)
SELECT 'ENERGY-PATH-001' AS rule_id, c_custkey AS project_id, 'doc' || c_custkey AS evidence_id FROM customer JOIN c ON c.p = c_custkey WHERE c_mktsegment = 'BUILDING' AND c.occ IS NOT NULL
UNION ALL SELECT 'ENERGY-HERS-NOTE', p, m FROM h ANTI JOIN k USING (p, m)
UNION ALL SELECT 'FIRE-DEFERRED-NOTE', p, m FROM (SELECT DISTINCT o_custkey AS p, o_orderpriority AS m FROM orders WHERE o_orderstatus = 'P') ANTI JOIN k USING (p, m)
UNION ALL SELECT 'GREEN-MANDATORY', p, s FROM g ANTI JOIN gs USING (p, s)""")
def energy_fire_green_rules(t: Tables):
    o = t.orders.withColumnRenamed("o_custkey", "project_id")
    pr = F.col("o_orderpriority")
    occupancy = F.when(pr == "1-URGENT", "R-2.1").when(pr == "2-HIGH", "R-2").otherwise("R-3")
    c = F.col("c_custkey")

    def measures(status):
        return o.filter(F.col("o_orderstatus") == status).select("project_id", pr.alias("measure")).distinct()

    context = {
        "filed_paths": t.customer.select(c.alias("project_id"), F.lit("T24").alias("sheet_id"), F.concat(F.lit("doc"), c.cast("string")).alias("document_id"),
                                         F.when(F.col("c_mktsegment") == "BUILDING", "single_family").otherwise("multifamily").alias("path")),
        "occupancy_claims": o.select("project_id", occupancy.alias("occupancy")),
        "hers_measures": measures("F"), "plan_notes": measures("O"), "deferred_items": measures("P"),
        "dwellings": t.customer.select(c.alias("project_id"), F.when(c % 3 == 0, "sfr").when(c % 3 == 1, "multifamily").alias("dwelling")),
        "green_measures": o.select("project_id", a.pick(["4.106.4.1", "4.303", "4.408", "4.410"], F.col("o_orderkey")).alias("section")),
    }
    return rules.BOOK.run(context).select("rule_id", "project_id", "evidence_id")


@query("C19 M12 H28", f"""WITH {SQL_BASE}, th AS (SELECT p_type AS type, 'ARCH-' || p_type AS rule_id, CASE WHEN min(p_partkey) % 2 = 0 THEN '>=' ELSE '<=' END AS cmp, max(p_size)::DOUBLE / 2 AS lim FROM part GROUP BY 1)
SELECT b.rid AS evidence_id, rule_id, 'Measured ' || printf('%.1f', l_quantity) || '; CBC §1010.1 requires ' || cmp || ' ' || printf('%.1f', lim) || '.' AS draft_comment_text
FROM b JOIN part ON p_partkey = l_partkey JOIN th ON th.type = p_type WHERE CASE cmp WHEN '>=' THEN l_quantity < lim ELSE l_quantity > lim END""")
def threshold_rules(t: Tables):
    kinds = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("type"))
    facts = base(t).join(kinds, "l_partkey").select("project_id", "sheet_id", F.col("rid").alias("fact_id"), "type", F.col("l_quantity").alias("value"), "confidence")
    thresholds = t.part.groupBy(F.col("p_type").alias("type")).agg(
        F.when(F.min("p_partkey") % 2 == 0, ">=").otherwise("<=").alias("comparison"), (F.max("p_size") / 2).alias("threshold"),
    ).withColumns({"rule_id": F.concat(F.lit("ARCH-"), F.col("type")), "citation": F.lit("CBC-1010.1")})
    return rules.threshold_findings(facts, thresholds).select("evidence_id", "rule_id", "draft_comment_text")


@query("B14 B15 H18 M13", f"""WITH {SQL_BASE}, c AS (SELECT rid, project_id, {a.sql_pick(r.CRITICAL_PATH_RULES + ['ARCH-EGRESS-010', 'PI-ADDR-001', 'FIRE-SEP-001'], 'l_partkey')} AS rule_id, confidence FROM b),
f AS (SELECT rid FROM b WHERE l_returnflag = 'R')
SELECT rid, rule_id, rule_id NOT IN ('ARCH-EGRESS-010', 'PI-ADDR-001', 'FIRE-SEP-001') AS licensed, rule_id IN ('ARCH-EGRESS-010', 'PI-ADDR-001', 'FIRE-SEP-001') AS auto_ok,
  CASE WHEN rule_id NOT IN ('ARCH-EGRESS-010', 'PI-ADDR-001', 'FIRE-SEP-001') OR confidence < 0.7 THEN 'escalation' ELSE 'primary' END AS role FROM c WHERE rid NOT IN (SELECT rid FROM f)""")
def licensed_flag(t: Tables):
    ids = r.CRITICAL_PATH_RULES + ["ARCH-EGRESS-010", "PI-ADDR-001", "FIRE-SEP-001"]
    b = base(t)
    cases = b.select("rid", a.pick(ids, F.col("l_partkey")).alias("rule_id"), "confidence")
    rest = fd.undecided(cases, b.filter(F.col("l_returnflag") == "R").select("rid"), ["rid"])
    licensed = r.needs_license(F.col("rule_id"))
    return rest.select("rid", "rule_id", licensed.alias("licensed"), r.may_auto_approve(licensed).alias("auto_ok"), "role")


@query("M6 D23 MECH-ATTIC-VENT", """WITH a AS (SELECT p_partkey % 100 AS project_id, p_partkey::VARCHAR AS sheet_id, p_size / (p_partkey % 4000 + 1000)::DOUBLE AS ratio FROM part)
SELECT 'MECH-ATTIC-VENT' AS rule_id, project_id, sheet_id, 'revise' AS severity FROM a WHERE ratio < 1 / 150""")
def attic_vent_rule(t: Tables):
    k = F.col("p_partkey")
    ratio = F.col("p_size") / (k % 4000 + 1000).cast("double")
    attics = t.part.select((k % 100).alias("project_id"), k.cast("string").alias("sheet_id"), ratio.alias("ratio"), (ratio >= 1 / 150).alias("ok"))
    return rules.BOOK.run({"attics": attics}).select("rule_id", "project_id", "sheet_id", "severity")


@query("M5 C8 STR-SIZE-CONFLICT", """WITH c AS (SELECT DISTINCT l_suppkey AS project_id, l_partkey % 100 AS tag, '2x' || (10 + 2 * (l_linenumber % 3)) AS size FROM lineitem),
s AS (SELECT DISTINCT p_partkey % 100 AS project_id, p_size AS tag, '2x' || (10 + 2 * (p_partkey % 2)) AS size FROM part), k AS (SELECT DISTINCT project_id, tag FROM s)
SELECT 'STR-SIZE-CONFLICT' AS rule_id, project_id, tag::VARCHAR AS evidence_id, 'revise' AS severity, count(*) AS n FROM c SEMI JOIN k USING (project_id, tag) ANTI JOIN s USING (project_id, tag, size) GROUP BY 1, 2, 3, 4""")
def size_conflicts(t: Tables):
    """Callouts whose size no row of the schedule has; the licensed engineer is named in a note."""
    callouts = t.lineitem.select(F.col("l_suppkey").alias("project_id"), (F.col("l_partkey") % 100).alias("tag"), F.concat(F.lit("2x"), (10 + 2 * (F.col("l_linenumber") % 3)).cast("string")).alias("size"))
    schedule = t.part.select((F.col("p_partkey") % 100).alias("project_id"), F.col("p_size").cast("long").alias("tag"), F.concat(F.lit("2x"), (10 + 2 * (F.col("p_partkey") % 2)).cast("string")).alias("size"))
    found = rules.BOOK.run({"shear_callouts": callouts, "shear_schedule": schedule}).filter("advisory_licensed_note")
    return found.groupBy("rule_id", "project_id", "evidence_id", "severity").agg(F.count(F.lit(1)).alias("n"))


SQL_REVIEWED = """sub AS (SELECT o_custkey AS project_id, max((o_orderkey % 5 + 1, o_orderkey)) AS k FROM orders GROUP BY 1),
cur AS (SELECT project_id, k[1] AS review_round, o_orderkey AS submittal_id, o_custkey % 200 AS canonical_id, o_orderpriority AS jurisdiction, o_orderdate::DATE AS as_of FROM sub JOIN orders ON o_orderkey = k[2]),
best AS (SELECT l_orderkey, l_linenumber, min((-(1 - l_discount::DECIMAL(4,2))::DOUBLE, 'm-' || rid)) AS m, arg_min((l_quantity / 5, l_returnflag, l_tax), (-(1 - l_discount::DECIMAL(4,2))::DOUBLE, 'm-' || rid)) AS v FROM li GROUP BY 1, 2),
hit AS (SELECT rid, li.l_orderkey, li.l_linenumber, o_custkey AS project_id, -m[1] AS conf, m[2] AS measurement_id, v[1] AS nco, v[2] AS trace, CASE WHEN v[3] > 0.04 THEN 'specs:2' ELSE 'specs:1' END AS spec_version,
  CASE l_linestatus WHEN 'F' THEN 'windows:1' ELSE 'windows:2' END AS version, l_linenumber AS y FROM li JOIN orders ON o_orderkey = li.l_orderkey JOIN best USING (l_orderkey, l_linenumber)
  WHERE o_orderstatus <> 'P' AND o_orderkey % 3 <> 0 AND v[1] < 5.7)"""
SQL_CITED = code.SQL_FOLD.replace(code.SQL_LOOKUPS, "q AS (SELECT DISTINCT canonical_id, jurisdiction, as_of FROM cur WHERE project_id IN (SELECT project_id FROM hit))")


@query("M12 M2 ARCH-EGRESS-010 J2 L15", f"""WITH li{SQL_BASE.removeprefix('b')}, {SQL_REVIEWED}, {SQL_CITED},
y AS (SELECT f.*, (row_number() OVER (PARTITION BY canonical_id, jurisdiction, as_of ORDER BY pos) - 1) // 1000 + 1 AS part FROM f WHERE fragment IS NOT NULL),
x AS (SELECT canonical_id, jurisdiction, as_of, part, string_agg(fragment, chr(10) ORDER BY pos) AS txt, coalesce(string_agg(amendment_id::VARCHAR, ',' ORDER BY pos), '') AS applied FROM y GROUP BY 1, 2, 3, 4),
c AS (SELECT b2.canonical_id, b2.jurisdiction, b2.as_of, part, txt, applied, b2.section_id, effective_date FROM b2 JOIN x USING (canonical_id, jurisdiction, as_of) JOIN s ON s.section_id = b2.section_id)
SELECT sha256(concat_ws(chr(31), 'ARCH-EGRESS-010', hit.project_id::VARCHAR, l_orderkey::VARCHAR, rid)) AS finding_id, hit.project_id, submittal_id, review_round::INT AS review_round, l_orderkey::VARCHAR AS sheet_id,
  rid AS entity_id, concat_ws(',', y, y + 1, y + 2, y + 3) AS bbox, measurement_id, nco::DOUBLE AS measured_value, conf AS measured_confidence, trace, coalesce(part, 1)::INT AS part,
  c.jurisdiction, strftime(effective_date, '%Y-%m-%d') AS effective_date, md5(txt) AS frozen_md5, applied AS amendments_applied,
  CASE WHEN section_id IS NOT NULL THEN 'state_section ' || section_id || CASE WHEN applied = '' THEN '' ELSE ',amendment ' || replace(applied, ',', ',amendment ') END END AS retrieval_chain,
  'Window W-' || l_linenumber || ' in Bedroom ' || l_orderkey || ' has NCO of ' || printf('%.1f', nco) || ' sqft; CRC §R310.2.1 requires ≥ 5.7 sqft.' AS draft_comment_text,
  CASE WHEN section_id IS NULL THEN conf ELSE least(conf, 0.97) END::DOUBLE AS confidence, conf < 0.8 OR section_id IS NULL AS needs_attention, strftime(cur.as_of, '%Y-%m-%d') AS created_at, spec_version || ',' || version AS extractor_versions_used
FROM hit JOIN cur ON cur.project_id = hit.project_id LEFT JOIN c ON c.canonical_id = cur.canonical_id AND c.jurisdiction = cur.jurisdiction AND c.as_of = cur.as_of""")
def findings_full(t: Tables):
    k, line = F.col("o_orderkey"), F.col("l_linenumber").cast("double")
    items = base(t)
    context = {
        "rooms": t.orders.select(
            k.alias("room_id"), F.col("o_custkey").alias("project_id"), F.concat(F.lit("Bedroom "), k.cast("string")).alias("room_label"),
            F.when(F.col("o_orderstatus") != "P", "bedroom").otherwise("kitchen").alias("room_use"), (k % 3 != 0).alias("is_new")),
        "windows": items.select(
            F.col("rid").alias("window_id"), F.col("l_orderkey").alias("room_id"), "sheet_id", F.concat(F.lit("W-"), F.col("l_linenumber").cast("string")).alias("tag"),
            F.array(line, line + 1, line + 2, line + 3).alias("bbox"), F.when(F.col("l_linestatus") == "F", "windows:1").otherwise("windows:2").alias("extractor_version")),
        "specs": items.select(
            F.concat(F.lit("m-"), "rid").alias("measurement_id"), "sheet_id", F.concat(F.lit("W-"), F.col("l_linenumber").cast("string")).alias("tag"),
            (F.col("l_quantity") / 5).alias("nco_sqft"), "confidence", F.array("l_returnflag").alias("trace"), F.when(F.col("l_tax") > 0.04, "specs:2").otherwise("specs:1").alias("extractor_version")),
        "submittals": t.orders.select(
            F.col("o_custkey").alias("project_id"), k.alias("submittal_id"), (k % 5 + 1).cast("int").alias("review_round"), (F.col("o_custkey") % 200).alias("canonical_id"),
            F.col("o_orderpriority").alias("jurisdiction"), F.col("o_orderdate").cast("date").alias("as_of"), F.col("o_orderdate").cast("date").alias("created_at")),
        "sections": code.sections(t).withColumn("confidence", F.lit(0.97)), "amendments": code.amendments(t),
    }
    cite = F.get("citations", F.lit(0))
    return provenance.egress_findings(context).select(
        "finding_id", "project_id", "submittal_id", "review_round", "sheet_reference.sheet_id", F.col("evidence")[0]["entity_id"].alias("entity_id"),
        F.array_join(F.transform(F.col("evidence")[0]["bbox"], lambda x: x.cast("int").cast("string")), ",").alias("bbox"), F.col("evidence")[1]["measurement_id"].alias("measurement_id"),
        F.col("evidence")[1]["value"].alias("measured_value"), F.col("evidence")[1]["confidence"].alias("measured_confidence"), F.array_join(F.col("evidence")[1]["trace"], ",").alias("trace"), "part",
        cite["jurisdiction"].alias("jurisdiction"), F.date_format(cite["effective_date"], "yyyy-MM-dd").alias("effective_date"), F.md5(cite["frozen_text"]).alias("frozen_md5"),
        F.array_join(cite["amendments_applied"], ",").alias("amendments_applied"),
        F.array_join(F.transform(cite["retrieval_chain"], lambda s: F.concat_ws(" ", s["kind"], s["ref"])), ",").alias("retrieval_chain"), "draft_comment_text", "confidence", "needs_attention",
        F.date_format("created_at", "yyyy-MM-dd").alias("created_at"), F.array_join("extractor_versions_used", ",").alias("extractor_versions_used"))
