"""Scale-safe operators against brute force on small frames, hot groups included."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from redliner.operators import scan
from redliner.operators.asof import asof_join, nearest_join, validity_intervals
from redliner.operators.keyed import latest_per_key, majority, outliers
from redliner.operators.matching import Tier, tiered_assignment
from redliner.operators import hull
from redliner.operators.overlap import overlapping, overlaps_any
from redliner.operators.routing import shortest_to_sources
from redliner.plans import measure


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def hot(spark):
    rng = random.Random(3)
    rows = [(0 if rng.random() < 0.5 else rng.randrange(6), rng.randrange(200), i, rng.randrange(9) if rng.random() < 0.7 else None) for i in range(600)]
    return spark.createDataFrame(rows, "k long, t long, id long, v long").cache()


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_scan_equals_window(spark, hot, width):
    w = Window.partitionBy("k").orderBy("t", "id")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    want = hot.select(
        "k", "t", "id", F.row_number().over(w).cast("long").alias("n"), F.coalesce(F.sum("v").over(upto), F.lit(0)).alias("s"),
        F.coalesce(F.sum("v").over(before), F.lit(0)).alias("sx"), F.max("v").over(upto).alias("m"),
        F.last("v", True).over(upto).alias("l"), F.last("v", True).over(before).alias("lx"))
    got = scan.ordered_scan(hot, ["k"], [F.col("t"), F.col("id")], scan.every(F.col("t"), width), {
        "n": scan.position(), "s": scan.running_sum(F.col("v")), "sx": scan.running_sum(F.col("v"), False), "m": scan.running_max(F.col("v")),
        "l": scan.last_value(F.col("v")), "lx": scan.last_value(F.col("v"), False)})
    assert rows_of(got.drop("v")) == rows_of(want)


def test_scan_without_keys(spark, hot):
    got = scan.ordered_scan(hot, [], [F.col("t"), F.col("id")], scan.every(F.col("t"), 20), {"n": scan.position()})
    assert sorted(r["n"] for r in got.collect()) == list(range(1, 601))


def test_paged_keeps_every_row_once_and_in_order(spark, hot):
    pages = scan.paged(hot, ["k"], [F.col("t"), F.col("id")], scan.every(F.col("t"), 30), F.col("id"), 50).orderBy("k", "part").collect()
    assert max(len(p["items"]) for p in pages) <= 50
    seen = {}
    for p in pages:
        seen.setdefault(p["k"], []).extend(p["items"])
    want = {}
    for r in hot.orderBy("t", "id").collect():
        want.setdefault(r["k"], []).append(r["id"])
    assert seen == want


@pytest.mark.parametrize("inclusive", [True, False])
def test_asof_equals_brute_force(spark, hot, inclusive):
    right = hot.filter("id % 4 = 0").select("k", "t", F.col("id").alias("rid"), F.col("v").alias("rv"))
    left = hot.filter("id % 4 <> 0").select("k", "t", "id")
    got = asof_join(left, right, ["k"], F.col("t"), F.col("t"), ["rid", "rv"], lambda at: F.floor(at / 25), inclusive).collect()
    data = right.collect()
    assert len(got) == left.count()
    for r in got:
        best = [(d["t"], d["rid"]) for d in data if d["k"] == r["k"] and (d["t"] <= r["t"] if inclusive else d["t"] < r["t"])]
        assert r["rid"] == (max(best)[1] if best else None)


def test_nearest_equals_brute_force(spark, hot):
    left = hot.filter("id % 3 = 0").select("k", "id", (F.col("t") * 1.0).alias("at"))
    right = hot.filter("id % 3 = 1").select("k", F.col("id").alias("rid"), (F.col("t") * 1.0).alias("pos"))
    data = right.collect()
    for r in nearest_join(left, right, ["k"], "at", "pos", ["pos", "rid"], 40.0).collect():
        best = [(abs(d["pos"] - r["at"]), d["pos"], d["rid"]) for d in data if d["k"] == r["k"]]
        assert r["rid"] == (min(best)[2] if best else None)


def test_validity(spark):
    v = spark.createDataFrame([("a", "2020-01-01"), ("a", "2022-01-01"), ("a", "2022-01-01"), ("b", "2021-01-01")], "k string, d string").withColumn("d", F.to_date("d"))
    out = {(r["k"], str(r["d"])): r["valid_to"] and str(r["valid_to"]) for r in validity_intervals(v, ["k"], "d", lambda s: F.floor(s / 86400)).collect()}
    assert out == {("a", "2020-01-01"): "2022-01-01", ("a", "2022-01-01"): None, ("b", "2021-01-01"): None}


def _boxes(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        s, x, y = (0 if rng.random() < 0.4 else rng.randrange(4)), rng.randrange(60), rng.randrange(60)
        out.append((s, i, float(x), float(y), float(x + rng.randrange(1, 9)), float(y + rng.randrange(1, 9))))
    return out + [(9, n, 1.0, 1.0, 2.0, 2.0), (9, n + 1, 1.0, 1.0, 2.0, 2.0), (9, n + 2, 2.0, 1.0, 3.0, 2.0)]


def _meet(a, b):
    return a[0] == b[0] and a[2] < b[4] and a[4] > b[2] and a[3] < b[5] and a[5] > b[3]


@pytest.mark.parametrize("width", [5, 1000])
def test_overlap_equals_brute_force(spark, width):
    data = _boxes(160, 5)
    df = spark.createDataFrame(data, "s long, id long, x1 double, y1 double, x2 double, y2 double")
    want = sorted((a[0], a[1]) for a in data if any(_meet(a, b) for b in data if b[1] != a[1]))
    assert sorted(map(tuple, overlapping(df, ["s"], "id", width=width).collect())) == want


@pytest.mark.parametrize("width", [5, 1000])
def test_overlaps_any_equals_brute_force(spark, width):
    left, right = _boxes(120, 6), _boxes(90, 7)
    schema = "s long, {} long, x1 double, y1 double, x2 double, y2 double"
    got = overlaps_any(spark.createDataFrame(left, schema.format("a")), spark.createDataFrame(right, schema.format("b")), ["s"], "a", "b", width=width).collect()
    assert sorted(r["a"] for r in got) == sorted(a[1] for a in left if any(_meet(a, b) for b in right))
    by_id = {b[1]: b for b in right}
    lefts = {a[1]: a for a in left}
    assert all(_meet(lefts[r["a"]], by_id[r["b"]]) for r in got)


def test_farthest_pair_equals_brute_force(spark):
    rng = random.Random(1)
    pts = [(s, float(rng.randrange(300)), float(rng.randrange(300))) for s in (0,) * 500 + (1,) * 7 + (2,)]
    got = {r["s"]: r["farthest"] for r in hull.farthest_pair(spark.createDataFrame(pts, "s long, x double, y double"), ["s"]).collect()}
    for s in (0, 1, 2):
        own = [p for p in pts if p[0] == s]
        assert got[s] == pytest.approx(max(math.dist(p[1:], q[1:]) for p in own for q in own))


def test_farthest_pair_on_a_line(spark):
    pts = [(0, float(i), float(2 * i)) for i in range(200)]
    got = hull.farthest_pair(spark.createDataFrame(pts, "s long, x double, y double"), ["s"]).first()["farthest"]
    assert got == pytest.approx(math.dist((0, 0), (199, 398)))


def test_routing(spark):
    edges = spark.createDataFrame([("s", 1, 2, 4.0), ("s", 2, 3, 1.0), ("s", 1, 3, 9.0), ("s", 5, 6, 1.0), ("u", 1, 2, 7.0)], "sheet string, a long, b long, length double")
    exits = spark.createDataFrame([("s", 1), ("u", 2)], "sheet string, node long")
    assert rows_of(shortest_to_sources(edges, exits, ["sheet"])) == [("s", 1, 0.0), ("s", 2, 4.0), ("s", 3, 5.0), ("u", 1, 7.0), ("u", 2, 0.0)]
    wrong = spark.createDataFrame([("s", 1, 2, -1.0)], "sheet string, a long, b long, length double")
    with pytest.raises(ValueError):
        shortest_to_sources(wrong, exits, ["sheet"])


def test_paths_of_any_length_are_solved(spark):
    chain = spark.createDataFrame([("s", i, i + 1, 1.0) for i in range(70)], "sheet string, a long, b long, length double").coalesce(1)
    reach = shortest_to_sources(chain, spark.createDataFrame([("s", 0)], "sheet string, node long"), ["sheet"])
    assert reach.agg({"distance": "max"}).first()[0] == 70.0


def test_assignment_is_one_to_one_and_takes_the_strongest_tier(spark):
    left = spark.createDataFrame([(i, 1, "a" if i % 2 else "b") for i in range(40)], "l long, p long, s string")
    right = spark.createDataFrame([(i, 1, "a") for i in range(25)], "r long, p long, s string")
    got = tiered_assignment(left, right, [Tier("both", ("p", "s")), Tier("p", ("p",))], "l", "r", 10).collect()
    assert len({g["l"] for g in got}) == len({g["r"] for g in got}) == len(got) == 25
    assert sum(g["tier"] == "both" for g in got) == 20


def test_latest_and_majority(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 3, "z"), ("b", 1, "w"), ("a", 2, "x")], "k string, t long, v string")
    assert rows_of(latest_per_key(df, ["k"], [F.col("t"), F.col("v")])) == [("a", 3, "z"), ("b", 1, "w")]
    assert majority(df, ["k"], "v").filter("k = 'a'").first()["majority_value"] == "x"
    assert {r["v"] for r in outliers(df, ["k"], "v").collect()} == {"y", "z"}


def test_plans_have_no_cross_join_and_no_global_window(spark, hot):
    plan = scan.ordered_scan(hot, ["k"], [F.col("t"), F.col("id")], scan.every(F.col("t"), 50), {"n": scan.position()})._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_dyadic_cells_meet_exactly_where_a_number_lies_in_a_range(spark):
    from redliner.operators import dyadic

    ranges = [(lo, hi) for lo in range(18) for hi in range(18)]
    cut = dyadic.cover(spark.createDataFrame(ranges, "lo long, hi long"), F.col("lo"), F.col("hi"))
    number = dyadic.around(spark.range(20), F.col("id"), 5)
    got = [tuple(r) for r in cut.join(number, ["level", "cell"]).select("lo", "hi", "id").collect()]
    assert sorted(got) == sorted((lo, hi, n) for lo, hi in ranges for n in range(20) if lo <= n < hi)
    assert max(r["n"] for r in cut.groupBy("lo", "hi").agg(F.count("*").alias("n")).collect()) <= 2 * 5


def test_amendments_of_one_section_over_ten_thousand_days(spark):
    from datetime import date, timedelta

    from redliner.plans import codekb

    rng, start = random.Random(3), date(1995, 1, 1)
    kinds = ["append", "insert_before", "insert_after", "append", "replace", "override"]
    made = []
    for k in range(200):
        since = start + timedelta(days=rng.randrange(9_000))
        made.append((k, "CBC-1", "state", rng.choice(kinds), f"am {k}", rng.randrange(40), since, since + timedelta(days=rng.randrange(1, 900)) if rng.random() < 0.7 else None))
    amendments = spark.createDataFrame(made, "amendment_id long, canonical_id string, jurisdiction string, operation string, amendment_text string, ordinal long, effective_date date, closes_at date")
    days = [start + timedelta(days=d - 500) for d in range(10_000)]
    keys = spark.createDataFrame([("CBC-1", "state", d) for d in days] + [("CBC-2", "state", start)], "canonical_id string, jurisdiction string, as_of date")
    held = codekb.segments(keys, amendments)
    live = codekb.amendments_in_force(held, amendments)
    assert held.select("canonical_id", "since").distinct().count() <= 2 + 2 * 200
    # one row per interval and amendment in force, none that a filter would drop
    assert live.filter("effective_date > since or closes_at <= since").isEmpty()
    folded = codekb.folded_fragments(keys, keys.withColumn("body_text", F.lit("base")), amendments)
    got = {}
    for r in folded.select("canonical_id", "as_of", "pos", "fragment").collect():
        got.setdefault((r["canonical_id"], r["as_of"]), []).append((r["pos"], r["fragment"]))
    assert got["CBC-2", start] == [(0, "base")] and len(got) == 10_001
    for day in days[::7]:
        core, before, after, n = "base", [], [], 0
        for _, _, k, kind in sorted((m[5], m[6], m[0], m[3]) for m in made if m[6] <= day and (m[7] is None or m[7] > day)):
            n = 0 if kind in ("replace", "override") else n + 1
            if n == 0:
                core, before, after = f"am {k}", [], []
            elif kind == "insert_before":
                before.insert(0, f"am {k}")
            else:
                after.append(f"am {k}")
        assert [f for _, f in sorted(got["CBC-1", day])] == [*before, core, *after]


@pytest.mark.parametrize("width", [0.1, 1000])
def test_overlap_of_real_coordinates_equals_brute_force(spark, width):
    rng = random.Random(8)

    def box(k):
        s, x, y = rng.choice([0, 0, 0, 1]), rng.random(), rng.random() - 0.5
        return s, k, x, y, x + rng.random() * 0.1, y + rng.random() ** 4
    left, right = [box(k) for k in range(150)], [box(k) for k in range(60)]
    left += [(7, 900, 0.0, 0.2, 1.0, 0.4), (7, 901, 0.0, 0.6, 1.0, 0.8), (8, 902, 0.0, 0.2, 1.0, 0.4), (8, 903, 0.5, 0.4, 1.0, 0.5), (8, 904, None, 0.1, 1.0, 0.9), (8, 905, 0.2, 0.3, 0.2, 0.9)]
    schema = "s long, {} long, x1 double, y1 double, x2 double, y2 double"
    a, b = spark.createDataFrame(left, schema.format("a")), spark.createDataFrame(right, schema.format("b"))
    solid = [x for x in left if x[2] is not None and x[2] < x[4]]
    want = sorted((x[0], x[1]) for x in solid if any(_meet(x, y) for y in solid if y[1] != x[1]))
    assert sorted(map(tuple, overlapping(a, ["s"], "a", width=width).collect())) == want
    assert not {900, 901, 902, 903, 904, 905} & {k for _, k in want}
    assert sorted(r["a"] for r in overlaps_any(a, b, ["s"], "a", "b", width=width).collect()) == sorted(x[1] for x in solid if any(_meet(x, y) for y in right))


def test_rows_per_box_grow_with_the_logarithm_of_its_height(spark):
    from redliner.operators.overlap import _cells, _spans

    boxes = spark.range(2_000).select(F.lit(1).alias("s"), "id", F.lit(0.0).alias("x1"), F.lit(1.0).alias("x2"), (F.col("id") / 7).alias("y1"), (F.col("id") / 7 + 1 + F.col("id") % 90).alias("y2"))
    spans, top = _spans(boxes, ["s"], 100)
    per_box = _cells(spans, top).groupBy("id", "hold").count().join(spans, "id")
    assert per_box.filter(F.col("hold") & (F.col("count") > 2 * F.log2(F.col("high") - F.col("low")) + 2)).isEmpty()
    assert per_box.filter(~F.col("hold") & (F.col("count") > 2 * (top + 1))).isEmpty()


def test_hull_and_calipers_equal_brute_force():
    import numpy as np

    rng = np.random.default_rng(4)
    shapes = [rng.random((n, 2)) for n in (1, 2, 3, 4, 5, 70, 900)] + [rng.integers(0, 4, (60, 2)).astype(float) for _ in range(40)]
    turn = np.linspace(0, 2 * np.pi, 301)
    shapes += [np.column_stack([np.cos(turn), np.sin(turn)]), np.zeros((9, 2)), np.column_stack([np.arange(80.0), np.zeros(80)]), np.array([[0.0, 0], [4, 0], [4, 3], [0, 3]])]
    for p in shapes:
        want = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1).max())
        assert abs(hull.diameter(hull.corners(p)) - want) <= 1e-12 * max(want, 1)


def test_farthest_pair_of_groups_over_many_batches(spark):
    rng = random.Random(6)
    sizes = [1, 2, 15, 16, 17, 40, 3, 3, 1, 200, 16, 5]
    points = [(s % 3, s, rng.random(), rng.random()) for s, n in enumerate(sizes) for _ in range(n)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        found = hull.farthest_pair(spark.createDataFrame(points, "a long, s long, x double, y double"), ["a", "s"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == len(sizes)
    for r in found:
        own = [p[2:] for p in points if p[1] == r["s"]]
        assert r["a"] == r["s"] % 3 and r["farthest"] == pytest.approx(max(math.dist(p, q) for p in own for q in own), abs=1e-12)


def test_farthest_pair_of_a_hundred_thousand_points_of_one_sheet(spark):
    points = spark.range(100_000).select(F.lit("s").alias("s"), (F.sin(F.col("id") * 12.9898) * F.cos(F.col("id") * 0.37)).alias("x"), F.cos(F.col("id") * 78.233).alias("y"))
    extra = spark.createDataFrame([("s", -7.25, 0.5), ("s", 6.5, -0.125), ("one", 1.0, 1.0), (None, 0.0, 0.0), (None, 3.0, 4.0), ("bad", None, 1.0), ("bad", float("nan"), 1.0)], "s string, x double, y double")
    found = hull.farthest_pair(points.union(extra), ["s"])
    plan = found._jdf.queryExecution().toString()
    assert "collect_list" not in plan
    assert {r["s"]: r["farthest"] for r in found.collect()} == {"s": (13.75 ** 2 + 0.625 ** 2) ** 0.5, "one": 0.0, None: 5.0}


def test_equi_depth_chunks_of_hot_keys_and_ties(spark):
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 10 < 9, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 30)).alias("service"),
        F.when(F.col("id") % 10 < 9, F.lit(0.5)).otherwise(F.col("id") / 20_000).alias("confidence"), F.xxhash64("id").alias("row"))
    order = [F.col("confidence"), F.col("row")]
    cut = scan.equi_depth(rows, ["service"], order, parts=16)
    sizes = [r["count"] for r in cut.groupBy(scan.DEPTH).count().collect()]
    assert sum(sizes) == 20_000 and len(sizes) >= 14 and max(sizes) < 2 * 20_000 / 16
    inside = Window.partitionBy("service").orderBy(*order)
    steps = {"n": scan.position(), "total": scan.running_sum(F.col("row") % 7), "before": scan.last_value(F.col("row"), inclusive=False), "after": scan.next_value(F.col("row")),
             "later": scan.following(F.when(F.col("row") % 5 == 0, F.col("row")))}
    got = scan.ordered_scan(cut, ["service"], order, F.col(scan.DEPTH), steps).drop(scan.DEPTH)
    want = rows.select("*", F.row_number().over(inside).cast("long").alias("n"), F.sum(F.col("row") % 7).over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("total"),
                       F.lag("row").over(inside).alias("before"), F.lead("row").over(inside).alias("after"), F.lit(None).cast("long").alias("later"))
    assert got.drop("later").exceptAll(want.drop("later")).isEmpty() and got.count() == 20_000
    # the first later row with a value, by a plain join of positions
    marked = got.filter("row % 5 = 0").select(F.col("service").alias("s"), F.col("n").alias("m"), "row").withColumnRenamed("row", "value")
    nearest = got.join(marked, (F.col("service") == F.col("s")) & (F.col("m") > F.col("n")) & (F.col("m") <= F.col("n") + 200), "left").groupBy("service", "n").agg(
        F.first("later").alias("later"), F.min_by("value", "m").alias("value"))
    assert nearest.filter("not later <=> value").isEmpty()


def test_scan_without_a_chunk(spark):
    rows = spark.createDataFrame([("a", k % 7, k) for k in range(50)], "g string, o long, id long")
    got = scan.ordered_scan(rows, ["g"], [F.col("o"), F.col("id")], None, {"n": scan.position()})
    assert got.columns == ["g", "o", "id", "n"]
    assert [r["id"] for r in got.orderBy("n").collect()] == sorted(range(50), key=lambda k: (k % 7, k))


def test_nearest_place_equals_brute_force(spark):
    from redliner.operators.nearest import nearest_place

    rng = random.Random(9)
    places = [(0, f"e{k}", rng.gauss(0, 1), rng.gauss(0, 1)) for k in range(40)] + [(1, "only", 5.0, 5.0), (1, "twin", 5.0, 5.0), (4, "bad", None, 1.0), (5, "line1", 0.0, 0.0), (5, "line2", 10.0, 0.0)]
    points = [(0, k, rng.gauss(0, 3), rng.gauss(0, 3)) for k in range(400)] + [(0, 900, 1e6, -1e6), (0, 901, None, 0.0), (1, 1, 5.0, 5.0), (1, 2, -1e5, 0.0), (2, 1, 0.0, 0.0), (4, 1, 0.0, 0.0), (5, 1, 5.0, 0.0), (5, 2, 4.0, 3.0)]
    found = nearest_place(spark.createDataFrame(points, "s long, p long, x double, y double"), spark.createDataFrame(places, "s long, e string, x double, y double"), ["s"], "p", "e")
    got = {(r["s"], r["p"]): (r["e"], r["distance"]) for r in found.collect()}
    assert len(got) == len(points)
    for s, p, x, y in points:
        near = min(((math.sqrt((x - a) ** 2 + (y - b) ** 2), e) for t, e, a, b in places if t == s and a is not None), default=None) if x is not None else None
        e, d = got[s, p]
        assert (near is None and e is None and d is None) or (e == near[1] and d == pytest.approx(near[0], rel=1e-12))
    empty = spark.createDataFrame([], "s long, e string, x double, y double")
    assert nearest_place(spark.createDataFrame(points, "s long, p long, x double, y double"), empty, ["s"], "p", "e").filter("e is not null or distance is not null").isEmpty()


def test_month_from_hourly_sketches_within_the_stated_errors(spark):
    from redliner.operators import sketches

    rows = spark.range(60_000).select(
        (F.col("id") % 3).alias("k"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 30).alias("ts"), (F.pow(F.rand(3), 4) * 100_000).cast("long").alias("v"), (F.col("id") * 7 % 9_000).alias("m"))
    rows = rows.union(spark.createDataFrame([(9, None, None, None), (9, None, None, None)], "k long, ts timestamp, v long, m long")).cache()
    stored = sketches.hourly(rows, ["k"], "ts", "v", "m")
    # a late batch of the same hours stands in rows of its own
    twice = stored.union(sketches.hourly(rows.filter("v % 10 = 0"), ["k"], "ts", "v", "m"))
    both = rows.union(rows.filter("v % 10 = 0"))
    for kept, raw in ((stored, rows), (twice, both)):
        for r in sketches.over(kept, ["k"], F.lit(1), quantiles=(0.1, 0.5, 0.99)).collect():
            own = [x["v"] for x in raw.filter(F.col("k") == r["k"]).select("v").collect()]
            assert r["n"] == len(own)
            if r["k"] == 9:
                assert r["p99"] is None and r["distinct"] == 0
                continue
            for q in (0.1, 0.5, 0.99):
                at = r[f"p{round(q * 100)}"]
                assert sum(v < at for v in own) <= (q + sketches.RANK_ERROR) * len(own) and sum(v <= at for v in own) >= (q - sketches.RANK_ERROR) * len(own)
            want = raw.filter(F.col("k") == r["k"]).select("m").distinct().count()
            assert abs(r["distinct"] - want) <= sketches.COUNT_ERROR * want
    rows.unpersist()


def test_near_values_equal_brute_force(spark):
    from redliner.operators.fuzzy import near_values

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randrange(7)))
    left, right = [(str(rng.randrange(2)), word()) for _ in range(120)], [(str(rng.randrange(2)), word()) for _ in range(90)]
    for distance in (1, 2):
        got = near_values(spark.createDataFrame([*left, (None, "a"), ("1", None)], "b string, v string"), spark.createDataFrame([*right, (None, "a")], "b string, v string"), "b", "v", distance)
        want = {(b, v, w, edits(v, w)) for b, v in left for c, w in right if b == c and edits(v, w) <= distance}
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_projects_by_streets_with_dropped_and_transposed_letters(spark):
    from redliner.plans import ops

    schema = "id long, jurisdiction string, permit_number string, apn string, address string"
    projects = spark.createDataFrame([(1, "SR", "B1", "A1", "2008 Dennis Ln"), (2, "SR", "B2", "A2", "2008 Mission Blvd"), (3, "SR", "B3", "A3", "120 Dennis Ln")], schema).withColumnRenamed("id", "project_id")
    asked = [(1, "2008 Dnenis Lane"), (2, "2008 Misson Boulevard"), (3, "2008 Wandering Way"), (4, "120 Dennis Lane"), (5, None), (6, "130 Dennis Ln"), (7, "2008 Enis Ln")]
    submitted = spark.createDataFrame([(k, "SR", None, None, a) for k, a in asked], schema)
    got = {r["id"]: (r["project_id"], r["matched_by"]) for r in ops.match_project_near(submitted, projects, "id").collect()}
    assert got[4] == (3, "address") and got[3] == got[5] == got[6] == (None, None)
    assert got[1][0] == 1 and got[2][0] == 2 and got[7] == (1, "near") and {got[1][1], got[2][1]} <= {"near", "sound"}
