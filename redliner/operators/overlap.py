"""Box overlap tests on a sheet, without forming a pair of boxes.

The y coordinates of a sheet are ranked, so that a box spans a range of whole
numbers and two spans meet exactly if the open intervals do, whatever the
precision of the coordinates. A span is cut into dyadic cells that it holds;
around them are cells that it fills in part. Two boxes meet in y exactly if one
of them holds a cell that the other holds or fills in part. Within a cell the
question is one of intervals on the x axis, which running maxima of right edges
answer in one ordered scan. A box has at most 2 log2(h) + 2 rows of each kind
when h different y coordinates lie in its height, and none beyond the level of
the tallest box.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redliner.operators import dyadic
from redliner.operators.scan import every, following, next_value, ordered_scan, position, running_max
from redliner.session import durable, growing


def _spans(boxes: DataFrame, sheet: Sequence[str], width: int) -> tuple[DataFrame, int]:
    """Boxes with positive sides and their spans ``low`` to ``high`` of ranks; the highest level of a cell that one holds."""
    solid = boxes.filter("x1 < x2 and y1 < y2")
    ys = solid.select(*sheet, F.explode(F.array("y1", "y2")).alias("__y")).distinct()
    ranks = ordered_scan(ys, sheet, [F.col("__y")], every(F.col("__y"), width), {"__rank": position()})
    for edge, name in (("y1", "low"), ("y2", "high")):
        solid = solid.join(ranks.select(*sheet, F.col("__y").alias(edge), F.col("__rank").alias(name)), [*sheet, edge])
    spans = durable(solid)
    tallest = spans.agg(F.max(F.col("high") - F.col("low"))).first()[0]
    return spans, (tallest or 1).bit_length() - 1


def _cells(spans: DataFrame, top: int) -> DataFrame:
    """One row per cell that a box holds (``hold``) or fills in part."""
    low, high = F.col("low"), F.col("high")
    return dyadic.cover(spans, low, high).withColumn("hold", F.lit(True)).unionByName(dyadic.partly(spans, low, high, top).withColumn("hold", F.lit(False))).drop("low", "high")


def _held(value: Column) -> Column:
    return F.when(F.col("hold"), value)


def overlapping(boxes: DataFrame, sheet: Sequence[str], box_id: str, width: int = 1000) -> DataFrame:
    """Boxes that overlap another box of the same sheet.

    Input columns: the sheet keys, ``box_id`` and x1, y1, x2, y2. Copies of one
    box overlap each other; boxes that touch do not overlap, and boxes without
    extent or with a null coordinate overlap nothing. Output: sheet keys and
    ``box_id``, one row per box.
    """
    corner = [*sheet, "x1", "y1"]
    solid = boxes.filter("x1 < x2 and y1 < y2")
    for key in sheet:
        solid = solid.filter(F.col(key).isNotNull())
    # boxes of one height and left edge are to the rest the one that reaches farthest
    kinds = durable(solid.groupBy(*corner, "y2").agg(F.max("x2").alias("x2"), F.count(F.lit(1)).alias("copies")))
    # boxes of one corner overlap each other; only one that is alone at its corner has to ask
    alone = durable(kinds.groupBy(*corner).agg(F.sum("copies").alias("n")).filter("n = 1").withColumn("alone", F.lit(True)).drop("n"))
    near = kinds.drop("copies").join(growing(alone.select(*sheet).distinct()), list(sheet), "left_semi").join(growing(alone), corner, "left")
    spans, top = _spans(near, sheet, width)
    cell = [*sheet, "level", "cell"]
    asked = _cells(spans.filter("alone"), top).select(*cell, "x1", "x2", "y1", "hold", F.col("x2").alias("far"), _held(F.col("x2")).alias("far_held"))
    # of those that need not ask, one row stands for all of a cell and left edge
    given = _cells(spans.filter("alone is null"), top).groupBy(*cell, "x1").agg(F.max("x2").alias("far"), F.max(_held(F.col("x2"))).alias("far_held"))
    both = ordered_scan(
        asked.unionByName(given, allowMissingColumns=True), cell, [F.col("x1"), F.col("far"), F.col("y1")], every(F.col("x1"), width),
        {"reach": running_max(F.col("far"), inclusive=False), "reach_held": running_max(F.col("far_held"), inclusive=False),
         "start": next_value(F.col("x1")), "start_held": following(F.when(F.col("far_held").isNotNull(), F.col("x1")))},
    ).filter(F.col("hold").isNotNull())
    # one that only fills a cell in part meets those that hold it
    reach, start = F.when(F.col("hold"), F.col("reach")).otherwise(F.col("reach_held")), F.when(F.col("hold"), F.col("start")).otherwise(F.col("start_held"))
    touched = (reach > F.col("x1")) | (start < F.col("x2"))
    hit = both.filter(F.coalesce(touched, F.lit(False))).select(*corner).distinct()
    free = alone.drop("alone").join(growing(hit), corner, "left_anti")
    return solid.join(growing(free), corner, "left_anti").select(*sheet, box_id)


#: boxes of a sheet whose two sides are compared pair by pair
SMALL_SHEET = 256


def overlaps_any(
    left: DataFrame, right: DataFrame, sheet: Sequence[str], left_id: str, right_id: str, width: int = 1000,
) -> DataFrame:
    """Left boxes that overlap at least one right box of the same sheet.

    ``right_id`` of the output names one such box: among those that start left
    of the tested box's right edge, the one that reaches furthest right (greatest
    id on ties). A point is a box of positive size. Sheets of at most
    ``SMALL_SHEET`` boxes are compared pair by pair, so that a box meets a bounded
    number of others and moves once; the rest goes through cells.
    """
    sheet, corners = list(sheet), ["x1", "y1", "x2", "y2"]
    left = left.filter("x1 < x2 and y1 < y2").select(*sheet, *corners, left_id)
    right = right.filter("x1 < x2 and y1 < y2").select(*sheet, *corners, F.col(right_id).alias("__box"))
    sides = left.select(*sheet, F.lit(0).alias("__side")).unionByName(right.select(*sheet, F.lit(1).alias("__side")))
    sizes = sides.groupBy(*sheet).agg(F.count(F.lit(1)).alias("n"), F.sum("__side").alias("given")).filter("given > 0 and given < n")
    sizes = durable(sizes.select(*sheet, (F.col("n") > SMALL_SHEET).alias("__busy")))
    busy, answer = sizes.filter("__busy").drop("__busy"), [*sheet, left_id, F.col("best")["id"].alias(right_id)]
    if busy.isEmpty():
        return _pairwise(left, right, sheet, left_id).select(*answer)
    many = _by_cells(*[side.join(busy, sheet, "left_semi") for side in (left, right)], sheet, left_id, width).select(*answer)
    if sizes.filter("not __busy").isEmpty():
        return many
    # written, so that the boxes of a busy sheet are dropped before the others are laid together by sheet
    few = [durable(side.join(busy, sheet, "left_anti")) for side in (left, right)]
    return _pairwise(*few, sheet, left_id).select(*answer).unionByName(many)


def _pairwise(left: DataFrame, right: DataFrame, sheet: list[str], left_id: str) -> DataFrame:
    """The farthest box for each left id, from all pairs of a sheet."""
    given = right.select(*sheet, *[F.col(c).alias(f"__{c}") for c in ("x1", "y1", "x2", "y2")], "__box")
    pairs = left.join(growing(given), sheet).filter("__x1 < x2 and __x2 > x1 and __y1 < y2 and __y2 > y1")
    # a pair lies by its sheet, where the ids of a sheet lie as well
    return pairs.groupBy(*sheet, left_id).agg(F.max(F.struct(F.col("__x2").alias("reach"), F.col("__box").alias("id"))).alias("best"))


def _by_cells(left: DataFrame, right: DataFrame, sheet: list[str], left_id: str, width: int) -> DataFrame:
    """The same for sheets of any size, without forming a pair."""
    corners = ["x1", "y1", "x2", "y2"]
    none = F.lit(None).cast(right.schema["__box"].dataType)
    # equal boxes ask once; of boxes of one height and left edge only the one that reaches farthest can be an answer
    asked = left.select(*sheet, *corners).distinct().select("*", none.alias("__box"), F.lit(0).alias("__side"))
    given = right.groupBy(*sheet, "x1", "y1", "y2").agg(F.max(F.struct("x2", "__box")).alias("__far")).select(
        *sheet, "x1", "y1", F.col("__far")["x2"].alias("x2"), "y2", F.col("__far")["__box"].alias("__box"), F.lit(1).alias("__side"))
    spans, _ = _spans(durable(asked.unionByName(given)), sheet, width)
    tallest = dict(spans.groupBy("__side").agg(F.max(F.col("high") - F.col("low"))).collect())
    # a box fills in part only cells that one of the other side is tall enough to hold
    ask, give = (_cells(spans.filter(F.col("__side") == i), tallest.get(1 - i, 1).bit_length() - 1) for i in (0, 1))
    cell, reach = [*sheet, "level", "cell"], F.struct(F.col("x2").alias("reach"), F.col("__box").alias("id"))
    # a left box asks at its own right edge, before any box that starts there
    ask = ask.select(*cell, "hold", *corners, "__side", F.col("x2").alias("__at"))
    give = give.select(*cell, "hold", "__side", F.col("x1").alias("__at"), reach.alias("__r"))
    scanned = ordered_scan(
        ask.unionByName(give, allowMissingColumns=True), cell, [F.col("__at"), F.col("__side")], every(F.col("__at"), width),
        {"best": running_max(F.col("__r")), "best_held": running_max(_held(F.col("__r")))},
    )
    found = scanned.filter("__side = 0").withColumn("best", F.when(F.col("hold"), F.col("best")).otherwise(F.col("best_held")))
    answers = found.filter(F.col("best")["reach"] > F.col("x1")).groupBy(*sheet, *corners).agg(F.max("best").alias("best"))
    # an id that occurs once has its answer; equal hashes of different ids only mean more rows to group
    key = F.xxhash64(*sheet, left_id)
    repeated = durable(left.groupBy(key.alias("__key")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("__key"))

    def answered(rows: DataFrame) -> DataFrame:
        return rows.join(growing(answers), [*sheet, *corners]).select(*sheet, left_id, "best")

    if repeated.isEmpty():
        return answered(left)
    keyed = left.withColumn("__key", key)
    once, more = (keyed.join(repeated, "__key", how) for how in ("left_anti", "left_semi"))
    return answered(once).unionByName(answered(more).groupBy(*sheet, left_id).agg(F.max("best").alias("best")))
