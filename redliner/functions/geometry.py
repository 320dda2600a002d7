"""Drawing scales, dimension strings, boxes and polygons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from redliner.functions.text import let

ZERO_BOX = (0.0, 0.0, 0.0, 0.0)


def box(*xs: Column | float) -> Column:
    return F.array(*[(x if isinstance(x, Column) else F.lit(x)).cast("double") for x in xs])


def zero_box() -> Column:
    return box(*ZERO_BOX)


def is_zero_box(b: Column) -> Column:
    return b == zero_box()


# feet, whole inches, and a fraction of an inch; every part may be missing
DIMENSION = (
    r"^\s*(?:(\d+(?:\.\d+)?)\s*(?:'|ft)[\s-]*)?"
    r"(?:(\d+(?:\.\d+)?)(?=\s+\d+\s*/|\s*(?:\"|in)))?\s*"
    r"(?:(\d+)\s*/\s*(\d+)\s*(?:\"|in))?[\s\S]*$"
)


def parse_dimension(c: Column) -> Column:
    """Architectural length to inches: ``24'-6 1/2"``, ``24ft-6in``, ``24.5'``, ``5/8"``; null if unreadable."""
    text = F.translate(c, "’′”″", "''\"\"")
    # one pass of the pattern writes the four parts, which are then plain numbers
    parts = F.transform(F.split(F.regexp_replace(text, DIMENSION, "$1|$2|$3|$4"), r"\|"), lambda p: p.try_cast("double"))

    def inches(p: Column) -> Column:
        feet, whole, over, under = (F.get(p, F.lit(i)) for i in range(4))
        part = F.try_divide(over, under)
        total = F.coalesce(feet, F.lit(0.0)) * 12.0 + F.coalesce(whole, F.lit(0.0)) + F.coalesce(part, F.lit(0.0))
        return F.when(F.coalesce(feet, whole, part).isNotNull(), total)

    return let(parts, inches)


def parse_scale(c: Column) -> Column:
    """``1/4" = 1'-0"`` -> 48.0: real inches per drawn inch, null if unreadable."""
    sides = F.transform(F.split(c, "=", 2), lambda side: parse_dimension(F.btrim(side)))
    return let(sides, lambda s: F.try_divide(F.get(s, F.lit(1)), F.get(s, F.lit(0))))


def feet_inches(inches: Column) -> Column:
    """Display form of a length stored in inches."""
    feet = F.floor(inches / 12)
    return F.format_string("%d'-%s\"", feet, F.format_number(inches - feet * 12, 1))


def square_feet(square_inches: Column) -> Column:
    return square_inches / 144.0


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def polygon_area(points: Column) -> Column:
    """Shoelace area of an array of (x, y) structs in ring order."""
    following = F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))
    cross = F.zip_with(points, following, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.when(F.size(points) >= 3, F.abs(F.aggregate(cross, F.lit(0.0), lambda a, v: a + v)) / 2.0)


def polygon_diagonal(points: Column) -> Column:
    """Diagonal of the bounding rectangle."""
    xs = F.transform(points, lambda p: p["x"])
    ys = F.transform(points, lambda p: p["y"])
    return distance(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def boxes_union(boxes: Column) -> Column:
    """Smallest box around all non-zero boxes of an array, null when none is left."""
    real = F.filter(boxes, lambda b: b.isNotNull() & ~is_zero_box(b))

    def side(i: int) -> Column:
        return F.transform(real, lambda b: b[i])

    whole = F.array(F.array_min(side(0)), F.array_min(side(1)), F.array_max(side(2)), F.array_max(side(3)))
    return F.when(F.size(real) > 0, whole)


def mean_nonzero(values: Column) -> Column:
    """Mean of the positive members, 0 when there is none."""
    good = F.filter(values, lambda v: v > 0)
    total = F.aggregate(good, F.lit(0.0), lambda a, v: a + v)
    return F.when(F.size(good) > 0, total / F.size(good)).otherwise(F.lit(0.0))


def is_locatable(b: Column) -> Column:
    """A box wide or tall enough to show."""
    return b.isNotNull() & ((b[2] - b[0] > 1) | (b[3] - b[1] > 1))


def composed_confidence(parts: Column, cap: float = 0.99, floor: float = 0.30) -> Column:
    """Product of sub-layer confidences, capped and floored."""
    product = F.aggregate(parts, F.lit(1.0), lambda a, v: a * v)
    return F.least(F.lit(cap), F.greatest(F.lit(floor), product))
