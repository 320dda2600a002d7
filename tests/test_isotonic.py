import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from redliner.operators import isotonic


def pooled(points):
    """Pool adjacent violators over sorted (confidence, weight, sum), in fractions."""
    blocks = []
    for c, w, s in points:
        blocks.append([w, s, [c]])
        while len(blocks) > 1 and Fraction(blocks[-2][1], blocks[-2][0]) >= Fraction(blocks[-1][1], blocks[-1][0]):
            w, s, cs = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w, blocks[-1][1] + s, blocks[-1][2] + cs]
    return {c: s / w for w, s, cs in blocks for c in cs}


def brute(rows):
    sums = {}
    for c, k in rows:
        w, s = sums.get(c, (0, 0))
        sums[c] = (w + 1, s + k)
    return pooled([(c, w, s) for c, (w, s) in sorted(sums.items())])


@pytest.mark.parametrize("shape", ["rising", "falling", "hot", "one"])
def test_fit_equals_pooling(spark, shape):
    rng = random.Random(shape)
    chance = {"rising": lambda c: c, "falling": lambda c: 1 - c, "hot": lambda c: c * c, "one": lambda c: 0.5}[shape]
    draw = {"hot": lambda: 0.25 if rng.random() < 0.8 else rng.random(), "one": lambda: 0.5}.get(shape, lambda: round(rng.random(), 3))
    rows = [(c, int(rng.random() < chance(c))) for c in (draw() for _ in range(3000))]
    frame = spark.createDataFrame([*rows, (None, 1), (0.1, None), (float("nan"), 1)], "confidence double, kept int").repartition(7)
    got = {r["confidence"]: r["fitted"] for r in isotonic.isotonic_fit(frame).collect()}
    want = brute(rows)
    assert got.keys() == want.keys() and all(abs(got[c] - want[c]) < 1e-12 for c in want)


def test_values_between_and_outside(spark):
    frame = spark.createDataFrame([(0.2, 0), (0.4, 1), (0.4, 0), (0.8, 1)], "confidence double, kept int")
    asked = spark.createDataFrame([(c, "x") for c in (0.1, 0.2, 0.3, 0.4, 0.6, 0.8, 0.9, 0.9, None)], "confidence double, c string")
    out = isotonic.isotonic_values(asked, isotonic.isotonic_fit(frame))
    got = sorted(((r["confidence"], round(r["prediction"], 9)) for r in out.filter("confidence is not null").collect()))
    assert got == [(0.1, 0.0), (0.2, 0.0), (0.3, 0.25), (0.4, 0.5), (0.6, 0.75), (0.8, 1.0), (0.9, 1.0), (0.9, 1.0)]
    assert out.filter("confidence is null").first()["prediction"] is None and out.columns == ["confidence", "c", "prediction"]


def test_empty_and_many_different_confidences(spark):
    none = spark.createDataFrame([], "confidence double, kept int")
    assert isotonic.isotonic_fit(none).collect() == []
    many = spark.range(300_000).select((F.col("id") / 300_000).alias("confidence"), (F.pmod(F.xxhash64("id"), F.lit(300_000)) < F.col("id")).cast("int").alias("kept"))
    fit = isotonic.isotonic_fit(many)
    want = brute([(r["confidence"], r["kept"]) for r in many.collect()])
    got = {r["confidence"]: r["fitted"] for r in fit.collect()}
    assert len(got) == 300_000 and all(abs(got[c] - want[c]) < 1e-12 for c in want)
