"""Largest distance between points of a group, by convex hulls that merge.

The farthest two points are corners of the convex hull, and the hull of a union is
the hull of the hulls' corners. Every task keeps a running hull of each group that
it meets and passes on its corners; these meet by group and part, once more as
hulls, and a last task per group reads the corners as a stream that it folds into
one hull, whose opposite corners rotating calipers visit in one turn. No list of a
group's points is formed anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: points that a running hull gathers before it is reduced, and points that a task holds in all
GATHERED, HELD = 2_000, 200_000
#: parts in which the hulls of a group meet before they meet all together
PARTS = 16
#: points up to which a group is compared as it is
FEW = 16


def corners(p: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of points (n, 2), counter-clockwise; points on an edge are left out."""
    p = np.unique(p, axis=0)
    if len(p) > 64:
        # what lies within the octagon of the outermost points in eight directions is no corner
        x, y = p[:, 0], p[:, 1]
        outer = p[[f.argmax() for f in (x, x + y, y, y - x, -x, -x - y, -y, x - y)]]
        within = np.ones(len(p), bool)
        for a, b in zip(outer, np.roll(outer, -1, axis=0)):
            if (a != b).any():
                within &= (b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) > 0
        p = p[~within]
    if len(p) < 3:
        return p
    chain: list[tuple[float, float]] = []
    for sweep in (p.tolist(), p[::-1].tolist()):
        start = len(chain)
        for q in sweep:
            while len(chain) - start >= 2:
                (ax, ay), (bx, by) = chain[-2], chain[-1]
                if (bx - ax) * (q[1] - ay) - (by - ay) * (q[0] - ax) > 0:
                    break
                chain.pop()
            chain.append((q[0], q[1]))
        chain.pop()
    return np.array(chain)


def diameter(hull: np.ndarray) -> float:
    """Largest distance between corners of a hull, by rotating calipers."""
    n = len(hull)
    if n < 4:
        return float(np.sqrt(((hull[:, None] - hull[None]) ** 2).sum(-1).max()))
    points, best, j = hull.tolist(), 0.0, 1
    for i in range(n):
        (ax, ay), (bx, by) = points[i], points[(i + 1) % n]
        while True:
            (cx, cy), (dx, dy) = points[j], points[(j + 1) % n]
            best = max(best, (ax - cx) ** 2 + (ay - cy) ** 2, (bx - cx) ** 2 + (by - cy) ** 2)
            # the next corner is as far from the edge or farther
            if (bx - ax) * (dy - cy) - (by - ay) * (dx - cx) < 0 or j == i:
                break
            best = max(best, (ax - dx) ** 2 + (ay - dy) ** 2, (bx - dx) ** 2 + (by - dy) ** 2)
            j = (j + 1) % n
        if j == i:
            j = (j + 1) % n
    return float(np.sqrt(best))


def _sorted(batch: pa.RecordBatch, keys: list[str]) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    """The rows of a batch group by group, their points, and the bounds of the groups."""
    code = batch.select(keys).to_pandas().groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
    order = np.argsort(code, kind="stable")
    points = np.column_stack([batch.column(batch.num_columns - 2).to_numpy(), batch.column(batch.num_columns - 1).to_numpy()])[order]
    bounds = np.flatnonzero(np.concatenate([[True], np.diff(code[order]) > 0, [True]]))
    return batch.take(pa.array(order)), points, bounds


def _name(batch: pa.RecordBatch, keys: list[str], row: int) -> tuple:
    return tuple(batch.column(k)[row].as_py() for k in range(len(keys)))


def _rows(keys: list[str], schema: pa.Schema, held: dict[tuple, np.ndarray]) -> pa.RecordBatch:
    counts = [len(p) for p in held.values()]
    columns = [pa.array([v for name, c in zip(held, counts) for v in [name[k]] * c], schema.field(k).type) for k in range(len(keys))]
    points = np.concatenate(list(held.values()))
    return pa.RecordBatch.from_arrays([*columns, pa.array(points[:, 0]), pa.array(points[:, 1])], names=[*keys, "x", "y"])


def _partial(keys: list[str]):
    """Corners of the hulls of a task's groups.

    A group with few points in a batch passes through as it is; the hulls of the
    others are held, and passed on early when the task holds too much.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        schema, total = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            schema = batch.schema
            rows, points, bounds = _sorted(batch, keys)
            size = np.diff(bounds)
            few = np.repeat(size <= FEW, size)
            yield pa.RecordBatch.from_arrays(rows.filter(pa.array(few)).columns, names=[*keys, "x", "y"])
            for a, b in zip(bounds[:-1][size > FEW].tolist(), bounds[1:][size > FEW].tolist()):
                name = _name(rows, keys, a)
                old = held.get(name, points[:0])
                held[name] = corners(np.concatenate([old, points[a:b]]))
                total += len(held[name]) - len(old)
            if total > HELD:
                yield _rows(keys, schema, held)
                held, total = {}, 0
        if held:
            yield _rows(keys, schema, held)

    return run


def _final(keys: list[str]):
    """The diameter of each group; rows come sorted by key, so one group at most goes on into the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, gathered, schema = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            schema = batch.schema
            rows, points, bounds = _sorted(batch, keys)
            size, best = np.diff(bounds), np.zeros(len(bounds) - 1)
            # small groups at once, each row against the d-th one behind it
            group = np.repeat(np.arange(len(size)), size)
            small = size <= FEW
            for d in range(1, min(FEW, int(size.max()))):
                pair = np.flatnonzero((group[d:] == group[:-d]) & small[group[d:]])
                np.maximum.at(best, group[pair], ((points[pair] - points[pair + d]) ** 2).sum(1))
            best = np.sqrt(best)
            done = []
            for k in sorted({0, len(size) - 1, *np.flatnonzero(~small).tolist()}):
                mine = _name(rows, keys, int(bounds[k]))
                if mine != name:
                    if gathered:
                        done.append((name, diameter(corners(np.concatenate(gathered)))))
                    name, gathered = mine, []
                gathered.append(points[bounds[k]:bounds[k + 1]])
                if sum(map(len, gathered)) > GATHERED:
                    gathered = [corners(np.concatenate(gathered))]
            inner = small.copy()
            inner[[0, -1]] = False
            at = pa.array(bounds[:-1][inner])
            yield pa.RecordBatch.from_arrays([*(rows.column(k).take(at) for k in range(len(keys))), pa.array(best[inner])], names=[*keys, "farthest"])
            if done:
                yield _answers(schema, keys, done)
        if gathered:
            yield _answers(schema, keys, [(name, diameter(corners(np.concatenate(gathered))))])

    return run


def _answers(schema: pa.Schema, keys: list[str], out: list[tuple[tuple, float]]) -> pa.RecordBatch:
    columns = [pa.array([n[k] for n, _ in out], schema.field(k).type) for k in range(len(keys))]
    return pa.RecordBatch.from_arrays([*columns, pa.array([d for _, d in out], pa.float64())], names=[*keys, "farthest"])


def farthest_pair(points: DataFrame, keys: list[str]) -> DataFrame:
    """Largest distance between two points of each group; 0 for a single point.

    Points with a null or non-finite coordinate are left out; repeated points
    count once; null keys are a group of their own.
    """
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    own = points.select(*keys, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).filter(finite("x") & finite("y"))
    name = ", ".join(f"`{k}` {own.schema[k].dataType.simpleString()}" for k in keys)
    hulls = own.mapInArrow(_partial(keys), f"{name}, x double, y double")
    parted = hulls.repartition(*keys, F.pmod(F.xxhash64("x", "y"), F.lit(PARTS)))
    hulls = parted.mapInArrow(_partial(keys), f"{name}, x double, y double")
    return hulls.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_final(keys), f"{name}, farthest double")
