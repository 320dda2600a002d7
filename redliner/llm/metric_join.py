"""Exact near-duplicate vectors: a metric range join over pivot cells.

On unit vectors, cosine >= c is the same as a distance of at most
r = sqrt(2 - 2c). Every vector lives in the cell of its nearest pivot and visits
the later cells that can hold something within r: by the triangle inequality
d(x, p_j) - d(x, p_i) <= 2r, and, as distances are Euclidean, the plane between
two pivots must lie within r of x. So each pair within r meets in exactly one
cell, and cells are joined independently, in blocks of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redliner.llm.components import components
from redliner.session import durable

COSINE = 0.93
#: pivots, chosen far apart from a sample of this many vectors
PIVOTS, SAMPLE = 8, 512
BLOCK = 8192
#: rounding of distances; a pair within it of the radius is still brought together
SLACK = 1e-9


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, vectors = [], []
        for v, label in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = None if v is None or label is None or any(c is None for c in v) else np.array(v, "<f8")
            fit = x is not None and len(x) and np.isfinite(x).all() and np.any(x) and np.isfinite(x @ x) and x @ x > 0
            vectors.append(x.tobytes() if fit else None)
            digests.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if fit else None)
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(digests, pa.binary()), pa.array(vectors, pa.binary())],
                                         names=["id", "label", "digest", "vector"])


def _units(raw: list[bytes], width: int) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), "<f8").reshape(-1, width)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def choose_pivots(sample: list[bytes], count: int = PIVOTS) -> dict[int, np.ndarray]:
    """Per vector length, pivots far apart: each next one is the sampled vector farthest from all so far."""
    pivots = {}
    for width in sorted({len(v) // 8 for v in sample}):
        x = _units([v for v in sample if len(v) == 8 * width], width)
        chosen = [0]
        nearest = np.linalg.norm(x - x[0], axis=1)
        while len(chosen) < min(count, len(x)) and nearest.max() > SLACK:
            chosen.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, np.linalg.norm(x - x[chosen[-1]], axis=1))
        pivots[width] = x[chosen]
    return pivots


def cells(x: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(home, visits): the cell of every unit vector and a mask of the later cells it must visit."""
    # differences, not products, so that the distance of a vector to itself is 0
    d = np.stack([np.linalg.norm(x - p, axis=1) for p in pivots], axis=1)
    home = d.argmin(axis=1)
    own = d[np.arange(len(x)), home][:, None]
    apart = np.maximum(np.linalg.norm(pivots[home][:, None, :] - pivots[None], axis=2), SLACK)
    near = (d - own <= 2 * radius + SLACK) & ((d**2 - own**2) / (2 * apart) <= radius + SLACK)
    return home, near & (np.arange(len(pivots)) > home[:, None])


def _linked(cosine: float):
    """Links of one task: home block with home block, or home block with visiting block."""

    def run(table: pa.Table) -> pa.Table:
        width = len(table["vector"][0].as_py()) // 8
        x = np.frombuffer(b"".join(table["vector"].to_pylist()), "<f8").reshape(-1, width)
        norm = np.linalg.norm(x, axis=1)
        side = np.array(table["side"].to_pylist())
        rep, size = (np.array(table[c].to_pylist(), np.int64) for c in ("rep", "size"))
        first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        alone = table["left"][0].as_py() == table["right"][0].as_py() and not table["visit"][0].as_py()
        if alone:
            second = first
        links, group = np.zeros(len(x), np.int64), np.arange(len(x))
        for at in range(0, len(first), 512):
            rows = first[at:at + 512]
            near = (x[rows] @ x[second].T) / (norm[rows][:, None] * norm[second][None]) >= cosine
            if alone:
                near &= rows[:, None] != second[None]
            links[rows] += near @ size[second]
            if not alone:
                links[second] += size[rows] @ near
            for r in np.flatnonzero(near.any(axis=1)):
                # every group that the row touches becomes one
                met = np.unique(np.append(group[second[near[r]]], group[rows[r]]))
                if len(met) > 1:
                    group[np.isin(group, met[1:])] = met[0]
        least = np.full(len(x), np.iinfo(np.int64).max)
        np.minimum.at(least, group, rep)
        found = np.flatnonzero(links)
        return pa.table([table["label"].take(pa.array(found)), table["digest"].take(pa.array(found)), pa.array(links[found]), pa.array(rep[found]), pa.array(least[group[found]])],
                        names=["label", "digest", "links", "rep", "root"])

    return run


def near_vectors(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """(id, n_links, component_id, kept) per row: vectors of equal label linked by their cosine.

    Equal vectors of a label form one class that is joined once; a row is linked
    with the other rows of its class and all rows of the classes close to it.
    Null, empty and zero vectors, vectors with null or non-finite components (or
    whose squared length is not a positive double) and rows without label or id
    link with nothing; without id the component is null and the row is kept.
    Vectors of different lengths are not compared. Rows that share an id are one
    node of the components. Other columns are ignored. An empty table gives an
    empty result.
    """
    kind = vectors.schema[label].dataType.simpleString()
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    ready = durable(rows.mapInArrow(_prepared, f"id long, label {kind}, digest binary, vector binary"))
    usable = ready.filter(F.col("digest").isNotNull() & F.col("id").isNotNull())
    classes = durable(usable.groupBy("label", "digest").agg(F.min("id").alias("rep"), F.count("*").alias("size"), F.any_value("vector").alias("vector")))
    # at most SAMPLE vectors come to the driver
    sample = [bytes(r["vector"]) for r in classes.orderBy(F.xxhash64("digest"), "label").select("vector").limit(SAMPLE).collect()]
    pivots, radius = choose_pivots(sample), float(np.sqrt(2 - 2 * cosine))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("vector").to_pylist()
            place = [[] for _ in raw]
            for width in {len(v) // 8 for v in raw}:
                mine = [n for n, v in enumerate(raw) if len(v) == 8 * width]
                # a length that the sample has missed is one cell
                home, visits = cells(_units([raw[n] for n in mine], width), pivots[width], radius) if width in pivots else (
                    np.zeros(len(mine), np.int64), np.zeros((len(mine), 1), bool))
                for n, h, v in zip(mine, home, visits, strict=True):
                    place[n] = [(int(h), False), *((int(c), True) for c in np.flatnonzero(v))]
            owner = [n for n, p in enumerate(place) for _ in p]
            flat = [x for p in place for x in p]
            yield pa.RecordBatch.from_arrays(
                [*(c.take(pa.array(owner)) for c in batch.columns), pa.array([len(raw[n]) // 8 for n in owner], pa.int32()),
                 pa.array([c for c, _ in flat], pa.int32()), pa.array([v for _, v in flat], pa.bool_())],
                names=[*batch.schema.names, "width", "cell", "visit"])

    key = ["label", "width", "cell"]
    placed = durable(classes.mapInArrow(dealt, f"label {kind}, digest binary, rep long, size long, vector binary, width int, cell int, visit boolean"))
    blocks = lambda visit: F.ceil(F.count(F.when(F.col("visit") == visit, 1)) / BLOCK).cast("int")
    shape = durable(placed.groupBy(*key).agg(blocks(False).alias("homes"), blocks(True).alias("guests")).filter("homes > 0"))
    met = placed.join(shape, key).withColumn("block", F.pmod(F.xxhash64("digest"), F.when(F.col("visit"), F.col("guests")).otherwise(F.col("homes"))).cast("int"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    task = lambda left, right, visit, side: F.struct(left.alias("left"), right.alias("right"), F.lit(visit).alias("visit"), F.lit(side).alias("side"))
    block = F.col("block")
    of_home = F.concat(
        F.transform(F.filter(upto(F.col("homes")), lambda o: o >= block), lambda o: task(block, o, False, 0)),
        F.transform(F.filter(upto(F.col("homes")), lambda o: o < block), lambda o: task(o, block, False, 1)),
        F.transform(upto(F.col("guests")), lambda g: task(block, g, True, 0)))
    of_guest = F.transform(upto(F.col("homes")), lambda h: task(h, block, True, 1))
    tasks = met.withColumn("task", F.explode(F.when(F.col("visit"), of_guest).otherwise(of_home))).select(*key, "task.*", "digest", "rep", "size", "vector")
    found = durable(tasks.groupBy(*key, "left", "right", "visit").applyInArrow(_linked(cosine), f"label {kind}, digest binary, links long, rep long, root long"))
    links = durable(found.groupBy("label", "digest").agg(F.sum("links").alias("links")))
    known = durable(classes.select("label", "digest", "rep", "size").join(links, ["label", "digest"], "left"))
    groups = durable(components(found.select("rep", "root"), "rep", "root"))
    out = ready.select("id", "label", F.when(F.col("id").isNotNull(), F.col("digest")).alias("digest")).join(known, ["label", "digest"], "left")
    out = out.join(groups.toDF("rep", "component"), "rep", "left")
    # an id with several vectors takes the least component of them
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id"))
    return out.select(
        F.col("id").alias(id), F.coalesce(F.col("links"), F.lit(0)) + F.coalesce(F.col("size") - 1, F.lit(0)), component).toDF(id, "n_links", "component_id").withColumn(
        "kept", F.coalesce(F.col(id) == F.col("component_id"), F.lit(True)))
