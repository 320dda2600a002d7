"""Near-duplicate documents by SetSketch registers, joint likelihood and exact verification.

A document's set is hashed into registers K_i = floor(1 - log_b(m_i)), where m_i
is the least exponentially distributed hash of its elements; registers are
truncated to [0, q + 1]. Sketches of unions are register-wise maxima. With a
base close to one, registers of two sets agree about as often as their Jaccard
similarity, so equal bands of registers nominate pairs; the numbers of greater,
equal and smaller registers give the likelihood of the similarity, which drops
pairs far below the threshold; the rest is confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redliner.llm.components import components
from redliner.session import durable

WORDS = 5
#: similarity as a fraction of integers: 100 * |A & B| >= 75 * |A | B|
PERCENT = 75
BANDS, ROWS = 40, 5
BASE, RATE, TOP = 1.001, 20.0, 65534
#: pairs whose likely similarity is below this are not verified; over six standard errors under the threshold
LEAST_LIKELY = 0.55
#: buckets of several components up to this size are paired off line by line, larger ones in blocks of documents
DIRECT = 24
#: documents and shingles of a block, on average; a longer text is a row of its own anyway
BLOCK, BLOCK_SHINGLES = 512, 1_000_000

_ODD = np.random.default_rng(20240607).integers(0, 2**32, (2, BANDS * ROWS), dtype=np.uint64).astype(np.uint32)
_MULTIPLY, _ADD = _ODD[0] | np.uint32(1), _ODD[1]
_STEP = np.random.default_rng(77).integers(1, 2**63, WORDS, dtype=np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, width: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles.

    A-Z is lower-cased and words are the runs without ASCII white space. A text
    of fewer words is one shingle; null and empty ones have none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    if len(h) < width:
        return _mix(np.array([xxhash.xxh64_intdigest(b" ".join(words))], np.uint64))
    n = len(h) - width + 1
    total = np.zeros(n, np.uint64)
    for i in range(width):
        total += h[i:i + n] * _STEP[i]
    return np.unique(_mix(total))


def registers(items: np.ndarray, multiply: np.ndarray = _MULTIPLY, add: np.ndarray = _ADD) -> np.ndarray:
    """SetSketch registers of a set of 64-bit hashes; all 0 for the empty set."""
    low = (items >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(multiply), np.uint32(0xFFFFFFFF))
    for at in range(0, len(low), 1024):
        least = np.minimum(least, (low[at:at + 1024, None] * multiply + add).min(axis=0))
    if not len(low):
        return np.zeros(len(multiply), np.uint16)
    exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / RATE
    # shifted by the rate so that registers of one to 10^9 elements fall between 0 and the top
    value = np.floor(1 - np.log(exponential) / np.log(BASE)) + 4000
    return np.clip(value, 0, TOP + 1).astype(np.uint16)


def band_keys(sketch: np.ndarray, rows: int = ROWS) -> list[int]:
    """A signed 64-bit key for each band of registers."""
    raw = sketch.astype("<u2").tobytes()
    width = 2 * rows
    keys = np.array([xxhash.xxh64_intdigest(raw[i:i + width], seed=i) for i in range(0, len(raw), width)], np.uint64)
    return keys.view(np.int64).tolist()


def likely_similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of rows of registers with known set sizes.

    With u = n_a / (n_a + n_b), v = 1 - u and p(x) = -log_b(1 - x (b - 1) / b), a
    register is greater in A with p(u - vJ), greater in B with p(v - uJ) and
    equal otherwise. The concave likelihood is maximised on [0, min(u/v, v/u)]
    by golden sections for all rows at once.
    """
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u = n_a / (n_a + n_b)
    v = 1 - u
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def value(j: np.ndarray) -> np.ndarray:
        up, down = p(u - v * j), p(v - u * j)
        return more * np.log(up) + less * np.log(down) + same * np.log(np.maximum(1 - up - down, 1e-12))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):
        third = (high - low) * 0.381966
        left, right = low + third, high - third
        better = value(left) < value(right)
        low, high = np.where(better, left, low), np.where(better, high, right)
    return (low + high) / 2


def is_likely(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, least: float) -> np.ndarray:
    """Whether ``likely_similarity`` is at least ``least``, for every row of ``a`` with every row of ``b``.

    The likelihood is concave, so its maximum lies there or beyond exactly if
    it does not fall at ``least``, and nothing has to be searched.
    """
    # register by register, in small integers
    more, less = (np.zeros((len(a), len(b)), np.uint8 if a.shape[1] < 256 else np.uint32) for _ in range(2))
    for x, y in zip(a.T[:, :, None], np.ascontiguousarray(b.T)[:, None], strict=True):
        more += x > y
        less += x < y
    more, less = more.astype(np.int64), less.astype(np.int64)
    # an empty set is like no other
    u = np.maximum(n_a[:, None], 1e-9) / (n_a[:, None] + np.maximum(n_b[None], 1e-9))
    v = 1 - u
    x, y = (np.clip(z, 1e-12, 1) for z in (u - v * least, v - u * least))
    step = (BASE - 1) / BASE
    up, down = (-np.log1p(-z * step) / np.log(BASE) for z in (x, y))
    slope_up, slope_down = (step / ((1 - z * step) * np.log(BASE)) for z in (x, y))
    rise = (a.shape[1] - more - less) * (v * slope_up + u * slope_down) / np.maximum(1 - up - down, 1e-12)
    return (np.minimum(u / v, v / u) >= least) & (rise >= more * v * slope_up / up + less * u * slope_down / down)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            sizes, sums, sketches, keys = [], [], [], []
            for text in part.column(1).to_pylist():
                items = shingles(text)
                sizes.append(len(items))
                sums.append(xxhash.xxh128_digest(items.tobytes()))
                sketch = registers(items)
                sketches.append(sketch.astype("<u2").tobytes() if len(items) else None)
                keys.append(band_keys(sketch) if len(items) else None)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes, pa.int64()), pa.array(sums, pa.binary()), pa.array(sketches, pa.binary()),
                 pa.array(keys, pa.list_(pa.int64()))],
                names=["id", "n", "digest", "sketch", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            items = [shingles(text).view(np.int64) for text in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(items, pa.list_(pa.int64()))], names=["id", "items"])


def _with_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, flat = batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy().view(np.uint64)
        sketches = [registers(flat[a:z]).astype("<u2").tobytes() for a, z in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sketches, pa.binary())], names=["id", "items", "sketch"])


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            read = lambda c: np.frombuffer(b"".join(part.column(c).to_pylist()), "<u2").reshape(part.num_rows, -1)  # noqa: B023, E731
            sizes = [part.column(c).to_numpy().astype(float) for c in (2, 3)]
            keep = likely_similarity(read(4), read(5), *sizes) >= LEAST_LIKELY
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(keep))


class _Verifier:
    """Confirms candidate pairs of class representatives: sketches first, then the full sets."""

    def __init__(self, sketches: DataFrame, sets: DataFrame, percent: int):
        self.sketches, self.sets, self.percent = sketches, sets, percent

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets are similar enough."""
        side = lambda x: self.sketches.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
        # sizes alone rule out many pairs: J <= smaller / larger
        fit = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * self.percent
        met = pairs.join(side("a"), "a").join(side("b"), "b").filter(fit)
        likely = durable(met.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(_likely, "a long, b long"))
        both = (likely.join(self.sets.toDF("a", "items_a"), "a").join(self.sets.toDF("b", "items_b"), "b")
                .withColumn("common", F.size(F.array_intersect("items_a", "items_b"))))
        union = F.size("items_a") + F.size("items_b") - F.col("common")
        return both.filter(F.col("common") * 100 >= union * self.percent).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id, kept) per row: groups of documents linked by similar shingle sets.

    1. Every text is sketched once; texts with the same set form one class, of
       which only the least id goes on.
    2. Bands nominate links between classes, see ``band_links``.
    3. Components are joined back through the classes.

    Null, empty and white-space texts have the empty set and link with nothing.
    Rows that share an id are one node, linked as any of their texts is. A row
    without id takes no part: its component is null and it is kept. Very long
    texts are hashed whole. Other columns are ignored. An empty table gives an
    empty result.
    """
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    sketched = durable(rows.mapInArrow(_sketched, "id long, n long, digest binary, sketch binary, bands array<bigint>"))
    named = sketched.filter(F.col("id").isNotNull() & (F.col("n") > 0))
    reps = durable(named.groupBy("n", "digest").agg(F.min("id").alias("rep")))
    member = named.select("id", "n", "digest").join(reps, ["n", "digest"]).select("id", "rep").distinct()
    # an id with several texts ties their classes together
    tied = member.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).filter("a < z").select("id", "a")
    ties = member.join(tied, "id").filter("a < rep").select("a", F.col("rep").alias("b")).distinct()
    first = durable(named.join(reps.select("n", "digest", F.col("rep").alias("id")), ["n", "digest", "id"], "left_semi")
                    .dropDuplicates(["id", "n", "digest"]))
    groups = durable(components(band_links(rows, first, percent).union(ties), "a", "b"))
    found = sketched.select("id", "n", "digest").join(reps, ["n", "digest"], "left")
    found = found.join(groups.toDF("rep", "component"), "rep", "left")
    component = F.coalesce("component", "rep", "id")
    component = F.when(F.col("id").isNotNull(), component)
    return found.select(
        F.col("id").alias(id), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def band_links(rows: DataFrame, first: DataFrame, percent: int) -> DataFrame:
    """Confirmed links that connect all similar representatives that share a band.

    First every document is tested against one hub only, the first of a random
    order among all its buckets. Confirmed links are contracted, and only
    buckets that still hold several components stay open. Small ones are paired
    off across components; large ones are compared inside tasks, block with
    block, and give one line per linked member. So no pair that shares a bucket
    is skipped, and the lines grow with the members of a group, not their pairs.
    """
    bands = first.select("id", F.explode("bands").alias("key")).distinct()
    shared = durable(bands.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most").select("key"))
    members = durable(bands.join(shared, "key", "left_semi").select("key", "id"))
    involved = members.select("id").distinct()
    sets = durable(rows.join(involved, "id", "left_semi").select("id", "text").mapInArrow(_sets, "id long, items array<bigint>"))
    verifier = _Verifier(durable(first.select("id", "n", "sketch").join(involved, "id", "left_semi")), sets, percent)
    order = F.struct(F.xxhash64("id").alias("o"), "id")
    hubs = durable(members.groupBy("key").agg(F.min(order).alias("hub")))
    spokes = members.join(hubs, "key").filter(F.col("id") != F.col("hub.id"))
    one = spokes.groupBy("id").agg(F.min("hub").alias("hub")).select(F.col("id").alias("x"), F.col("hub.id").alias("y"))
    links = durable(verifier.links(one.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()))
    merged = durable(components(links, "a", "b")).toDF("id", "root")
    named = durable(members.join(merged, "id", "left").select("key", "id", F.coalesce("root", "id").alias("component")))
    several = durable(named.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("size"))
                      .filter("c0 < c1").select("key", "size"))
    still = durable(named.join(several, "key"))
    # long texts make more blocks, so that a task holds a bounded number of shingles
    held = still.filter(F.col("size") > DIRECT).join(first.groupBy("id").agg(F.sum("n").alias("n")), "id")
    widths = held.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    # written, as it is read twice
    large = durable(held.join(widths, "key").select("key", "id", "blocks"))
    small = still.filter(F.col("size") <= DIRECT).select("key", "id", "component")
    across = small.join(small.toDF("key", "id2", "component2"), "key").filter("id < id2 and component <> component2")
    found = durable(verifier.links(across.select(F.col("id").alias("a"), F.col("id2").alias("b")).distinct()))
    return links.union(found).union(durable(_block_links(large, sets, percent)))


def _block_links(large: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): a member and the least member that it is linked with, within two blocks of a bucket.

    ``large``: key, id and the number of blocks of the bucket. As with single
    pairs, the registers tell first which pairs are likely, and only members of
    such a pair go into the intersections.
    """
    dealt = large.withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    everyone = F.sequence(F.lit(0), F.col("blocks") - 1)
    task = F.transform(everyone, lambda o: F.struct(F.least("block", o).alias("left"), F.greatest("block", o).alias("right")))
    tasks = dealt.select("key", "id", "block", F.explode(task).alias("task")).select("key", "task.left", "task.right", "id", "block")

    def compare(table: pa.Table) -> pa.Table:
        ids = table["id"].to_numpy()
        sizes = pc.list_value_length(table["items"]).to_numpy().astype(np.int64)
        block = table["block"].to_numpy()
        left = np.flatnonzero(block == table["left"][0].as_py())
        right = np.flatnonzero(block == table["right"][0].as_py())
        items = table["items"].combine_chunks().flatten().to_numpy()
        owner = np.repeat(np.arange(len(ids)), sizes)
        sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), "<u2").reshape(len(ids), -1)
        likely = is_likely(sketch[left], sketch[right], sizes[left], sizes[right], LEAST_LIKELY) & (left[:, None] != right[None])
        left, right, likely = left[likely.any(axis=1)], right[likely.any(axis=0)], likely[likely.any(axis=1)][:, likely.any(axis=0)]
        member = np.zeros(len(ids), bool)
        member[left], member[right] = True, True
        items, owner = items[member[owner]], owner[member[owner]]
        _, item, count = np.unique(items, return_inverse=True, return_counts=True)
        # only shingles of several documents count for their intersections
        keep = count[item] > 1
        _, item = np.unique(item[keep], return_inverse=True)
        owner = owner[keep]
        by = np.argsort(item, kind="stable")
        item, owner = item[by], owner[by]
        common = np.zeros((len(left), len(right)), np.int64)
        place = [np.full(len(ids), -1), np.full(len(ids), -1)]
        place[0][left], place[1][right] = np.arange(len(left)), np.arange(len(right))
        for low in range(0, int(item[-1]) + 1 if len(item) else 0, 4096):
            at = slice(*np.searchsorted(item, [low, low + 4096]))
            sides = []
            for p, n in zip(place, (len(left), len(right)), strict=True):
                has = np.zeros((n, 4096), np.float32)
                mine = p[owner[at]]
                has[mine[mine >= 0], (item[at] - low)[mine >= 0]] = 1
                sides.append(has)
            # at most 4,096 a step, which float32 holds exactly; the sum needs more
            common += (sides[0] @ sides[1].T).astype(np.int64)
        union = sizes[left][:, None] + sizes[right][None] - common
        near = likely & (common * 100 >= union * percent)
        group = np.arange(len(ids))
        for r in np.flatnonzero(near.any(axis=1)):
            met = np.unique(np.append(group[right[near[r]]], group[left[r]]))
            if len(met) > 1:
                group[np.isin(group, met[1:])] = met[0]
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, group, ids)
        a, b = ids, least[group]
        return pa.table([pa.array(b[a != b]), pa.array(a[a != b])], names=["a", "b"])

    # a member's registers are made once, whatever the number of its tasks
    sketched = sets.join(large.select("id").distinct(), "id", "left_semi").select("id", "items").mapInArrow(_with_sketches, "id long, items array<bigint>, sketch binary")
    return tasks.join(sketched, "id").groupBy("key", "left", "right").applyInArrow(compare, "a long, b long").distinct()


def one_per_group(docs: DataFrame, id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The documents, with all their columns, that stand for their group of near duplicates.

    Of rows that repeat an id with the same text one stays; rows without id and
    documents without words all stay.
    """
    found = durable(near_duplicates(docs, id, text, percent))
    dropped = durable(found.filter(~F.col("kept")).select(id).distinct())
    repeated = durable(found.groupBy(id).agg(F.count("*").alias("n")).filter((F.col("n") > 1) & F.col(id).isNotNull()).select(id))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    stay = docs.join(dropped, id, "left_anti").select(*columns)
    once = stay.join(repeated, id, "left_semi").select(*columns).dropDuplicates([id, text])
    return stay.join(repeated, id, "left_anti").select(*columns).unionByName(once)
