"""Best-fit packing by bin completion, on the histogram of lengths.

Which sequences can be built depends only on how many pieces there are of each
length, and there are at most ``capacity`` lengths. So the search runs over this
histogram on the driver, whatever the corpus: a filling is decided once and used
as often as the counts allow. Spark counts the pieces, numbers those of equal
length, and deals them to the slots of the plan.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from redliner.llm.word_tokens import tokenizer, vocabulary_path
from redliner.session import durable

CAPACITY = 2048
END = 0
#: nodes of the search tree that are visited at most, and branches that leave each
NODES, BRANCHES = 4000, 3

# a plan: fillings as {length: pieces of it} with the number of sequences filled like this
Plan = list[tuple[dict[int, int], int]]


def lower_bound(counts: np.ndarray) -> int:
    """Martello and Toth's bound: no packing of pieces with these counts by length has fewer sequences."""
    capacity = len(counts) - 1
    sizes = np.arange(capacity + 1)
    number, mass = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * sizes)])
    small = np.arange(0, capacity // 2 + 1)  # lengths below it are left out of the argument
    alone = number[-1] - number[capacity - small + 1]
    half = capacity // 2
    large = number[capacity - small + 1] - number[half + 1]
    large_mass = mass[capacity - small + 1] - mass[half + 1]
    rest = mass[half + 1] - mass[small]
    more = np.maximum(0, -(-(rest - (large * capacity - large_mass)) // capacity))
    return int((alone + large + more).max())


def best_fit_decreasing(counts: np.ndarray) -> Plan:
    """Longest first, each piece into the fullest sequence that takes it; equal sequences move together.

    Each length opens at most two groups and splits at most one, so there are
    at most three groups per length.
    """
    capacity = len(counts) - 1
    groups: dict[int, list[tuple[dict[int, int], int]]] = {}
    rooms: list[int] = []

    def put(room: int, filling: dict[int, int], n: int) -> None:
        if n:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append((filling, n))

    for size in range(capacity, 0, -1):
        left = int(counts[size])
        while left:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                each = min(capacity // size, left)
                filled = left // each
                put(capacity - each * size, {size: each}, filled)
                left -= filled * each
                continue
            room = rooms[at]
            filling, n = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(at)
            each = min(room // size, left)
            used = min(n, left // each)
            put(room, filling, n - used)
            put(room - each * size, {**filling, size: filling.get(size, 0) + each}, used)
            left -= used * each
    return [g for found in groups.values() for g in found]


def fillings(counts: np.ndarray, branches: int = BRANCHES) -> list[dict[int, int]]:
    """Undominated ways to fill a sequence around the longest piece left, least waste first.

    One filling dominates another if the pieces of the other fit into the room
    of its own. A piece that fits exactly dominates everything. Otherwise the
    candidates are the longest piece that fits and the frontier of pairs, in
    which a shorter first piece must come with a longer second one; each is
    extended by the longest pieces that still fit.
    """
    capacity = len(counts) - 1
    sizes = np.arange(capacity + 1)
    longest = int(np.flatnonzero(counts)[-1])
    counts = counts.copy()
    counts[longest] -= 1
    room = capacity - longest
    below = np.maximum.accumulate(np.where(counts > 0, sizes, 0))
    if below[room] == room:
        return [_joined(longest, [room] if room else [])]
    first = np.flatnonzero(counts[:room + 1] > 0)[::-1]
    if not len(first):
        return [{longest: 1}]
    second = np.minimum(below[room - first], first)
    # a pair of one length needs two pieces
    twice = (second == first) & (counts[first] < 2)
    second = np.where(twice, below[np.maximum(first - 1, 0)], second)
    frontier = np.concatenate([[True], second[1:] > np.maximum.accumulate(second)[:-1]])
    order = np.argsort((room - first - second)[frontier], kind="stable")[:4 * branches]
    found = []
    for a, b in zip(first[frontier][order], second[frontier][order], strict=True):
        chosen = [int(a), *([int(b)] if b else [])]
        space = room - sum(chosen)
        while space and below[space]:
            nxt = int(below[space])
            while nxt and chosen.count(nxt) >= counts[nxt]:
                nxt = int(below[nxt - 1])
            if not nxt:
                break
            chosen.append(nxt)
            space -= nxt
        found.append((space, chosen))
    found.sort(key=lambda x: (x[0], [-c for c in x[1]]))
    return [_joined(longest, chosen) for _, chosen in found[:branches]]


def _joined(longest: int, others: list[int]) -> dict[int, int]:
    out = {longest: 1}
    for x in others:
        out[x] = out.get(x, 0) + 1
    return out


def bin_completion(counts: np.ndarray, nodes: int = NODES) -> Plan:
    """The best plan found for pieces with these counts by length (index = length, last = capacity).

    Best-fit decreasing is the first incumbent. Depth-first search then fills
    sequences around the longest piece, each filling as often as it can be; a
    branch ends when its waste or its lower bound shows that it cannot beat the
    incumbent. The search stops at the lower bound or after ``nodes`` nodes.
    """
    counts = counts.astype(np.int64)
    capacity = len(counts) - 1
    if not counts.any():
        return []
    best = best_fit_decreasing(counts)
    fewest, floor = sum(n for _, n in best), lower_bound(counts)
    total = int((counts * np.arange(capacity + 1)).sum())
    stack: list[tuple[np.ndarray, int, int, tuple | None]] = [(counts, 0, 0, None)]
    while stack and fewest > floor and nodes:
        nodes -= 1
        left, used, waste, path = stack.pop()
        if not left.any():
            if used < fewest:
                fewest, best = used, []
                while path:
                    path, filling, n = path
                    best.append((filling, n))
            continue
        if waste > (fewest - 1) * capacity - total or used + lower_bound(left) >= fewest:
            continue
        for filling in reversed(fillings(left)):
            n = min(int(left[size]) // each for size, each in filling.items())
            after = left.copy()
            for size, each in filling.items():
                after[size] -= each * n
            lost = capacity - sum(size * each for size, each in filling.items())
            stack.append((after, used + n, waste + lost * n, (path, filling, n)))
    return best


class Slots:
    """A plan as sorted arrays: the k-th piece of a length finds its sequence and offset by bisection."""

    def __init__(self, plan: Plan):
        rows, given, base = [], {}, 0
        for filling, n in plan:
            offset = 0
            for size in sorted(filling, reverse=True):
                each = filling[size]
                rows.append((size << 48 | given.get(size, 0), base, each, offset))
                given[size] = given.get(size, 0) + each * n
                offset += size * each
            base += n
        rows.sort()
        self.key, self.base, self.each, self.offset = (np.array(c, np.int64) for c in (zip(*rows, strict=True) if rows else [[]] * 4))

    def find(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, size << 48 | rank, side="right") - 1
        k = rank - (self.key[at] & ((1 << 48) - 1))
        return self.base[at] + k // self.each[at], self.offset[at] + k % self.each[at] * size


def pieces(docs: DataFrame, id: str, text: str, path: str, end: int = END, capacity: int = CAPACITY) -> DataFrame:
    """Every document's ids with the end id, cut where longer than ``capacity``; task and number tell pieces of a length apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task = tokenizer(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                owner, piece, length, crc = [], [], [], []
                for n, raw in enumerate(words.encode(part.column(1).to_pylist())):
                    ids = np.append(np.frombuffer(raw, "<u2").astype("<u4"), np.uint32(end)).tobytes()
                    for k, start in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[start:start + 4 * capacity]
                        owner.append(n)
                        piece.append(k)
                        length.append(len(cut) // 4)
                        crc.append(zlib.crc32(cut))
                number = []
                for size in length:
                    number.append(int(seen[size]))
                    seen[size] += 1
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                     pa.array([task] * len(owner), pa.int64()), pa.array(number, pa.int64())],
                    names=["id", "piece", "length", "ids_crc32", "task", "number"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(
        run, f"id {kind}, piece int, length long, ids_crc32 long, task long, number long")


def pack(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None, end: int = END,
         capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) per piece: documents in few full sequences.

    Documents of up to ``capacity`` ids, the end id included, stay in one
    piece; only longer ones are cut. Null and empty texts are one piece of the
    end id. Repeated rows and null ids are packed like any other row; ties in
    length are broken by where rows lie. Other columns are ignored. An empty
    table gives an empty result. The driver sees the histogram of lengths only,
    at most ``capacity`` numbers.
    """
    cut = durable(pieces(docs, id, text, path or vocabulary_path(), end, capacity))
    by_task = durable(cut.groupBy("task", "length").agg(F.count("*").alias("n")))
    counts = np.zeros(capacity + 1, np.int64)
    for row in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[row["length"]] = row["n"]
    slots = Slots(bin_completion(counts))
    # a task's pieces of a length are numbered after those of the tasks before it
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    first = durable(by_task.select("task", "length", before.alias("first")))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = slots.find(b.column("length").to_numpy(), b.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)],
                names=[id, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = cut.join(first, ["task", "length"]).select(
        "id", "piece", (F.col("piece").cast("long") * capacity).alias("start"), "length", "ids_crc32", (F.col("first") + F.col("number")).alias("rank"))
    kind = docs.schema[id].dataType.simpleString()
    return ranked.mapInArrow(place, f"`{id}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
