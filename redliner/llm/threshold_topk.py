"""Exact top-k by inner product: Fagin's threshold algorithm in blocks.

Vectors are dealt into blocks of bounded size. In a block every dimension has a
list of rows sorted by its component. A query reads all lists from the end that
its own component favours, scores the rows it meets, and adds up the best that
any unseen row can still bring; when that cannot reach its k-th score, the block
is done. The few best rows of each block meet in a final ranking.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from redliner.session import durable

SCALE = 256
K = 5
QUERY_EVERY = 50
BLOCK = 4096
QUERY_BLOCK = 8192
#: rows read from each list before the first look at the bound; four times as many before each next
FIRST_DEPTH = 16
#: larger components do not fit the integer scores
LARGEST = 2.0**31


def integers(vector: list | None, scale: int = SCALE) -> bytes | None:
    """floor(scale * x) of every component; None for vectors that take no part."""
    if vector is None or not len(vector) or any(x is None for x in vector):
        return None
    x = np.floor(scale * np.array(vector, np.float64))
    return x.astype("<i8").tobytes() if np.isfinite(x).all() and (np.abs(x) < LARGEST).all() else None


class Block:
    """Rows with their lists: ``order[t, d]`` is the row with the t-th smallest component of dimension d."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, x = ids[by_id], x[by_id]
        # products of floats are exact below 2^53; beyond that integers are slower but right
        exact = float(np.abs(x).max(initial=0)) ** 2 * max(1, x.shape[1]) < 2.0**52
        self.x = x.astype(np.float64) if exact else x
        self.order = np.argsort(x, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.x, self.order, axis=0)

    def best(self, scores: np.ndarray, rows: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
        """Places in ``rows`` of the k best other rows: largest score, then smallest id."""
        usable = np.flatnonzero(~own)
        return usable[np.lexsort((rows[usable], -scores[usable]))[:k]]

    def search(self, query: np.ndarray, own_id: int, k: int) -> tuple[np.ndarray, np.ndarray] | None:
        """(rows, scores) of the k best rows, or None if the lists have to be read to their ends."""
        n, depth = len(self.x), FIRST_DEPTH
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        if len(up) + len(down) == 0:
            return None
        while depth * (len(up) + len(down)) < n // 2:
            rows = np.unique(np.concatenate([self.order[n - depth:, up].ravel(), self.order[:depth, down].ravel()]))
            scores = self.x[rows] @ query
            top = self.best(scores, rows, self.ids[rows] == own_id, k)
            bound = self.sorted[n - depth, up] @ query[up] + self.sorted[depth - 1, down] @ query[down]
            # a tie with an unseen row could still go to the unseen one
            if len(top) == k and scores[top[-1]] > bound:
                return rows[top], scores[top]
            depth *= 4
        return None


def _block_results(k: int):
    def run(table: pa.Table) -> pa.Table:
        asked = np.array(table["asks"].to_pylist(), bool)
        width = table["dim"][0].as_py()
        read = lambda t: np.frombuffer(b"".join(t["ints"].to_pylist()), "<i8").reshape(-1, width)
        queries, held = table.filter(pa.array(asked)), table.filter(pa.array(~asked))
        out: list[tuple[np.ndarray, ...]] = []
        if len(queries) and len(held):
            keys = np.array(held["row"].to_pylist(), np.int64)
            ids = np.array(held["id"].to_pylist(), np.int64)
            block = Block(ids, read(held))
            keys = keys[np.argsort(ids, kind="stable")]
            q_ids, q = np.array(queries["id"].to_pylist(), np.int64), read(queries).astype(block.x.dtype)
            open_queries = []
            for n in range(len(q)):
                if (got := block.search(q[n], q_ids[n], k)) is None:
                    open_queries.append(n)
                else:
                    out.append((np.full(len(got[0]), q_ids[n]), keys[got[0]], block.ids[got[0]], got[1]))
            everyone = np.arange(len(block.ids))
            for at in range(0, len(open_queries), 256):
                part = np.array(open_queries[at:at + 256])
                for n, scores in zip(part, q[part] @ block.x.T, strict=True):
                    # only rows that tie with the k-th best or beat it are ranked; the query's own rows are put aside
                    own = block.ids == q_ids[n]
                    reach = k + int(own.sum())
                    rows = everyone if reach >= len(scores) else np.flatnonzero(scores >= np.partition(scores, len(scores) - reach)[len(scores) - reach])
                    top = rows[block.best(scores[rows], rows, own[rows], k)]
                    out.append((np.full(len(top), q_ids[n]), keys[top], block.ids[top], scores[top]))
        columns = [np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
        return pa.table(columns, names=["query_id", "row", "vec_id", "score"])

    return run


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ints = [integers(v) for v in batch.column(1).to_pylist()]
        dims = [None if x is None else len(x) // 8 for x in ints]
        keep = pa.array([x is not None for x in ints])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dims, pa.int32()), pa.array(ints, pa.binary())], names=["id", "dim", "ints"]).filter(keep)


def top_k(vectors: DataFrame, every: int = QUERY_EVERY, id: str = "vec_id", vector: str = "embedding", k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row the k best other rows by integer inner product.

    Queries are the rows whose id is divisible by ``every``. Ties go to the smaller id.
    All rows are candidates, but for those with the query's own id. Vectors that
    are null or empty, or hold null, non-finite or huge components (2^31 after
    scaling) take no part, neither do rows without id, and vectors are compared
    with those of the same length. Repeated candidates are ranked one by one;
    repeated rows of a query are one query (with different vectors, each
    candidate counts with its best score). Fewer than k candidates give fewer
    rows. Other columns are ignored.
    """
    rows = vectors.filter(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(vector).alias("v"))
    ready = rows.mapInArrow(_prepared, "id long, dim int, ints binary").withColumn("row", F.monotonically_increasing_id())
    ready = durable(ready)
    asks = ready.filter(F.col("id") % every == 0).dropDuplicates(["id", "ints"])
    sizes = ready.agg(F.count("*").alias("n")).first()["n"], asks.agg(F.count("*").alias("n")).first()["n"]
    blocks, query_blocks = max(1, -(-sizes[0] // BLOCK)), max(1, -(-sizes[1] // QUERY_BLOCK))
    own = lambda n, *cols: F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = ready.select("dim", own(blocks, "id", "row").alias("block"), each(query_blocks).alias("asking"), F.lit(False).alias("asks"), "id", "row", "ints")
    asked = asks.select("dim", each(blocks).alias("block"), own(query_blocks, "id", "ints").alias("asking"), F.lit(True).alias("asks"), "id", "row", "ints")
    found = held.unionByName(asked).groupBy("dim", "block", "asking").applyInArrow(_block_results(k), "query_id long, row long, vec_id long, score long")
    best = found.groupBy("query_id", "row", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "row"))
    return best.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

