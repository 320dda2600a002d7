"""Token-id files: canonical, length-limited Huffman codes from global counts.

Layout of a folder:

``code``    (symbol, length): code lengths; the codes follow from them, shorter
            lengths first and smaller symbols first within a length.
``blocks``  one folder per shard, in the order of the document ids. A row is an
            independent block: whole documents in order, their ids and numbers
            of tokens, the code bits of all tokens, and the bit offset of every
            256th token, from which decoding can begin.

Blocks are decoded by one table that maps the next 16 bits to a symbol and its
length; all checkpoints of a block advance together, one token a step.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from redliner.llm.word_tokens import tokenizer, vocabulary_path
from redliner.session import durable, durable_folder

LIMIT = 16
CHECKPOINT = 256
#: a block closes with the document that brings it to this many tokens
BLOCK = 1 << 17
END = 2
SYMBOLS = 1 << 16


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits, by package merge; 0 for symbols that do not occur."""
    symbols = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(symbols) < 2:
        lengths[symbols] = 1
        return lengths
    if len(symbols) > 1 << limit:
        raise ValueError("more symbols than codes of this length")
    order = symbols[np.argsort(counts[symbols], kind="stable")]
    weight = counts[order].astype(np.float64)
    n = len(order)
    level, merges = weight, []
    for _ in range(limit - 1):
        packages = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate([weight, packages])
        by = np.argsort(merged, kind="stable")
        merges.append(by < n)
        level = merged[by]
    # walk back: of the first `take` items of a level, the single symbols get a bit and the packages open two items below
    take = 2 * n - 2
    for single in reversed(merges):
        used = int(single[:take].sum())
        lengths[order[:used]] += 1
        take = 2 * (take - used)
    lengths[order[:take]] += 1
    return lengths


class Code:
    """The canonical code of given lengths, with its decoding table."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        symbols = np.flatnonzero(self.lengths)
        symbols = symbols[np.lexsort((symbols, self.lengths[symbols]))]
        size = self.lengths[symbols]
        # a code of length l takes 2^(LIMIT - l) places of the table
        place = np.concatenate([[0], np.cumsum(1 << (LIMIT - size))]).astype(np.int64)
        self.codes = np.zeros(len(lengths), np.int64)
        self.codes[symbols] = place[:-1] >> (LIMIT - size)
        self.symbol = np.zeros(1 << LIMIT, "<u2")
        self.step = np.ones(1 << LIMIT, np.int64)
        self.symbol[: place[-1]] = np.repeat(symbols, np.diff(place))
        self.step[: place[-1]] = np.repeat(size, np.diff(place))

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """(bits, checkpoints) of ids."""
        if not len(ids):
            return b"", b""
        size = self.lengths[ids]
        end = np.cumsum(size)
        at = end - size
        word, value = at >> 4, self.codes[ids] << (32 - size - (at & 15))
        n = int(end[-1] >> 4) + 2
        # the bits of different tokens do not overlap, so adding them sets them
        high = np.bincount(word, value >> 16, n) + np.bincount(word + 1, value & 0xFFFF, n)
        return high.astype(">u2").tobytes()[: int(end[-1] + 7) // 8], at[::CHECKPOINT].astype("<u4").tobytes()

    def decode(self, bits: bytes, checkpoints: bytes, n: int) -> np.ndarray:
        """The ``n`` ids of a block."""
        words = np.frombuffer(bits + bytes(6 + len(bits) % 2), ">u2").astype(np.int64)
        pair = words[:-1] << 16 | words[1:]
        at = np.frombuffer(checkpoints, "<u4").astype(np.int64)
        out = np.empty((CHECKPOINT, len(at)), "<u2")
        last = len(pair) - 1
        for row in out:
            # a stretch that has ended may run past the bits; its ids are cut off below
            window = (pair[np.minimum(at >> 4, last)] >> (16 - (at & 15))) & 0xFFFF
            row[:] = self.symbol[window]
            at += self.step[window]
        return out.T.reshape(-1)[:n]


#: runs that a worker remembers here, where one tokenizer has a task to itself
REMEMBERED = 500_000


def _encoded(path: str, end: int):
    """The ids of each document and the end id, as little-endian 16-bit integers; other columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, tail = tokenizer(path, REMEMBERED), np.array([end], "<u2").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raw = [r + tail for r in words.encode(part.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(raw, pa.binary())], names=["id", "tie", "row", "raw"])

    return run


def _blocks(code: Code, block: int):
    """Coded blocks of whole documents that come in order; a block is cut from slices of batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        owners, sizes, tokens, held, number, first = [], [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            ids, lengths = pa.concat_arrays(owners), np.concatenate(sizes)
            bits, checkpoints = code.encode(np.concatenate(tokens))
            whole = pa.array([0, len(ids)], pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([first], pa.int64()), pa.array([held], pa.int64()),
                 pa.ListArray.from_arrays(whole, ids), pa.ListArray.from_arrays(whole, pa.array(lengths)), pa.array([checkpoints], pa.binary()), pa.array([bits], pa.binary())],
                names=["shard", "block", "first", "n_ids", "ids", "sizes", "checkpoints", "bits"])

        for batch in batches:
            raw = batch.column(1)
            ends = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset:raw.offset + batch.num_rows + 1].astype(np.int64) // 2
            all_tokens = np.frombuffer(raw.buffers()[2], "<u2")
            at = 0
            while at < batch.num_rows:
                # up to the document that fills the block
                to = min(int(np.searchsorted(ends[1:], ends[at] + block - held)) + 1, batch.num_rows)
                owners.append(batch.column(0).slice(at, to - at))
                sizes.append(np.diff(ends[at:to + 1]))
                tokens.append(all_tokens[ends[at]:ends[to]])
                held += int(ends[to] - ends[at])
                at = to
                if held >= block:
                    yield close()
                    number, first = number + 1, first + held
                    owners, sizes, tokens, held = [], [], [], 0
        if owners:
            yield close()

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SYMBOLS, np.int64)
    for batch in batches:
        for raw in batch.column(0):
            total += np.bincount(np.frombuffer(raw.as_buffer(), "<u2"), minlength=SYMBOLS)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], names=["symbol", "n"])


def write_ids(docs: DataFrame, folder: str, id: str = "doc_id", text: str = "text", path: str | None = None, end: int = END,
              block: int = BLOCK) -> None:
    """Encode the texts and write the ids of all documents to ``folder``, in ascending order of ``id``.

    Null and empty texts are the end id alone. Null ids come first; rows that
    repeat an id lie next to each other, in the order of their texts' hashes,
    and may be split over shards. Other columns are ignored. An empty table
    gives an empty folder of the same form. Counts are summed over all
    documents; the driver sees one number per symbol.
    """
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    # a hash and the place of the row let Spark cut a run of one repeated id
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    order = ["id", "tie", "row"]
    kind = docs.schema[id].dataType.simpleString()
    # ids are half as long as texts, and the range of the order is found from the written columns alone
    raw = durable(rows.select("id", "tie", "row", "text").mapInArrow(_encoded(path or vocabulary_path(), end), f"id {kind}, tie long, row long, raw binary"), "zstd")
    counts = np.zeros(SYMBOLS, np.int64)
    for row in raw.select("raw").mapInArrow(_counted, "symbol int, n long").groupBy("symbol").agg(F.sum("n").alias("n")).collect():
        counts[row["symbol"]] = row["n"]
    lengths = code_lengths(counts)
    spark = docs.sparkSession
    code = [(int(s), int(lengths[s])) for s in np.flatnonzero(lengths)]
    spark.createDataFrame(code, "symbol int, length int").coalesce(1).write.parquet(f"{folder}/code")
    ordered = raw.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "raw")
    blocks = ordered.mapInArrow(_blocks(Code(lengths), block), f"shard int, block int, first long, n_ids long, ids array<{kind}>, sizes array<bigint>, checkpoints binary, bits binary")
    blocks.write.option("compression", "uncompressed").partitionBy("shard").parquet(f"{folder}/blocks")


def read_ids(spark: SparkSession, folder: str, per_document, schema: str) -> DataFrame:
    """Decode a folder of ids block by block.

    ``per_document(ids, sizes, tokens)`` gets a block's document ids, their
    numbers of tokens and all its tokens (unsigned 16-bit), and returns a list
    of columns; ``schema`` names and types them. Two columns are put before
    them: ``shard`` and ``first``, the number of tokens of the shard before the
    document.
    """
    lengths = np.zeros(SYMBOLS, np.int64)
    for row in spark.read.parquet(f"{folder}/code").collect():
        lengths[row["symbol"]] = row["length"]
    code = Code(lengths)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                row = b.slice(at, 1)
                n = row.column("n_ids")[0].as_py()
                tokens = code.decode(row.column("bits")[0].as_py(), row.column("checkpoints")[0].as_py(), n)
                ids, sizes = row.column("ids").flatten(), row.column("sizes").flatten()
                start = row.column("first")[0].as_py() + np.cumsum([0, *sizes.to_pylist()[:-1]])
                columns = per_document(ids, sizes, tokens)
                yield pa.RecordBatch.from_arrays([pa.array([row.column("shard")[0].as_py()] * len(ids), pa.int32()), pa.array(start, pa.int64()), *columns],
                                                 names=["shard", "first", *[f"c{k}" for k in range(len(columns))]])

    names = [f.split()[0] for f in schema.split(", ")]
    plain = ", ".join(f"c{k} {f.split()[1]}" for k, f in enumerate(schema.split(", ")))
    blocks = spark.read.parquet(f"{folder}/blocks").select("shard", "first", "n_ids", "ids", "sizes", "checkpoints", "bits")
    return blocks.mapInArrow(decoded, f"shard int, first long, {plain}").toDF("shard", "first", *names)


def shard_starts(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, before): tokens of all shards before; a row per shard, from the blocks' numbers alone."""
    held = spark.read.parquet(f"{folder}/blocks").groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return durable(held.select("shard", before.alias("before")))


def digests(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) per document, from ids that were written to files and read back."""
    spark = docs.sparkSession
    folder = f"{durable_folder(spark)}/redliner-ids-{uuid.uuid4().hex}"
    write_ids(docs, folder, id, text, path)
    kind = docs.schema[id].dataType.simpleString()
    if spark.read.parquet(f"{folder}/code").isEmpty():
        return spark.createDataFrame([], f"`{id}` {kind}, start long, n_tokens long, ids_crc32 long")

    def summed(ids: pa.Array, sizes: pa.Array, tokens: np.ndarray) -> list[pa.Array]:
        ends = np.cumsum([0, *sizes.to_pylist()])
        wide = tokens.astype("<u4")
        return [ids, sizes, pa.array([zlib.crc32(wide[a:b].tobytes()) for a, b in zip(ends, ends[1:])], pa.int64())]

    rows = read_ids(spark, folder, summed, f"id {kind}, n_tokens long, ids_crc32 long")
    placed = rows.join(shard_starts(spark, folder), "shard")
    return placed.select(F.col("id").alias(id), (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
