"""Byte-level BPE by ranks: distinct words are folded once, decoding joins binary pieces.

Two forms of the same fold. ``encode_words`` is Spark's own: higher-order
functions fold the ranked merges over the byte array of every word of a column,
with the ranks as a literal. ``encode_documents`` is for whole corpora: inside
tasks, the merges of all words that a batch brings for the first time are folded
together in numpy arrays, and texts are put together from a bounded memory of
words.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAME = "byte_bpe_multi_50k.tiktoken"
#: runs of text remembered by a worker; then the memory starts anew
REMEMBERED = 250_000
#: pieces with more bytes are folded one by one with a heap
LONG = 128


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}


def vocabulary_path(name: str = NAME) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


# --- Spark's own form ---------------------------------------------------------------------------------------------

BUCKETS = 16_384


def rank_literal(ranks: dict[bytes, int], buckets: int = BUCKETS) -> Column:
    """The ranks as one literal: an array of small maps, found by the crc32 of the piece.

    Spark searches a literal map from its start, so one map of all ranks would
    cost its whole length at every look-up.
    """
    import zlib

    maps: list[dict[str, int]] = [{} for _ in range(buckets)]
    for piece, rank in ranks.items():
        maps[zlib.crc32(piece) % buckets][piece.hex().upper()] = rank
    return F.from_json(F.lit(json.dumps(maps)), "array<map<string,int>>")


def encode_words(word: Column, ranks: Column, buckets: int = BUCKETS) -> Column:
    """Ids of a word (one match of the pattern), folded over its bytes."""
    whole = F.encode(word, "UTF-8")
    rank = lambda piece: F.try_element_at(F.get(ranks, (F.crc32(piece) % buckets).cast("int")), F.hex(piece))
    size = F.octet_length(whole)
    start = F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(whole, i, F.lit(1)))

    def merge(parts: Column, _: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(parts) - 2)
        pairs = F.filter(F.transform(places, lambda i: F.struct(rank(F.concat(F.get(parts, i), F.get(parts, i + 1))).alias("r"), i.alias("i"))),
                         lambda p: p["r"].isNotNull())
        joined = lambda p: F.concat(F.slice(parts, F.lit(1), p["i"]), F.array(F.concat(F.get(parts, p["i"]), F.get(parts, p["i"] + 1))),
                                    F.slice(parts, p["i"] + 3, F.size(parts)))
        least = F.transform(F.array(F.array_min(pairs)), lambda p: F.when(p.isNull(), parts).otherwise(joined(p)))
        return F.when(F.size(parts) < 2, parts).otherwise(least[0])

    folded = F.aggregate(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), start, merge)
    ids = F.when(rank(whole).isNotNull(), F.array(rank(whole))).otherwise(F.transform(folded, rank))
    return F.when(size == 0, F.array().cast("array<int>")).otherwise(ids)


# --- the form for whole corpora -----------------------------------------------------------------------------------

NONE = np.int32(1 << 30)


#: what the public pattern matches as one word, or as one word and one run of marks
_WORD = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


class ByteBPE:
    """Encodes texts to little-endian 16-bit ids and decodes them."""

    def __init__(self, path: str, split: str, remembered: int = REMEMBERED):
        import regex

        self.ranks = read_ranks(path)
        if len(self.ranks) > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.split = regex.compile(split)
        self.plain = split == pattern()
        self.spaces = regex.compile(r"[^\S \n]|\s\s|\s\Z|\x00")
        self.pieces = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            self.pieces[rank] = piece
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        # every way to join two pieces to a third
        pairs = {}
        for piece, rank in self.ranks.items():
            for k in range(1, len(piece)):
                a, b = self.ranks.get(piece[:k]), self.ranks.get(piece[k:])
                if a is not None and b is not None:
                    pairs[a << 16 | b] = rank
        self.pair_key = np.array(sorted(pairs), np.int64)
        self.pair_rank = np.array([pairs[k] for k in self.pair_key.tolist()], np.int32)
        self.remembered = remembered
        self.memory: dict[str, bytes] = {}
        # words are often met with other marks behind them
        self.known: dict[str, bytes] = {}

    def _joins(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 16 | right
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], NONE)

    def fold(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces that are not ids themselves: the pair of least rank, leftmost first, is merged until none is left."""
        if not pieces:
            return []
        done: list[tuple[np.ndarray, np.ndarray]] = []
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        owner = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
        token = self.byte[raw]
        rank = np.full(len(token), NONE)
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inner] = self._joins(token[inner], token[inner + 1])
        while len(token):
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            least = np.minimum.reduceat(rank, starts)
            length = np.diff(np.concatenate([starts, [len(token)]]))
            over = np.repeat(least == NONE, length)
            if over.any():
                done.append((owner[over], token[over]))
                token, owner, rank = token[~over], owner[~over], rank[~over]
                continue
            at = np.flatnonzero(rank == np.repeat(least, length))
            at = at[np.concatenate([[True], owner[at][1:] != owner[at][:-1]])]
            token[at] = rank[at]
            keep = np.ones(len(token), bool)
            keep[at + 1] = False
            # the merged token keeps the place of its left part
            place = np.cumsum(keep) - 1
            token, owner, rank = token[keep], owner[keep], rank[keep]
            beside = np.zeros(len(token), bool)
            beside[place[at]] = True
            beside[np.maximum(place[at] - 1, 0)] = True
            changed = np.flatnonzero(beside)
            rank[changed] = NONE
            changed = changed[changed + 1 < len(token)]
            changed = changed[owner[changed] == owner[changed + 1]]
            rank[changed] = self._joins(token[changed], token[changed + 1])
        owner, token = (np.concatenate(c) for c in zip(*done, strict=True))
        data = token[np.argsort(owner, kind="stable")].astype("<u2").tobytes()
        ends = (np.cumsum(np.bincount(owner, minlength=len(pieces))) * 2).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def fold_long(self, piece: bytes) -> bytes:
        """The same for one long piece, in n log n steps."""
        token: list[int | None] = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        n = len(token)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = dict(zip(self.pair_key.tolist(), self.pair_rank.tolist(), strict=True)) if not hasattr(self, "pairs") else self.pairs
        self.pairs = pairs
        first = [pairs.get(token[i] << 16 | token[i + 1]) for i in range(n - 1)]
        heap = [(r, i, token[i], token[i + 1]) for i, r in enumerate(first) if r is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if token[i] != a or j >= n or token[j] != b:
                continue
            token[i], token[j] = r, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (q := pairs.get(token[x] << 16 | token[y])) is not None:
                    heapq.heappush(heap, (q, x, token[x], token[y]))
        return np.array([t for t in token if t is not None], "<u2").tobytes()

    def _runs(self, text: str) -> list[str]:
        """Stretches of a text that the pattern treats alike inside and outside of it.

        Between single spaces and line ends these are the words, each with the
        space before it; otherwise the matches of the pattern.
        """
        if self.spaces.search(text):
            return self.split.findall(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0") if text else []

    def _matches(self, run: str) -> tuple[str, ...] | list[str]:
        """The matches of the pattern in a run; plain Latin words with ASCII marks behind them are cut without it."""
        if self.plain and (word := _WORD.fullmatch(run)):
            return (word[1], word[2]) if word[2] else (word[1],)
        return self.split.findall(run)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as bytes; a null text is empty."""
        runs = [self._runs(t or "") for t in texts]
        if len(self.memory) > self.remembered:
            self.memory.clear()
        if len(self.known) > self.remembered:
            self.known.clear()
        memory, known = self.memory, self.known
        memory[""] = b""
        new = {run: self._matches(run) for run in set().union(*runs).difference(memory)}
        short = []
        for piece in {p for parts in new.values() for p in parts}.difference(known):
            raw = piece.encode()
            if (rank := self.ranks.get(raw)) is not None:
                known[piece] = rank.to_bytes(2, "little")
            elif len(raw) > LONG:
                known[piece] = self.fold_long(raw)
            else:
                short.append((piece, raw))
        for (piece, _), ids in zip(short, self.fold([raw for _, raw in short]), strict=True):
            known[piece] = ids
        for run, parts in new.items():
            memory[run] = known[parts[0]] if len(parts) == 1 else b"".join(map(known.__getitem__, parts))
        return [b"".join(map(memory.__getitem__, r)) for r in runs]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))


_OPEN: dict[tuple[str, str], ByteBPE] = {}


def coder(path: str, split: str) -> ByteBPE:
    """The coder of this worker process."""
    if (path, split) not in _OPEN:
        _OPEN[path, split] = ByteBPE(path, split)
    return _OPEN[path, split]


def encode_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None, split: str | None = None) -> DataFrame:
    """(id, ids) per row, ids as little-endian unsigned 32-bit integers.

    Null and empty texts have no ids. Ids of documents may be null or repeat;
    very long texts and words are encoded whole; other columns are ignored; an
    empty table gives an empty result. No shuffle.
    """
    path, split = path or vocabulary_path(), split or pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, split)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [np.frombuffer(x, "<u2").astype("<u4").tobytes() for x in bpe.encode(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], names=["id", "ids"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, ids binary").withColumnRenamed("id", id)


def decode_documents(encoded: DataFrame, id: str = "doc_id", ids: str = "ids", path: str | None = None, split: str | None = None) -> DataFrame:
    """(id, ids, decoded): the binary pieces of the ids, joined; null ids give null."""
    path, split = path or vocabulary_path(), split or pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, split)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = [None if x is None else bpe.decode(np.frombuffer(x, "<u4")) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names=["id", "ids", "decoded"])

    kind = encoded.schema[id].dataType.simpleString()
    return (encoded.select(F.col(id).alias("id"), F.col(ids).alias("ids")).mapInArrow(run, f"id {kind}, ids binary, decoded binary")
            .withColumnsRenamed({"id": id, "ids": ids}))


def digests(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) per document."""
    return decode_documents(encode_documents(docs, id, text), id).select(
        id, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
