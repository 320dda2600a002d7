"""BPE by a pair occurrence index: every joinable pair of a stretch of texts with all its places, joined rank by rank.

A task lays the bytes of all words that it has not met yet one behind the other
and indexes them: each rank that two neighbours can be joined by has the list of
all places where they stand. The active ranks are applied in ascending order, each
to all its places at once, and the lists of the pairs that arise are extended.
This gives the same ids as joining word by word because a piece can only be part
of pairs of higher ranks than its own; a vocabulary in which that does not hold is
refused. Texts are put together from a bounded memory of words; decoding looks
the bytes of all ids of a batch up at once.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAME = "byte_bpe_50k.json"
#: words remembered by a worker, and the characters a remembered word has at most
REMEMBERED, LONGEST = 200_000, 64
#: bytes of text that are split and indexed together, and ids that are decoded together; a longer text is taken alone
STRETCH, DECODED = 1_500_000, 400_000

_NONE = np.int32(1 << 30)
#: between words, and where the right part of a joined pair was
_GONE = np.int64(0xFFFF)


def vocabulary_path(name: str = NAME) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _letters() -> list[str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for code points from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class PairIndexBPE:
    """Encodes texts to ids and decodes ids to bytes."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        import public_tokenizers
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = regex.compile(public_tokenizers.PATTERN)
        # white space of which the pattern makes more than single spaces and line ends
        self.uneven = regex.compile(r"[^\S \n]|\s\s|\s\Z|\x00")
        count = max([*vocab.values(), *self.special.values()]) + 1
        if count > _GONE:
            raise ValueError("ids must fit 16 bits")
        letters = _letters()
        self.byte = np.array([vocab[c] for c in letters], np.int64)
        back = {c: b for b, c in enumerate(letters)}
        self.pieces = [b""] * count
        for piece, number in vocab.items():
            self.pieces[number] = bytes(map(back.__getitem__, piece))
        for piece, number in self.special.items():
            self.pieces[number] = piece.encode()
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.left = np.array([vocab[a] for a, _ in merges], np.int64)
        self.right = np.array([vocab[b] for _, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        made_by = np.full(count, -1, np.int64)
        made_by[self.made] = np.arange(len(merges))
        if (np.maximum(made_by[self.left], made_by[self.right]) >= np.arange(len(merges))).any() or len(np.unique(self.made)) < len(merges):
            raise ValueError("a piece of this vocabulary is part of a pair of lower rank, ranks cannot be applied in one ascent")
        key = self.left << 16 | self.right
        order = np.argsort(key)
        self.key, self.rank = key[order], order.astype(np.int32)
        # decoding: the bytes of all pieces in a row
        self.text = np.frombuffer(b"".join(self.pieces), np.uint8)
        self.size = np.array([len(p) for p in self.pieces], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.remembered = remembered
        self.runs: dict[str, bytes] = {"": b""}
        self.known: dict[str, bytes] = {}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 16 | right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], _NONE)

    def fold(self, words: list[bytes]) -> list[bytes]:
        """Ids of words, as little-endian 16-bit integers."""
        if not words:
            return []
        raw = np.frombuffer(b"\0".join([b"", *words, b""]), np.uint8)
        ends = np.cumsum([1 + len(w) for w in words])
        token = self.byte[raw]
        token[0] = _GONE
        token[ends] = _GONE
        after = np.arange(1, len(token) + 1, dtype=np.int64)
        before = np.arange(-1, len(token) - 1, dtype=np.int64)
        index: dict[int, list[np.ndarray]] = {}

        def extend(places: np.ndarray) -> list[int]:
            """Put the pairs that begin at these places into the index; the ranks that were not active before."""
            ranks = self._ranks(token[places], token[after[places]])
            fits = ranks != _NONE
            places, ranks = places[fits], ranks[fits]
            if not len(ranks):
                return []
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            bounds = [0, *cuts.tolist(), len(ranks)]
            new = []
            for a, b, rank in zip(bounds, bounds[1:], ranks[bounds[:-1]].tolist()):
                if rank in index:
                    index[rank].append(places[a:b])
                else:
                    index[rank] = [places[a:b]]
                    new.append(rank)
            return new

        active = extend(np.arange(len(token) - 1))
        while active:
            rank = heapq.heappop(active)
            lists = index.pop(rank)
            at = lists[0] if len(lists) == 1 else np.sort(np.concatenate(lists))
            # a list also holds places where another pair took a part away meanwhile
            a, b = self.left[rank], self.right[rank]
            at = at[token[at] == a]
            following = after[at]
            stands = token[following] == b
            at, following = at[stands], following[stands]
            if a == b and len(at) > 1:
                keep, taken = [], -1
                for k, (x, y) in enumerate(zip(at.tolist(), following.tolist())):
                    if x != taken:
                        keep.append(k)
                        taken = y
                at, following = at[keep], following[keep]
            if not len(at):
                continue
            token[at] = made = self.made[rank]
            token[following] = _GONE
            beyond = after[following]
            after[at] = beyond
            before[beyond] = at
            # a neighbour joined in this step is reached from its own left side
            for new in extend(np.concatenate([before[at], at[token[beyond] != made]])):
                heapq.heappush(active, new)
        kept = token != _GONE
        data = token[kept].astype("<u2").tobytes()
        places = (np.cumsum(kept)[ends] * 2).tolist()
        return [data[a:b] for a, b in zip([0, *places], places)]

    def _split(self, text: str) -> list[str]:
        """Runs that the pattern treats alike inside and outside of the text: words with the space before them, or its own matches."""
        if self.uneven.search(text):
            return self.words.findall(text)
        return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each); a null text is empty."""
        parts: list[list[tuple[list[str], bytes]]] = []
        for text in texts:
            pieces = self.cut.split(text or "") if self.cut else [text or ""]
            parts.append([(self._split(p), b"") if k % 2 == 0 else ([], self.special[p].to_bytes(2, "little")) for k, p in enumerate(pieces)])
        if len(self.runs) > self.remembered:
            self.runs = {"": b""}
        if len(self.known) > self.remembered:
            self.known = {}
        runs, known = self.runs, self.known
        new = {run: self.words.findall(run) for run in {r for part in parts for split, _ in part for r in split}.difference(runs)}
        words = list({w for found in new.values() for w in found}.difference(known))
        known.update(zip(words, self.fold([w.encode("utf-8", "replace") for w in words]), strict=True))
        for run, found in new.items():
            runs[run] = known[found[0]] if len(found) == 1 else b"".join(map(known.__getitem__, found))
        joined = [b"".join([fixed or b"".join(map(runs.__getitem__, split)) for split, fixed in part]) for part in parts]
        for memory, met in ((runs, new), (known, words)):
            for word in met:
                if len(word) > LONGEST:
                    del memory[word]
        return np.frombuffer(b"".join(joined), "<u2").astype(np.int32), np.array([len(j) // 2 for j in joined], np.int64)

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """The texts of several id lists that stand in a row; bytes that are no UTF-8 become U+FFFD, unknown ids nothing."""
        ids = np.where((ids >= 0) & (ids < len(self.size)), ids, -1)
        length = np.where(ids >= 0, self.size[ids], 0)
        ends = np.cumsum(length)
        # the place of every byte: its piece's start plus its number within the piece
        raw = self.text[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[ids] - (ends - length), length)].tobytes()
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(bounds, bounds[1:])]


_OPEN: dict[str, PairIndexBPE] = {}


def coder(path: str) -> PairIndexBPE:
    """The coder of this worker process."""
    if path not in _OPEN:
        _OPEN[path] = PairIndexBPE(path)
    return _OPEN[path]


def _stretches(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that add up to ``most`` at most, or hold a single row."""
    start = total = 0
    for k, size in enumerate(sizes.tolist()):
        if k > start and total + size > most:
            yield start, k
            start, total = k, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def encode(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids) per row, ids as an array of integers.

    The strings of special tokens get their ids, as in the library. Null and
    empty texts have no ids. Ids of documents may be null or repeat, every row
    counts; very long texts and words are encoded whole; other columns are
    ignored, whatever their names; an empty table gives an empty result. No
    shuffle.
    """
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches:
            sizes = np.diff(np.frombuffer(batch.column(1).buffers()[1], np.int32)[batch.column(1).offset:][:batch.num_rows + 1]) if batch.num_rows else np.zeros(0, int)
            for a, b in _stretches(sizes, STRETCH):
                part = batch.slice(a, b - a)
                ids, counts = bpe.encode(part.column(1).to_pylist())
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids))], names=["id", "ids"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id)


def decode(encoded: DataFrame, id: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """(id, ids, decoded): the text that the ids stand for, special tokens included; null ids give null.

    Bytes that form no UTF-8 become U+FFFD; ids that the vocabulary does not
    hold and nulls within the ids stand for nothing.
    """
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches:
            sizes = batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in _stretches(sizes, DECODED):
                part = batch.slice(a, b - a)
                flat = part.column(1).flatten().fill_null(-1).to_numpy(zero_copy_only=False)
                texts = pa.array(bpe.decode(flat, sizes[a:b]), pa.string(), mask=part.column(1).is_null().to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=["id", "ids", "decoded"])

    kind = encoded.schema[id].dataType.simpleString()
    return (encoded.select(F.col(id).alias("id"), F.col(ids).alias("ids")).mapInArrow(run, f"id {kind}, ids array<int>, decoded string")
            .withColumnsRenamed({"id": id, "ids": ids}))


def _decimal(ids: Column) -> Column:
    return F.concat_ws(",", ids.cast("array<string>"))


def digests(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) per document."""
    return decode(encode(docs, id, text, path), id, "ids", path).select(
        id, F.size("ids").cast("long").alias("n_tokens"), F.sha2(_decimal(F.col("ids")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
