"""Toxicity: a convolutional text classifier trained in numpy, applied by Spark.

A word and its beginnings are hashed to 32 bits, and the sum of their embedding
rows is the word's embedding; only hashes that the training met often enough
have a row, all others are zero. Filters of several widths run over the
embedded text, each keeps its largest response (max pooling), and a logistic
layer turns these into a score. Training takes every labelled row: tasks train
on shards of them, and their models are averaged between rounds. Decision
thresholds are calibrated for each language on rows that the training did not
see.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redliner.llm.folds import CALIBRATION, HELD_OUT, fold, labelled, one_per_id
from redliner.operators.scan import next_value, ordered_scan, running_sum
from redliner.session import durable, growing

DIM = 12
WIDTHS = (1, 2, 3)
FILTERS = 8
#: beginnings of a word, in bytes, that are hashed beside the word
BEGINNINGS = (4, 5, 6, 7)
#: labelled documents that must hold a hash for it to get a row
LEAST_DOCS = 3
#: most rows of a model
ROWS = 1 << 17
#: labelled rows, about, that one task trains on between two averages
SHARD = 8192
#: texts whose hashes a task holds at a time
SLICE = 2048
#: columns of an embedding row and its Adagrad sum
VALUES = [f"v{k}" for k in range(DIM + 1)]
#: words that are convolved at a time; longer texts go through in overlapping windows
WINDOW = 1 << 16
_REACH = max(WIDTHS) - 1

_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")


def words(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").lower().encode("utf-8", "surrogatepass"))


def hashes(known: list[bytes]) -> np.ndarray:
    """One row per word: the hash of the word and of each proper beginning, 0 where it has none."""
    crc = zlib.crc32
    flat = [h for w in known for h in (crc(w, 1), *(crc(w[:k]) if len(w) > k else 0 for k in BEGINNINGS))]
    return np.array(flat, np.uint32).reshape(len(known), 1 + len(BEGINNINGS))


def _rows(keys: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Places of hashes among ascending keys; 0, the place of the key 0, where there is none."""
    at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
    return np.where(keys[at] == found, at, 0)


@dataclass
class TextCNN:
    keys: np.ndarray
    embedding: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    bias: float
    thresholds: dict[str, float] = field(default_factory=dict)
    default_threshold: float = 0.5

    def rows(self, found: np.ndarray) -> np.ndarray:
        """Embedding rows of hashes; the first row, all zero, where there is none."""
        return _rows(self.keys, found)

    def scores(self, texts: list[list[bytes]]) -> np.ndarray:
        """Score of every list of words; an empty one scores like padding."""
        place: dict[bytes, int] = {}
        indexed = [[place.setdefault(w, len(place)) + 1 for w in t] for t in texts]
        return self._scores(indexed, hashes(list(place)))

    def _scores(self, indexed: list[list[int]], vocabulary: np.ndarray) -> np.ndarray:
        """Texts as numbers of vocabulary rows, from 1."""
        vectors = np.zeros((len(vocabulary) + 1, DIM), np.float32)
        vectors[1:] = self.embedding[self.rows(vocabulary)].sum(axis=1)
        tables = [[vectors @ f for f in w.astype(np.float32)] for w in self.filters]
        pooled = np.full((len(indexed), len(WIDTHS) * FILTERS), -np.inf, np.float32)
        parts: list[np.ndarray] = []
        owner: list[int] = []
        windows: list[int] = []

        def flush() -> None:
            ids = np.concatenate(parts)
            starts = np.cumsum([0, *map(len, parts[:-1])])
            # windows start at the words of a part and run over what follows in it, so none reaches the next part
            spans = np.stack([starts, starts + np.array(windows)], axis=1).ravel()
            columns = [np.maximum.reduceat(sum(table[j][np.roll(ids, -j)] for j in range(len(table))), spans)[::2] for table in tables]
            np.maximum.at(pooled, np.array(owner), np.concatenate(columns, axis=1))
            parts.clear()
            owner.clear()
            windows.clear()

        size = 0
        for n, ids in enumerate(indexed):
            for at in range(0, max(1, len(ids)), WINDOW):
                part = np.concatenate([np.array(ids[at:at + WINDOW + _REACH], np.int64), np.zeros(_REACH + (not len(ids)), np.int64)])
                parts.append(part)
                owner.append(n)
                windows.append(max(1, min(WINDOW, len(ids) - at)))
                size += len(part)
                if size > WINDOW:
                    flush()
                    size = 0
        if parts:
            flush()
        hidden = np.maximum(pooled + np.concatenate(self.biases), 0)
        return 1 / (1 + np.exp(-np.clip(hidden @ self.out + self.bias, -30, 30)))

    def threshold(self, language: str | None) -> float:
        return self.thresholds.get(language, self.default_threshold)


@dataclass
class _State:
    """What training changes: embedding rows with their Adagrad sums, dense parameters with Adam's moments, steps so far."""
    embedding: np.ndarray
    square: np.ndarray
    dense: list[np.ndarray]
    first: list[np.ndarray]
    second: list[np.ndarray]
    step: float = 0.0

    def flat(self) -> np.ndarray:
        """All that is dense, in rows as wide as those of an embedding with its sum."""
        values = np.concatenate([*(p.ravel() for p in (*self.dense, *self.first, *self.second)), [self.step]])
        return np.pad(values, (0, -len(values) % (DIM + 1))).reshape(-1, DIM + 1)

    def take(self, flat: np.ndarray) -> None:
        values, at = flat.ravel(), 0
        for group in (self.dense, self.first, self.second):
            for k, p in enumerate(group):
                group[k] = values[at:at + p.size].reshape(p.shape).copy()
                at += p.size
        self.step = float(values[at])


def _initial(count: np.ndarray, totals: list[int], rng: np.random.Generator) -> _State:
    """A row per kept hash; its first dimension starts at how far the hash leans to label 1.

    ``count`` has the documents of label 0 and of label 1 that hold each hash,
    ``totals`` all of them; place 0 stands for every other hash. The lean is the
    z-score of the document log-odds beyond 2.5; everything else of a row starts
    at zero, filters start at random.
    """
    log_odds = np.log((count[1] + 0.5) / (totals[1] + 1)) - np.log((count[0] + 0.5) / (totals[0] + 1))
    z = log_odds / np.sqrt(1 / (count[1] + 0.5) + 1 / (count[0] + 0.5))
    embedding = np.zeros((count.shape[1], DIM))
    embedding[:, 0] = np.clip(np.sign(z) * np.maximum(np.abs(z) - 2.5, 0) / 4, -1, 1)
    embedding[0] = 0
    filters = [rng.normal(0, 0.1, (w, DIM, FILTERS)) for w in WIDTHS]
    for f in filters:
        f[:, 0, : FILTERS // 2] += 1.0 / len(f)
    out = rng.normal(0.3, 0.1, len(WIDTHS) * FILTERS)
    dense = [*filters, *[np.full(FILTERS, -0.1) for _ in WIDTHS], out, np.array([np.log(totals[1] / totals[0])])]
    return _State(embedding, np.zeros(len(embedding)), dense, [np.zeros_like(p) for p in dense], [np.zeros_like(p) for p in dense])


def _step(state: _State, batch: list[tuple[int, np.ndarray, np.ndarray]], rate: float = 0.01) -> np.ndarray:
    """One step of Adam on the logistic loss of a batch; returns the embedding rows it moved.

    A text is its label, the embedding rows of each of its different words'
    hashes, and its words as numbers of these. Gradients reach only the window
    that won each pooling.
    """
    *filters, out, bias = state.dense
    filters, biases = filters[:len(WIDTHS)], filters[len(WIDTHS):]
    gradients = [np.zeros_like(p) for p in state.dense]
    touched = []
    for label, listed, places in batch:
        vectors = np.concatenate([state.embedding[listed].sum(axis=1), np.zeros((1, DIM))])
        ids = np.concatenate([places, np.full(_REACH + (not len(places)), len(listed))])
        listed = np.concatenate([listed, np.zeros((1, listed.shape[1]), listed.dtype)])
        x, windows = vectors[ids], len(ids) - _REACH
        hidden, winners = [], []
        for k, f in enumerate(filters):
            response = sum(x[j:j + windows] @ part for j, part in enumerate(f)) + biases[k]
            winner = response.argmax(axis=0)
            winners.append(winner)
            hidden.append(response[winner, np.arange(FILTERS)])
        raw = np.concatenate(hidden)
        pooled = np.maximum(raw, 0)
        error = 1 / (1 + np.exp(-np.clip(pooled @ out + bias[0], -30, 30))) - label
        gradients[-1] += error
        gradients[-2] += error * pooled
        back = (error * out * (raw > 0)).reshape(len(WIDTHS), FILTERS)
        for k, f in enumerate(filters):
            gradients[len(WIDTHS) + k] += back[k]
            for j, part in enumerate(f):
                where = winners[k] + j
                gradients[k][j] += x[where].T * back[k]
                touched.append((listed[ids[where]], part.T * back[k][:, None]))
    ids = np.concatenate([t[0] for t in touched])
    rows, inverse = np.unique(ids, return_inverse=True)
    pull = np.zeros((len(rows), DIM))
    # every hash of a word gets the word's gradient
    np.add.at(pull, inverse.reshape(-1), np.repeat(np.concatenate([t[1] for t in touched]), ids.shape[1], axis=0))
    pull /= len(batch)
    state.square[rows] += (pull**2).mean(axis=1)
    state.embedding[rows] -= 0.02 * pull / (np.sqrt(state.square[rows]) + 1e-6)[:, None]
    state.embedding[0] = 0
    state.step += 1
    scale = rate * np.sqrt(1 - 0.999**state.step) / (1 - 0.9**state.step)
    for p, g, m, v in zip(state.dense, gradients, state.first, state.second, strict=True):
        g /= len(batch)
        m *= 0.9
        m += 0.1 * g
        v *= 0.999
        v += 0.001 * g * g
        p -= scale * m / (np.sqrt(v) + 1e-8)
    return rows


def _train(rows: DataFrame, keys: np.ndarray, count: np.ndarray, totals: list[int], batch: int = 32, seed: int = 5) -> TextCNN:
    """Rounds over all ``rows`` (id, label, text): every shard is trained on by itself, then the models are averaged.

    A dense parameter is averaged by the rows of the shards, an embedding row by
    the steps that moved it. So what comes to the driver is a sum of the size of
    the model, and a single shard is trained on as if there were no shards.
    """
    width = 1 + len(BEGINNINGS)
    shards = max(1, math.ceil(sum(totals) / SHARD))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                listed, places = [], []
                for t in b.column(4).to_pylist():
                    known = words(t)
                    first: dict[bytes, int] = {}
                    places.append(np.array([first.setdefault(w, len(first)) for w in known], "<i4").tobytes())
                    listed.append(_rows(keys, hashes(list(first))).astype("<i4").tobytes())
                yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(listed, pa.binary()), pa.array(places, pa.binary())],
                                                 names=["shard", "id", "turn", "label", "words", "places"])

    turn = F.xxhash64("id", F.lit(seed))
    dealt = rows.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), "id", turn.alias("turn"), "label", "text")
    # written in the order of training, which so does not depend on how rows arrive; more partitions than shards keep most shards apart
    texts = durable(dealt.mapInArrow(numbered, "shard int, id long, turn long, label int, words binary, places binary")
                    .repartition(1 if shards == 1 else 4 * shards, "shard").sortWithinPartitions("shard", "turn", "id"), "zstd")
    state = _initial(count, totals, np.random.default_rng(seed))
    for _ in range(max(3, 5 - shards)):
        start = replace(state, embedding=state.embedding.astype(np.float32), square=state.square.astype(np.float32))

        def shard_models(batches: Iterator[pa.RecordBatch], start: _State = start) -> Iterator[pa.RecordBatch]:
            def fresh() -> tuple[_State, np.ndarray]:
                own = replace(start, embedding=start.embedding.astype(float), square=start.square.astype(float),
                              **{name: [p.copy() for p in getattr(start, name)] for name in ("dense", "first", "second")})
                return own, np.zeros(len(own.embedding), np.int64)

            def result() -> pa.RecordBatch:
                at, flat = np.flatnonzero(moved), own.flat()
                places = np.concatenate([at, -1 - np.arange(len(flat))])
                weights = np.concatenate([moved[at], np.full(len(flat), trained)]).astype(float)
                values = np.concatenate([np.column_stack([own.embedding[at], own.square[at]]), flat]) * weights[:, None]
                return pa.RecordBatch.from_arrays([pa.array(places), pa.array(weights), *map(pa.array, values.T)], names=["place", "weight", *VALUES])

            own, moved = fresh()
            shard, trained, waiting = None, 0, []

            def learn() -> None:
                nonlocal trained
                if waiting:
                    moved[_step(own, waiting)] += 1
                    trained += len(waiting)
                    waiting.clear()

            for b in batches:
                for n, y, listed, places in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                    if n != shard:
                        learn()
                        if trained:
                            yield result()
                            own, moved = fresh()
                        shard, trained = n, 0
                    waiting.append((y, np.frombuffer(listed, "<i4").reshape(-1, width), np.frombuffer(places, "<i4")))
                    if len(waiting) == batch:
                        learn()
            learn()
            if trained:
                yield result()

        sums = (texts.select("shard", "label", "words", "places").mapInArrow(shard_models, "place long, weight double, " + ", ".join(f"{v} double" for v in VALUES))
                .groupBy("place").agg(*[F.sum(c).alias(c) for c in ("weight", *VALUES)]).toArrow())
        place, weight = sums["place"].to_numpy(), sums["weight"].to_numpy()
        # single precision, so that the order of the sums does not show
        mean = (np.column_stack([sums[v].to_numpy() for v in VALUES]) / weight[:, None]).astype(np.float32).astype(float)
        kept = place >= 0
        state.embedding[place[kept]], state.square[place[kept]] = mean[kept, :DIM], mean[kept, DIM]
        state.take(mean[~kept][np.argsort(-place[~kept])])
    *filters, out, bias = state.dense
    used = np.abs(state.embedding).max(axis=1) > 0
    used[0] = True
    return TextCNN(keys[used], state.embedding[used].astype(np.float32), filters[:len(WIDTHS)], filters[len(WIDTHS):], out, float(bias[0]))


def _calibrate(model: TextCNN, scored: DataFrame, least: int = 20) -> None:
    """Set the thresholds from ``scored`` (score, label, lang): per language the cut of best F1, halfway to the scores on either side.

    Languages with fewer than ``least`` rows of a label take the cut over all
    rows, and that is 0.5 where it cannot be made either. Equal scores fall on
    one side. Scores are ordered and summed up by Spark; one row per language
    comes to the driver.
    """
    # the empty name stands for all rows
    each = scored.withColumn("name", F.explode(F.array_distinct(F.array(F.lit(""), F.coalesce("lang", F.lit(""))))))
    steps = durable(each.groupBy("name", "score").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("hits")))
    totals = steps.groupBy("name").agg(F.sum("hits").alias("total"), F.sum(F.col("n") - F.col("hits")).alias("others")).filter(F.least("total", "others") >= least)
    scanned = ordered_scan(steps, ["name"], [-F.col("score")], None,
                           {"rows": running_sum(F.col("n")), "found": running_sum(F.col("hits")), "below": next_value(F.col("score"))})
    f1 = 2 * F.col("found") / (F.col("rows") + F.col("total"))
    best = scanned.join(totals.select("name", "total"), "name").groupBy("name").agg(F.max_by(F.struct("score", "below"), F.struct(f1, "score")).alias("at"))
    for r in best.collect():
        cut = (r["at"]["score"] + (r["at"]["below"] or 0.0)) / 2
        if r["name"]:
            model.thresholds[r["name"]] = cut
        else:
            model.default_threshold = cut or 0.5


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id: str = "doc_id", text: str = "text", language: str = "lang") -> TextCNN:
    """Train and calibrate on every labelled row outside of the held-out fold.

    An id with several rows counts once. Spark counts in how many documents each
    hash occurs, trains shards of rows side by side and orders the scores of the
    calibration fold; only numbers of the size of the model come to the driver.
    A model has at most ``ROWS`` rows: beyond that, hashes that lean least to a
    label have none. Without both labels it knows nothing and gives every text
    the share of label 1, at most 0.25. ``language`` is read for the thresholds
    alone.
    """
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"), F.col(language).alias("lang")).filter(fold(F.col("id")) != HELD_OUT)
    # both grow with the input
    rows = durable(one_per_id(rows.join(growing(labelled(labels, label)), "id"), "text", "lang"), "zstd")
    learnt = rows.filter(F.col("fold") != CALIBRATION)
    found = {r["label"]: r["n"] for r in learnt.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    totals = [found.get(side, 0) for side in (0, 1)]
    if not all(totals):
        share = max(min(0.25, totals[1] / max(1, sum(totals))), 1e-6)
        zero = [np.zeros((w, DIM, FILTERS)) for w in WIDTHS]
        model = TextCNN(np.zeros(1, np.uint32), np.zeros((1, DIM), np.float32), zero, [np.zeros(FILTERS) for _ in WIDTHS], np.zeros(len(WIDTHS) * FILTERS),
                        math.log(share / (1 - share)))
    else:
        keys, count = _kept_hashes(learnt, totals)
        model = _train(learnt, keys, count, totals)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                got = model.scores([words(t) for t in part.column(0).to_pylist()])
                yield pa.RecordBatch.from_arrays([pa.array(got.astype(float)), part.column(1), part.column(2)], names=["score", "label", "lang"])

    later = rows.filter(F.col("fold") == CALIBRATION).select("text", "label", "lang")
    _calibrate(model, later.mapInArrow(scores, "score double, label int, lang string"))
    return model


def _kept_hashes(rows: DataFrame, totals: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that get a row, ascending from 0, and their documents of label 0 and of label 1, counted over all ``rows``."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                known = np.array(b.column(0).to_pylist(), np.int32)
                found = [np.unique(hashes(list(set(words(t))))) for t in b.column(1).to_pylist()]
                for side in (0, 1):
                    seen, n = np.unique(np.concatenate([np.zeros(0, np.uint32), *[f for f, y in zip(found, known, strict=True) if y == side]]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64)), pa.array(np.full(len(seen), side, np.int32)), pa.array(n.astype(np.int64))],
                                                     names=["hash", "label", "n"])

    n0, n1 = F.col("n0") + 0.5, F.col("n1") + 0.5
    lean = F.abs(F.log(n1 / (totals[1] + 1)) - F.log(n0 / (totals[0] + 1))) / F.sqrt(1 / n1 + 1 / n0)
    counted = durable(rows.select("label", "text").mapInArrow(held, "hash long, label int, n long")
                      .groupBy("hash").agg(*[F.sum(F.when(F.col("label") == side, F.col("n")).otherwise(0)).alias(f"n{side}") for side in (0, 1)])
                      .filter((F.col("hash") > 0) & (F.col("n0") + F.col("n1") >= LEAST_DOCS)).withColumn("lean", F.floor(lean * 64).cast("long")))
    # the least lean above which all hashes fit
    least, room = 0, ROWS
    for r in sorted(counted.groupBy("lean").agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        room -= r["n"]
        if room < 0:
            least = r["lean"] + 1
            break
    kept = counted.filter(F.col("lean") >= least).select("hash", "n0", "n1").toArrow()
    by_hash = np.argsort(kept["hash"].to_numpy())
    keys = np.concatenate([[0], kept["hash"].to_numpy()[by_hash]]).astype(np.uint32)
    return keys, np.stack([np.concatenate([[0], kept[f"n{side}"].to_numpy()[by_hash]]) for side in (0, 1)])


def score(docs: DataFrame, model: TextCNN, id: str = "doc_id", text: str = "text", language: str = "lang") -> DataFrame:
    """(id, held_out, score, predicted, rejected) per row.

    ``predicted`` is score >= 0.5; ``rejected`` is score >= the threshold of the
    row's language. Null and empty texts score like padding; ids may be null or
    repeat (a null id is in no fold); texts are scored whole; other columns are
    ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                scores = model.scores([words(t) for t in part.column(1).to_pylist()])
                cuts = np.array([model.threshold(x) for x in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(3), pa.array(scores.astype(float)), pa.array((scores >= 0.5).astype(np.int32)), pa.array(scores >= cuts)],
                    names=["id", "held_out", "score", "predicted", "rejected"])

    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), F.col(language).alias("lang"), (fold(F.col(id)) == HELD_OUT).alias("held_out"))
    kind = docs.schema[id].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int, rejected boolean").withColumnRenamed("id", id)


def accepted(docs: DataFrame, model: TextCNN, text: str = "text", language: str = "lang") -> DataFrame:
    """The rows, with all their columns, that score below the threshold of their language."""

    # numbered columns, so that names with dots or of any other kind pass through
    at_text, at_language = docs.columns.index(text), docs.columns.index(language)
    numbered = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                scores = model.scores([words(t) for t in part.column(at_text).to_pylist()])
                cuts = np.array([model.threshold(x) for x in part.column(at_language).to_pylist()])
                yield part.filter(pa.array(scores < cuts))

    return numbered.mapInArrow(run, numbered.schema).toDF(*docs.columns)
