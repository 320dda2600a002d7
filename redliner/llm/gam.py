"""Quality: a generalised additive model with pairwise interactions.

A text becomes a row of shares and counts. Cyclic boosting visits one feature
after another and fits a shallow tree to the gradient over the feature's bins;
the trees of a feature add up to one lookup table. Then the pairs of features
whose joint cuts explain most of what is left get tables of their own. A score
is the logistic function of a sum of looked-up values.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redliner.llm.folds import CALIBRATION, HELD_OUT, fold, label_sample, one_per_id

FEATURES = (
    "log_chars", "log_words", "log_lines", "upper", "digit", "white", "exclaim", "pipe", "symbol", "stop", "comma", "other_punctuation", "non_ascii",
    "word_length", "longest_word", "distinct_words", "commonest_word", "repeated_next", "short_words", "capital_words", "marked_words",
    "words_a_line", "distinct_lines",
)
SAMPLE = 20_000
BINS, PAIR_BINS = 48, 12
ROUNDS, PAIR_ROUNDS, PAIRS = 150, 40, 6
RATE, SMOOTHING = 0.15, 2.0
PREDICTED_FROM = 0.3

_CLASS = np.zeros(256, np.int64)
for _n, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c", b"!", b"|", b"*#$%&@^~=+<>_\\{}[]", b".", b",", b"\"'():;?/-`"), 1):
    _CLASS[list(_bytes)] = _n
_CLASS[128:] = 10
_MARKS = b"*#$%&!"


def text_features(text: str | None) -> list[float]:
    """The features of a whole text, in the order of ``FEATURES``; all 0 for null and empty ones."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, w = len(raw), len(words)
    share = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=11) / n
    lengths = [len(x) for x in words]
    count = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    same = sum(a == b for a, b in zip(words, words[1:]))
    return [
        float(np.log1p(n)), float(np.log1p(w)), float(np.log1p(len(lines))), *share[1:8].tolist(), share[8], share[9], share[10],
        sum(lengths) / w, float(np.log1p(max(lengths))), len(count) / w, max(count.values()) / w, same / w,
        sum(x <= 3 for x in lengths) / w, sum(x.isupper() for x in words) / w, sum(x[-1] in _MARKS for x in words) / w,
        float(np.log1p(w / len(lines))), len(set(lines)) / len(lines),
    ]


@dataclass
class AdditiveModel:
    edges: list[np.ndarray]
    pair_edges: list[np.ndarray]
    base: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for k, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[k], x[:, k], side="right")]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[np.searchsorted(self.pair_edges[a], x[:, a], side="right"), np.searchsorted(self.pair_edges[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cut(g: np.ndarray, h: np.ndarray, low: int, high: int) -> tuple[float, int]:
    """Gain and place of the best cut of bins [low, high)."""
    if high - low < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g[low:high])[:-1], np.cumsum(h[low:high])[:-1]
    all_g, all_h = g[low:high].sum(), h[low:high].sum()
    worth = lambda a, b: a * a / (b + SMOOTHING)
    gain = worth(left_g, left_h) + worth(all_g - left_g, all_h - left_h) - worth(all_g, all_h)
    at = int(gain.argmax())
    return float(gain[at]), low + at + 1


def _shallow_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values per bin of a tree of depth two."""
    out = np.zeros(len(g))
    gain, mid = _cut(g, h, 0, len(g))
    spans = [(0, mid), (mid, len(g))] if gain > 1e-9 else [(0, len(g))]
    leaves = []
    for low, high in spans:
        gain, at = _cut(g, h, low, high)
        leaves += [(low, at), (at, high)] if gain > 1e-9 else [(low, high)]
    for low, high in leaves:
        out[low:high] = -g[low:high].sum() / (h[low:high].sum() + SMOOTHING)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and table of the best pair of cuts, one on each axis."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    quads = []
    for c in (cg, ch):
        a = c[:-1, :-1]
        top, left = c[:-1, -1:], c[-1:, :-1]
        quads.append((a, top - a, left - a, c[-1, -1] - top - left + a))
    gain = sum(x * x / (y + SMOOTHING) for x, y in zip(*quads, strict=True))
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    table = np.empty_like(g)
    cells = [(slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None))]
    for cell in cells:
        table[cell] = -g[cell].sum() / (h[cell].sum() + SMOOTHING)
    return float(gain[i, j] - cg[-1, -1] ** 2 / (ch[-1, -1] + SMOOTHING)), table


def train(x: np.ndarray, y: np.ndarray, x_later: np.ndarray, y_later: np.ndarray) -> AdditiveModel:
    """Boost on (x, y); of all rounds the one with the least loss on the later rows is kept.

    Without rows of both labels every text gets the share of label 1, and 1 if
    there are no rows at all.
    """
    cuts = lambda n: [np.unique(np.quantile(x[:, k], np.linspace(0, 1, n + 1)[1:-1])) if len(x) else np.zeros(0) for k in range(len(FEATURES))]
    model = AdditiveModel(cuts(BINS), cuts(PAIR_BINS))
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 1 - 1e-3
    model.base = float(np.log(share / (1 - share)))
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    if len(set(y.tolist())) < 2:
        return model
    if not len(y_later):
        x_later, y_later = x, y
    place = lambda edges, rows: [np.searchsorted(e, rows[:, k], side="right") for k, e in enumerate(edges)]
    bins, later_bins = place(model.edges, x), place(model.edges, x_later)
    f, f_later = np.full(len(y), model.base), np.full(len(y_later), model.base)
    loss = lambda: float(np.mean(np.logaddexp(0, np.where(y_later == 1, -f_later, f_later))))
    best, kept = loss(), [t.copy() for t in model.tables]
    for _ in range(ROUNDS):
        for k, table in enumerate(model.tables):
            p = 1 / (1 + np.exp(-f))
            g, h = np.bincount(bins[k], p - y, len(table)), np.bincount(bins[k], p * (1 - p), len(table))
            step = RATE * _shallow_tree(g, h)
            table += step
            f += step[bins[k]]
            f_later += step[later_bins[k]]
        if (now := loss()) < best:
            best, kept = now, [t.copy() for t in model.tables]
    model.tables = kept
    total = lambda b: model.base + sum(t[c] for t, c in zip(kept, b, strict=True))
    f, f_later = total(bins), total(later_bins)
    pair_bins, later_pair_bins = place(model.pair_edges, x), place(model.pair_edges, x_later)

    def sums(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        shape = len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1
        cell = pair_bins[a] * shape[1] + pair_bins[b]
        return tuple(np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (p - y, p * (1 - p)))

    wide = [k for k in range(len(FEATURES)) if len(model.pair_edges[k])]
    gains = sorted(((-_pair_tree(*sums(a, b))[0], (a, b)) for a, b in combinations(wide, 2)))
    model.pairs = [pair for _, pair in gains[:PAIRS]]
    tables = [np.zeros((len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1)) for a, b in model.pairs]
    kept = [t.copy() for t in tables]
    for _ in range(PAIR_ROUNDS):
        for (a, b), table in zip(model.pairs, tables, strict=True):
            step = RATE * _pair_tree(*sums(a, b))[1]
            table += step
            f += step[pair_bins[a], pair_bins[b]]
            f_later += step[later_pair_bins[a], later_pair_bins[b]]
        if (now := loss()) < best:
            best, kept = now, [t.copy() for t in tables]
    model.pair_tables = kept
    return model


def _featured(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return np.array([text_features(t) for t in batch.column(column).to_pylist()], float).reshape(-1, len(FEATURES))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> AdditiveModel:
    """Train on at most ``sample`` labelled rows outside of the held-out fold; only their features come to the driver.

    An id with several rows counts once, so the bound holds for rows as for ids.
    """
    # at most `sample` rows of three numbers, so it may be broadcast
    chosen = F.broadcast(label_sample(labels, label, sample))
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).join(chosen, "id").select("id", "label", "fold", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [row.tobytes() for row in _featured(b, 3)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(held, pa.binary())], names=["id", "label", "fold", "features"])

    got = one_per_id(rows.mapInArrow(run, "id long, label int, fold int, features binary"), "features").toArrow()
    raw = got["features"].to_pylist()
    x = np.frombuffer(b"".join(raw), float).reshape(-1, len(FEATURES))
    ids, y, folds = (np.array(got[c].to_pylist(), np.int64) for c in ("id", "label", "fold"))
    # a fixed order, so that sums do not depend on how rows arrive
    order = np.argsort(ids)
    x, y, later = x[order], y[order], folds[order] == CALIBRATION
    return train(x[~later], y[~later], x[later], y[later])


def score(docs: DataFrame, model: AdditiveModel, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) per row; ``predicted`` is score >= 0.3.

    Null and empty texts are scored as a row of zeros; ids may be null (in no
    fold) or repeat; texts are read whole; other columns are ignored; an empty
    table gives an empty result. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                scores = model.scores(_featured(part, 2))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scores), pa.array((scores >= PREDICTED_FROM).astype(np.int32))],
                                                 names=["id", "held_out", "score", "predicted"])

    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(id).alias("id"), (fold(F.col(id)) == HELD_OUT).alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id)
