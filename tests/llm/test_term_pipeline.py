"""Ranked lexical search against brute force."""

import math
import random
import re

import pytest

from redliner.llm import term_pipeline
from tests.llm.frames import awkward, empty, prose, with_clashes

RUN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string"


def words(text):
    return RUN.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, best):
    docs = [(d, w) for d, t in docs if (w := words(t))]
    N, L = len(docs), sum(len(w) for _, w in docs)
    out = []
    for item, text in items:
        scored = []
        for d, w in docs:
            m, score = 100 - 50 + (50 * len(w) * N) // L, 0
            for t in set(words(text)):
                if tf := w.count(t):
                    df = sum(t in v for _, v in docs)
                    score += math.floor(1000 * math.log((2 * N + 2) / (2 * df + 1))) * ((1000000000 * tf) // (1000 * tf + 20 * m))
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(item, r, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(scored)[:best], 1)]
    return sorted(out, key=str)


def ranked(docs, items, **given):
    return sorted((tuple(r) for r in term_pipeline.rank(docs, items, **given).select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_terms_are_those_of_the_pattern():
    for text in ["", None, "A-b\x7fÉÉ_c9 \t\x00日本,x", "ÀB", prose(3)]:
        assert sorted(term_pipeline.terms(text).elements()) == sorted(words(text))


@pytest.mark.parametrize("block, group, best", [(8_192, 256, 50), (7, 2, 3), (16, 3, 1)])
def test_equal_to_brute_force(spark, block, group, best):
    rng = random.Random(block)
    vocabulary = [f"w{k}" for k in range(60)]
    text = lambda n: " ".join(vocabulary[min(int(rng.expovariate(0.08)), 59)] for _ in range(n))
    docs = [(k, text(rng.randint(0, 30))) for k in range(150)] + [(200 + k, "w1 w2 w3") for k in range(40)]
    items = [(k, text(rng.randint(1, 9))) for k in range(8)] + [(90, None), (91, ""), (92, "unknown words"), (None, "w1"), (0, "w2 W2 w2 w40")]
    got = ranked(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, ITEMS), block=block, group=group, best=best)
    assert got == brute(docs, items, best)


def test_awkward_rows(spark):
    docs = awkward(spark, [(None, "one two three", "en", "s", 1), (9, "One TWO three", "en", "s", 1)])
    items = [(1, prose(1)), (2, "one two"), (2, "one two"), (3, prose(3, 3_000)), (4, "x" * 40_000)]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = ranked(with_clashes(docs), with_clashes(spark.createDataFrame(items, ITEMS)), block=4)
    assert got == brute(rows, items, term_pipeline.BEST)


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "one")], ITEMS)
    assert ranked(empty(spark), items) == []
    assert ranked(awkward(spark), spark.createDataFrame([], ITEMS)) == []
    assert ranked(spark.createDataFrame([(1, None), (2, " ,")], "doc_id long, text string"), items) == []
