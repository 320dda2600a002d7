"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from redliner.llm import variants
from tests.llm.frames import awkward, empty, with_clashes


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows):
    n = Counter()
    for id, text in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if id is None else id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += len(run) >= 5
    n = {w: k for w, k in n.items() if k >= 3}
    form, out = {}, []
    for w in n:
        found = [x for x in n if near(w, x)]
        best = min(found, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
        out.append((w, n[w], len(found), form[w], n.get(form[w])))
    for k, row in enumerate(out):
        root = row[0]
        while form[root] is not None:
            root = form[root]
        out[k] = (*row, root)
    return sorted(out, key=str)


def grouped(docs, **given):
    return sorted((tuple(r) for r in variants.variants(docs, **given).select("word", "n", "n_near", "form", "form_n", "root").collect()), key=str)


@pytest.mark.parametrize("leaf, depth", [(8, 32), (1, 2), (2, 4)])
def test_pairs_are_all_words_one_edit_apart_once_each(spark, leaf, depth):
    rng = random.Random(leaf)
    words = {"".join(rng.choice("abÀ") for _ in range(rng.randint(1, 7))) for _ in range(250)}
    words |= {"abcde" * 3 + w for w in ("", "x", "xy", "yx", "xyz", "bxy")} | {"xabcde" + "abcde" * 2, "aaaa", "aaaaa", "aaaaaa", "z"}
    got = [tuple(sorted(r)) for r in variants.pairs(spark.createDataFrame([(w,) for w in words], "word string"), leaf, depth).collect()]
    assert sorted(got) == sorted((a, b) for a in words for b in words if a < b and near(a, b))


def test_few_words_and_none(spark):
    frame = spark.createDataFrame([("hello",), ("hallo",), ("hell",)], "word string")
    assert {tuple(sorted(r)) for r in variants.pairs(frame).collect()} == {("hallo", "hello"), ("hell", "hello")}
    assert variants.pairs(frame.limit(0)).collect() == []


def test_groups_equal_brute_force(spark):
    rng = random.Random(7)
    base = ["station", "stations", "wandern", "wander", "élégant", "ÉLÉGANT", "Elegant", "aaaaaa"]
    slip = lambda w: w if rng.random() < 0.5 else w[:(i := rng.randrange(len(w)))] + rng.choice(["", "x", w[i]]) + w[i + 1:]
    rows = [(k, " ".join(slip(rng.choice(base)) for _ in range(60)) + "\n1st_word-Word's") for k in range(80)]
    rows += [(1000 + k, f"chain{e}") for k, e in enumerate(["aaa"] * 4 + ["aab"] * 9 + ["abb"] * 20)]
    got = grouped(spark.createDataFrame(rows, "doc_id long, text string"), leaf=3, depth=4)
    assert got == brute(rows) and any(r[3] and r[5] != r[3] for r in got)


def test_awkward_rows(spark):
    docs = awkward(spark, [(k, "x" * 40_000 + " naïve Naïves NAïVE " * 3, "es", "s2", 9) for k in (6, 60, 61)])
    assert grouped(with_clashes(docs)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert grouped(empty(spark)) == []
