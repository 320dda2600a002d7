"""Near duplicates of texts and vectors, components, and search, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from redliner.llm import components, metric_join, setsketch, threshold_topk
from tests.llm.frames import DOCS, awkward, empty, prose, with_clashes


def united(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    links += [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(70)]
    rng.shuffle(links)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame([*links, (None, 5)], "a long, b long"), "a", "b").collect()}
    want = united({x for e in links for x in e}, links)
    met = {x for a, b in links if a != b for x in (a, b)}
    assert got == {k: v for k, v in want.items() if k in met}


def word_set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def family(seed, members, words=80, edits=3):
    """Texts that are similar to each other around the threshold."""
    rng = random.Random(seed)
    base = prose(seed, words).split()
    out = []
    for m in range(members):
        own = list(base)
        for e in range(rng.randint(0, edits)):
            own[rng.randrange(words)] = f"edit{m}x{e}"
        out.append(" ".join(own))
    return out


def brute(rows):
    sets = [(i, word_set(t)) for i, t in rows if i is not None]
    links = [(a, b) for n, (a, s) in enumerate(sets) for b, t in sets[:n] if s and t and 100 * len(s & t) >= 75 * len(s | t)]
    return united({i for i, _ in sets}, links)


@pytest.mark.parametrize("direct", [24, 2])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, direct):
    # with small limits, groups also go through the blocks of documents
    monkeypatch.setattr(setsketch, "DIRECT", direct)
    monkeypatch.setattr(setsketch, "BLOCK", 512 if direct > 2 else 8)
    # blocks by documents in one case, by shingles in the other
    monkeypatch.setattr(setsketch, "BLOCK_SHINGLES", 1_000_000 if direct > 2 else 300)
    texts = [t for seed in range(6) for t in family(seed, 25)] + [prose(900 + i) for i in range(30)] + ["A b", "a B", "a  b\n", "a b c"]
    rows = list(enumerate(texts, 1000))
    docs = awkward(spark, [(i, t, "en", "s", 1) for i, t in rows])
    rows += [(r["doc_id"], r["text"]) for r in awkward(spark).collect()]
    out = setsketch.near_duplicates(with_clashes(docs)).collect()
    want = brute(rows)
    assert len(out) == docs.count()
    assert {r["doc_id"]: r["component_id"] for r in out if r["doc_id"] is not None} == want
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in out)
    sizes = {i: len(word_set(t)) for i, t in rows}
    assert all(r["n_shingles"] == sizes[r["doc_id"]] for r in out if r["doc_id"] not in (None, 7))


def test_one_id_with_many_texts(spark):
    text = lambda i: " ".join(f"w{i}x{j}" for j in range(12))
    rows = [(7, text(i)) for i in range(2000)] + [(900, text(1500)), (901, text(3) + " more"), (902, text(5000))]
    found = setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found.count() == 2003
    assert {tuple(r) for r in found.select("doc_id", "component_id", "kept").distinct().collect()} == {
        (7, 7, True), (900, 7, False), (901, 7, False), (902, 902, True)}


def test_near_duplicates_of_an_empty_table(spark):
    assert setsketch.near_duplicates(empty(spark)).collect() == []
    assert setsketch.one_per_group(empty(spark)).collect() == []


def test_one_per_group_keeps_rows_and_columns(spark):
    docs = with_clashes(awkward(spark, [(20 + i, prose(77), "en", "s", i) for i in range(5)]))
    kept = setsketch.one_per_group(docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=lambda x: (x is None, x))
    assert ids == [1, 2, 3, 4, 5, 6, 7, 7, 20, None, None]


def test_sketches_are_mergeable_and_estimate_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = pool[:2000], pool[500:2400]
    assert np.array_equal(np.maximum(setsketch.registers(a), setsketch.registers(b)), setsketch.registers(np.union1d(a, b)))
    multiply, add = (rng.integers(0, 2**32, 4000, dtype=np.uint64).astype(np.uint32) for _ in range(2))
    sketch = lambda x: setsketch.registers(x, multiply | np.uint32(1), add)[None]
    got = setsketch.likely_similarity(sketch(a), sketch(b), np.array([2000.0]), np.array([1900.0]))
    assert abs(got[0] - 1500 / 2400) < 0.05


VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(seed=0, n=300, dim=12, labels=3):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(20, dim))
    x = centers[rng.integers(0, 20, n)] + rng.normal(size=(n, dim)) * 0.18
    rows = [(i, [float(v) for v in x[i].astype(np.float32)], int(rng.integers(0, labels))) for i in range(n)]
    nan, inf = float("nan"), float("inf")
    odd = [(1000, None, 1), (1001, [0.0] * dim, 1), (1002, [nan] * dim, 1), (1003, [inf] + [1.0] * (dim - 1), 0), (1004, [None] * dim, 1),
           (1005, [1.0] * dim, None), (1006, [1.0] * dim, None), (None, rows[0][1], rows[0][2]), (1007, [1.0, 0.0], 1), (1008, [2.0, 0.0], 1), (1009, [], 1)]
    same = [(2000 + i, rows[3][1], rows[3][2]) for i in range(40)]
    return rows + odd + same + [rows[5]]


def test_large_buckets_go_through_the_likelihood_step(spark, monkeypatch):
    rng = np.random.default_rng(3)
    sets = []
    for n in rng.integers(3, 300, 12):
        whole = rng.integers(1, 2**62, int(n), dtype=np.uint64)
        for share in (0, 0.1, 0.3, 0.5):
            part = whole.copy()
            part[rng.random(len(part)) < share] = rng.integers(1, 2**62, 1, dtype=np.uint64)
            sets.append(np.unique(part))
    sketch, n = np.stack([setsketch.registers(x) for x in sets]), np.array([len(x) for x in sets], float)
    a, b = np.indices((len(sets), len(sets))).reshape(2, -1)
    want = setsketch.likely_similarity(sketch[a], sketch[b], n[a], n[b]) >= setsketch.LEAST_LIKELY
    got = setsketch.is_likely(sketch, sketch, n, n, setsketch.LEAST_LIKELY)
    assert np.array_equal(got.ravel(), want) and len(sets) < want.sum() < want.size / 4
    assert not setsketch.is_likely(sketch, sketch[:1] * 0, n, np.zeros(1), setsketch.LEAST_LIKELY).any()
    rows = spark.createDataFrame([(i, x.view(np.int64).tolist()) for i, x in enumerate(sets)], "id long, items array<bigint>")
    large = rows.select(F.lit(1).cast("long").alias("key"), "id", F.lit(2).alias("blocks"))
    linked = {tuple(r) for r in setsketch._block_links(large, rows, 75).collect()}
    assert {i for pair in linked for i in pair} >= {0, 1} and all(x // 4 == y // 4 for x, y in linked)
    # what is not likely is not compared
    monkeypatch.setattr(setsketch, "LEAST_LIKELY", 1.01)
    assert setsketch._block_links(large, rows, 75).collect() == []


@pytest.mark.parametrize("block", [8192, 16])
def test_near_vectors_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(metric_join, "BLOCK", block)
    rows = vectors()
    ok = lambda v: v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v)
    links, count = [], [0] * len(rows)
    for n, (a, v, k) in enumerate(rows):
        for m, (b, w, j) in enumerate(rows[:n]):
            if None in (a, b, k, j) or k != j or not ok(v) or not ok(w) or len(v) != len(w):
                continue
            x, y = np.array(v, float), np.array(w, float)
            if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.93:
                links.append((a, b))
                count[n] += 1
                count[m] += 1
    groups = united({r[0] for r in rows if r[0] is not None}, links)
    want = sorted(((r[0], c, groups.get(r[0]), r[0] is None or groups[r[0]] == r[0]) for r, c in zip(rows, count, strict=True)), key=str)
    frame = with_clashes(spark.createDataFrame(rows, VECTORS).withColumnRenamed("label", "kind")).withColumnRenamed("label", "label_extra")
    got = metric_join.near_vectors(frame, label="kind")
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert len(links) > 500
    assert metric_join.near_vectors(spark.createDataFrame([], VECTORS)).collect() == []


@pytest.mark.parametrize("block, depth", [(4096, 16), (37, 1)])
def test_top_k_equals_brute_force(spark, monkeypatch, block, depth):
    monkeypatch.setattr(threshold_topk, "BLOCK", block)
    monkeypatch.setattr(threshold_topk, "QUERY_BLOCK", 3)
    rows = vectors(3)
    ints = {}
    table = []
    for n, (i, v, _) in enumerate(rows):
        if i is not None and (raw := threshold_topk.integers(v)) is not None:
            table.append((i, n, np.frombuffer(raw, "<i8")))
            if i % 50 == 0:
                ints[i] = table[-1][2]
    want = []
    for q, x in ints.items():
        scored = sorted((-int(x @ y), i) for i, _, y in table if i != q and len(y) == len(x))[:5]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    got = threshold_topk.top_k(with_clashes(spark.createDataFrame(rows, VECTORS)).withColumnRenamed("row", "r2"))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert threshold_topk.top_k(spark.createDataFrame([], VECTORS)).collect() == []


def test_the_threshold_ends_the_search_early():
    rng = np.random.default_rng(2)
    x = rng.integers(-50, 50, (4000, 4))
    x[:6] = 1000
    block = threshold_topk.Block(np.arange(4000), x)
    rows, scores = block.search(np.array([900.0, 900, 900, 900]), 3, 5)
    assert sorted(block.ids[rows].tolist()) == [0, 1, 2, 4, 5] and set(scores) == {3_600_000.0}
    assert block.search(np.zeros(4), 3, 5) is None


def test_a_nul_byte_is_part_of_a_word(spark):
    docs = spark.createDataFrame([(1, "a\x00b", "en", "s", 1), (2, "a b", "en", "s", 1), (3, "A\tb", "en", "s", 1)], DOCS)
    got = {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in setsketch.near_duplicates(docs).collect()}
    assert got == {1: (1, 1), 2: (2, 1), 3: (2, 1)}
