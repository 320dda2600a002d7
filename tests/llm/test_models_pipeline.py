"""Classifiers on held-out rows, and the pipeline against a brute-force version."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from redliner.llm import gam, packing, pseudonyms, site_lines, textcnn
from redliner.llm.folds import fold, one_per_id
from redliner.llm.word_tokens import WordTokenizer, vocabulary_path
from tests.llm.frames import awkward, empty, prose, with_clashes
from tests.llm.test_groups import brute

BAD = ["skunkface", "grubling", "zzzrat"]


def corpus(n=400):
    """(documents, labels): one in six toxic, one in five of low quality."""
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(n):
        words = prose(5000 + i, rng.randint(30, 90)).split()
        toxic, low = i % 6 == 0, i % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        if low:
            words = [w + "###" for w in words]
        docs.append((i, " ".join(words), rng.choice(["en", "de"]), f"s{i % 3}", 1))
        labels.append((i, int(not low), int(toxic)))
    return docs, labels


def frames(spark, extra=(), n=400):
    docs, labels = corpus(n)
    return awkward(spark, [(1000 + d[0], *d[1:]) for d in docs] + list(extra)), spark.createDataFrame(
        [(1000 + a, b, c) for a, b, c in labels] + [(None, 1, 1), (1003, None, None), (99_999, 1, 0)], "doc_id long, quality int, toxic int")


def held_out(scored, labels, label, cut):
    rows = scored.join(labels, "doc_id").filter("held_out").filter(F.col(label).isNotNull()).collect()
    assert len(rows) > 50
    return sum((r["score"] >= cut) == (r[label] == 1) for r in rows) / len(rows)


def test_toxicity_learns_and_takes_awkward_rows(spark):
    docs, labels = frames(spark)
    model = textcnn.fit(with_clashes(docs), labels)
    scored = textcnn.score(with_clashes(docs), model)
    assert held_out(scored, labels, "toxic", 0.5) > 0.97
    rows = scored.collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert {r["doc_id"]: r["held_out"] for r in rows if r["doc_id"]} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in {r["doc_id"] for r in rows if r["doc_id"]}}
    kept = textcnn.accepted(with_clashes(docs), model)
    assert kept.columns == with_clashes(docs).columns and kept.count() == sum(not r["rejected"] for r in rows)
    assert textcnn.score(empty(spark), model).collect() == [] and textcnn.accepted(empty(spark), model).collect() == []


def test_a_score_does_not_depend_on_batches_or_windows(spark, monkeypatch):
    docs, labels = frames(spark)
    model = textcnn.fit(docs, labels)
    lists = [textcnn.words(r["text"]) for r in docs.limit(60).collect()]
    whole = model.scores(lists)
    monkeypatch.setattr(textcnn, "WINDOW", 7)
    assert np.allclose(whole, [model.scores([t])[0] for t in lists])


def test_models_without_labels_reject_nothing(spark):
    docs, labels = frames(spark, n=20)
    for some in (labels.limit(0), labels.withColumn("toxic", F.lit(0)).withColumn("quality", F.lit(1))):
        assert textcnn.accepted(docs, textcnn.fit(docs, some)).count() == docs.count()
        assert gam.score(docs, gam.fit(docs, some)).filter("predicted = 0").isEmpty()


def test_an_id_with_many_rows_counts_once(spark):
    docs, labels = frames(spark)
    chosen = labels.filter("doc_id is not null and toxic is not null").filter(fold(F.col("doc_id")) > 1).orderBy("doc_id").first()["doc_id"]
    many = spark.range(10_000).select(F.lit(chosen).alias("doc_id"), F.concat(F.lit("grubling row "), F.col("id").cast("string")).alias("text"),
                                      F.lit("en").alias("lang"), F.lit("s1").alias("source"), F.lit(1).alias("n_chars"))
    rows = [tuple(r) for r in docs.unionByName(many).groupBy("doc_id").agg(
        F.min(F.struct(F.xxhash64("text", "lang"), "text", "lang")).alias("r")).select("doc_id", "r.text", "r.lang").collect()]
    once = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got, expected = textcnn.fit(docs.unionByName(many), labels), textcnn.fit(once, labels)
    assert np.array_equal(got.keys, expected.keys) and np.allclose(got.embedding, expected.embedding) and got.thresholds == expected.thresholds
    sampled = one_per_id(docs.unionByName(many).select(F.col("doc_id").alias("id"), F.lit(1).alias("label"), F.lit(2).alias("fold"), "text"), "text")
    assert sampled.filter(F.col("id") == chosen).count() == 1


def plain_score(model, text):
    """Convolution and pooling of one text, word by word."""
    row = dict(zip(model.keys.tolist(), model.embedding.astype(float), strict=True))
    vectors = []
    for w in re.findall(rb"[a-z0-9\x80-\xff]+", (text or "").lower().encode()):
        found = [zlib.crc32(w, 1)] + [zlib.crc32(w[:k]) for k in textcnn.BEGINNINGS if len(w) > k]
        vectors.append(sum((row.get(h, row[0]) for h in found), np.zeros(textcnn.DIM)))
    vectors = (vectors or [np.zeros(textcnn.DIM)]) + [np.zeros(textcnn.DIM)] * (max(textcnn.WIDTHS) - 1)
    total, at = model.bias, 0
    for width, filters, biases in zip(textcnn.WIDTHS, model.filters, model.biases, strict=True):
        for f in range(textcnn.FILTERS):
            best = max(sum(float(vectors[n + j] @ filters[j][:, f]) for j in range(width)) for n in range(len(vectors) - max(textcnn.WIDTHS) + 1))
            total += max(best + biases[f], 0) * model.out[at]
            at += 1
    return 1 / (1 + math.exp(-total))


def test_scores_equal_plain_convolution(spark):
    docs, labels = frames(spark)
    model = textcnn.fit(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.filter("doc_id >= 1000 and doc_id < 1060").collect()}
    got = {r["doc_id"]: r["score"] for r in textcnn.score(docs.filter("doc_id in (2, 3) or doc_id >= 1000 and doc_id < 1060"), model).collect()}
    assert got.keys() == texts.keys() | {2, 3}
    assert all(abs(s - plain_score(model, texts.get(i))) < 1e-4 for i, s in got.items())


def test_quality_learns_and_takes_awkward_rows(spark):
    docs, labels = frames(spark)
    model = gam.fit(with_clashes(docs), labels)
    scored = gam.score(with_clashes(docs), model)
    assert held_out(scored, labels, "quality", 0.3) > 0.97
    rows = scored.collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert gam.score(empty(spark), model).collect() == []


def test_pair_tables_learn_what_single_features_cannot():
    rng = np.random.default_rng(0)
    x = rng.random((4000, len(gam.FEATURES)))
    y = ((x[:, 3] > 0.5) ^ (x[:, 8] > 0.5)).astype(int)
    model = gam.train(x[:3000], y[:3000], x[3000:3500], y[3000:3500])
    assert (3, 8) in model.pairs
    assert ((model.scores(x[3500:]) >= 0.5) == y[3500:]).mean() > 0.9


def test_features_of_texts():
    named = dict(zip(gam.FEATURES, gam.text_features("Ab ab ab!!\nAb ab"), strict=True))
    assert named["distinct_words"] == 3 / 5 and named["repeated_next"] == 0 and named["marked_words"] == 1 / 5
    assert gam.text_features(None) == gam.text_features(" \n") == [0.0] * len(gam.FEATURES)


def test_folds(spark):
    got = spark.createDataFrame([(5,), (None,), (123,)], "x long").select(fold(F.col("x"))).collect()
    assert [r[0] for r in got] == [zlib.crc32(b"5") % 5, -1, zlib.crc32(b"123") % 5]


def dropped_lines(rows):
    """Line dedup in plain Python."""
    total, seen = Counter(r[3] for r in rows), defaultdict(Counter)
    for r in rows:
        seen[r[3]].update({x.strip(" ") for x in (r[1] or "").split("\n")} - {""})
    hot = {(h, x) for h, c in seen.items() for x, n in c.items() if n >= site_lines.MIN_PAGES and n > site_lines.RATIO * total[h]}
    clean = lambda h, t: None if t is None else "\n".join(x for x in t.split("\n") if (h, x.strip(" ")) not in hot)
    return [(r[0], clean(r[3], r[1]), *r[2:]) for r in rows]


def test_pipeline_equals_brute_force(spark, tmp_path):
    rng = random.Random(2)
    extra = [(3000 + i, f"shared head of the site\n{prose(8000 + i // 3, 70)} {i % 3}", "en", "s1", 1) for i in range(60)]
    extra += [(4000 + i, f"{prose(9000 + i, 40)} mail a{i}.{rng.randint(10, 99)}@x.example.com or 4046195599780836", "en", "s2", 1) for i in range(10)]
    docs, labels = frames(spark, extra)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    model = textcnn.fit(docs, labels)
    rows = [tuple(r) for r in docs.collect()]
    scores = model.scores([textcnn.words(r[1]) for r in rows])
    rows = dropped_lines([r for r, s in zip(rows, scores, strict=True) if s < model.threshold(r[2])])
    assert any(r[0] and r[0] >= 3000 and "shared head" not in r[1] for r in rows)
    component = brute([(r[0], r[1]) for r in rows])
    rows = [r for r in rows if r[0] is None or component[r[0]] == r[0]]
    repeated = {(r[0], r[1]) for r in rows if r[0] is not None}
    rows = [*repeated, *((None, r[1]) for r in rows if r[0] is None)]
    moved = pseudonyms.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r["values_changed"] for r in moved) >= 20
    library = WordTokenizer(vocabulary_path()).library
    want = []
    for r in moved:
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, packing.END]
        want += [(r["doc_id"], k // 2048, len(ids[k:k + 2048]), zlib.crc32(np.array(ids[k:k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048)]
    assert sorted(((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in got), key=str) == sorted(want, key=str)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "pii", "packing"]


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    docs, labels = frames(spark, n=40)
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = with_clashes(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert out.select("lines_dropped").distinct().collect()[0][0] == "extra lines_dropped"


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    """Rows beyond any sample count, and shards learn what one does."""
    rare = [(50_000 + i, f"{prose(20_000 + i, 20)} {word}", "en", "s", 1) for i, word in enumerate(["qqplain", "qqvile"] * 4500)]
    docs = spark.createDataFrame(rare, "doc_id long, text string, lang string, source string, n_chars int")
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.col("text").endswith("qqvile").cast("int").alias("toxic"))
    sizes, initial = [], textcnn._initial
    monkeypatch.setattr(textcnn, "_initial", lambda count, totals, rng: sizes.append(totals) or initial(count, totals, rng))
    monkeypatch.setattr(textcnn, "SHARD", 1024)
    model = textcnn.fit(docs, labels)
    known = labels.withColumn("f", fold(F.col("doc_id"))).filter("f > 1")
    assert sizes == [[known.filter(F.col("toxic") == side).count() for side in (0, 1)]] and sum(sizes[0]) > 5000
    assert held_out(textcnn.score(docs, model), labels, "toxic", 0.5) > 0.99
    # the hashes that lean most are kept
    monkeypatch.setattr(textcnn, "ROWS", 7)
    kept = textcnn._kept_hashes(known.join(docs, "doc_id").select(F.col("toxic").alias("label"), "text"), sizes[0])[0]
    marked = {zlib.crc32(w, 1) for w in (b"qqvile", b"qqplain")} | {zlib.crc32(w[:k]) for w in (b"qqvile", b"qqplain") for k in textcnn.BEGINNINGS if len(w) > k}
    assert set(kept.tolist()) == marked | {0}


def test_thresholds_equal_the_best_cut_of_all_rows(spark):
    rng = random.Random(4)
    rows = [(round(rng.random() * 0.6 + 0.3 * y, 2), y, lang) for lang in ("en", "de", None, "fr") for y in (0, 1) for _ in range(5 if lang == "fr" else 60)]
    model = textcnn.TextCNN(np.zeros(1), np.zeros((1, 1)), [], [], np.zeros(1), 0.0)
    textcnn._calibrate(model, spark.createDataFrame(rows, "score double, label int, lang string").repartition(5))

    def cut(some):
        scores = sorted({s for s, _, _ in some}, reverse=True)
        f1 = [2 * sum(y for s, y, _ in some if s >= c) / (sum(s >= c for s, _, _ in some) + sum(y for _, y, _ in some)) for c in scores]
        best = f1.index(max(f1))
        return (scores[best] + (scores[best + 1] if best + 1 < len(scores) else 0)) / 2

    assert model.default_threshold == cut(rows)
    assert model.thresholds == {x: cut([r for r in rows if r[2] == x]) for x in ("en", "de")}
