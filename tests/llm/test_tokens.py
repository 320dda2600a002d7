"""Token files, byte-level BPE and packing, against the libraries and exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from redliner.llm import byte_bpe, huffman, packing
from redliner.llm.word_tokens import WordTokenizer, vocabulary_path
from tests.llm.frames import awkward, empty, prose, with_clashes

ODD = ["don't I'LL it's 'tis <|endoftext|> a<|startoftext|>b", "école ́ x", "ΣΑΣ Σ İstanbul ŒUVRE Ærø", "日本語 テスト 123 ½ ²",
       "tab\tnew\x0bline\x0c\x1c\x1dz y x　w\x85v", "\U0001F600 smile :) ... --- '' '", "ªº µm ÉCOLE ÿ Ÿ ß ẞ ×÷", " lead  two   three \n\n end ", "\n", "x\0y z"]


def texts():
    rng = random.Random(3)
    letters = "abcZé ñ'ÀÿΣ́  1٣½!…“\n\t‍ß"
    return [*ODD, *("".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(1500)), *(prose(i) for i in range(20))]


def test_word_ids_equal_the_library():
    words = WordTokenizer(vocabulary_path(), remembered=50)
    for at in range(0, len(texts()), 100):
        part = texts()[at:at + 100]
        for text, got in zip(part, words.encode(part), strict=True):
            assert np.frombuffer(got, "<u2").tolist() == words.library.encode(text, add_special_tokens=False).ids


def test_special_tokens_get_the_ids_of_the_untouched_library():
    from tokenizers import Tokenizer

    library, words = Tokenizer.from_file(vocabulary_path()), WordTokenizer(vocabulary_path())
    known = ["a <|endoftext|> b", "A <|ENDOFTEXT|> b", "x<|endoftext|>日本Y <|StartOfText|>é日", "<|endoftext|><|startoftext|>", "<|endoftext|", *texts()]
    for text, got in zip(known, words.encode(known), strict=True):
        assert np.frombuffer(got, "<u2").tolist() == library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(words.encode(known)[0], "<u2").tolist() == [320, 49407, 321]


def library_bpe():
    import tiktoken

    ranks = byte_bpe.read_ranks(byte_bpe.vocabulary_path())
    return tiktoken.Encoding("own", pat_str=byte_bpe.pattern(), mergeable_ranks=ranks, special_tokens={})


def test_byte_ids_equal_the_library():
    bpe, library = byte_bpe.ByteBPE(byte_bpe.vocabulary_path(), byte_bpe.pattern(), remembered=50), library_bpe()
    known = [*texts(), "a" * 5000, "ab" * 900 + " !" * 50, "=-" * 400]
    for at in range(0, len(known), 200):
        part = known[at:at + 200]
        for text, got in zip(part, bpe.encode(part), strict=True):
            ids = np.frombuffer(got, "<u2")
            assert ids.tolist() == library.encode_ordinary(text)
            assert bpe.decode(ids) == text.encode()


def test_words_folded_by_higher_order_functions(spark):
    library = library_bpe()
    words = [" thereation", "erheahn", "\n\n", "é", "日本語", "don", "'t", " x", "aaaaaaaaaaaaaaaa", "", "ouéàß", "1234"]
    frame = spark.createDataFrame([(w,) for w in words], "w string")
    got = frame.select("w", byte_bpe.encode_words(frame.w, byte_bpe.rank_literal(byte_bpe.read_ranks(byte_bpe.vocabulary_path()))).alias("ids")).collect()
    assert {r["w"]: r["ids"] for r in got} == {w: library._encode_single_piece(w) if w else [] for w in words}


def test_byte_digests_of_awkward_rows(spark):
    library = library_bpe()
    docs = awkward(spark, [(30, t, "en", "s", 1) for t in ODD])
    got = sorted(map(tuple, byte_bpe.digests(with_clashes(docs)).collect()), key=str)
    want = []
    for r in docs.collect():
        ids = library.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert byte_bpe.digests(empty(spark)).collect() == []


def test_code_lengths_are_optimal_and_limited():
    def huffman_cost(counts):
        import heapq

        heap, cost = list(counts), 0
        heapq.heapify(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            cost += a + b
            heapq.heappush(heap, a + b)
        return cost

    rng = np.random.default_rng(0)
    for n in (2, 3, 50, 400):
        counts = rng.integers(1, 1000, n)
        lengths = huffman.code_lengths(counts)
        assert (lengths * counts).sum() == huffman_cost(counts.tolist())
    steep = 2 ** np.arange(40)
    lengths = huffman.code_lengths(steep)
    assert lengths.max() == 16 and (0.5 ** lengths).sum() == 1


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
def test_code_round_trip(n):
    counts = np.zeros(huffman.SYMBOLS, np.int64)
    counts[: 2000] = 10_000_000 // np.arange(1, 2001) ** 2
    code = huffman.Code(huffman.code_lengths(counts))
    ids = np.random.default_rng(n).integers(0, 2000, n).astype("<u2")
    bits, checkpoints = code.encode(ids)
    assert np.array_equal(code.decode(bits, checkpoints, n), ids)
    assert len(checkpoints) == 4 * -(-n // huffman.CHECKPOINT)


def test_one_symbol_alone_has_a_code():
    counts = np.zeros(huffman.SYMBOLS, np.int64)
    counts[9] = 4
    code = huffman.Code(huffman.code_lengths(counts))
    bits, checkpoints = code.encode(np.full(300, 9))
    assert code.decode(bits, checkpoints, 300).tolist() == [9] * 300


def test_files_hold_all_ids_in_order(spark, tmp_path):
    library = WordTokenizer(vocabulary_path()).library
    docs = awkward(spark, [(30 - i, t, "en", "s", 1) for i, t in enumerate(ODD)])
    got = sorted(map(tuple, huffman.digests(with_clashes(docs)).collect()), key=lambda r: r[1])
    rows = {}
    for r in docs.collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        rows.setdefault(r["doc_id"], []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted(((r[0], r[2], r[3]) for r in got), key=str) == sorted(((k, *x) for k, v in rows.items() for x in v), key=str)
    order = [r[0] for r in got]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got)])[:-1].tolist()
    assert huffman.digests(empty(spark)).collect() == []


def test_blocks_of_several_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, prose(i, 30)) for i in range(200)], "doc_id long, text string")
    folder = str(tmp_path / "ids")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        huffman.write_ids(docs, folder, block=500)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    blocks = spark.read.parquet(f"{folder}/blocks")
    assert blocks.select("shard").distinct().count() > 1 and blocks.count() > 8
    rows = huffman.read_ids(spark, folder, lambda ids, sizes, tokens: [ids, sizes], "id bigint, n bigint").collect()
    assert sorted(r["id"] for r in rows) == list(range(200))


def packed(frame, **more):
    rows = packing.pack(frame, **more).collect()
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in by.values():
        ends = 0
        for offset, length in sorted(held):
            assert offset == ends
            ends += length
        assert ends <= more.get("capacity", packing.CAPACITY)
    return rows, by


def test_packing_of_awkward_rows(spark):
    library = WordTokenizer(vocabulary_path()).library
    docs = awkward(spark, [(40 + i, prose(i, 3 + 40 * i), "en", "s", 1) for i in range(30)])
    rows, by = packed(with_clashes(docs))
    want = []
    for r in docs.collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            cut = ids[k:k + 2048]
            want.append((r["doc_id"], k // 2048, k, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in rows), key=str) == sorted(want, key=str)
    counts = np.bincount([r["length"] for r in rows], minlength=2049)
    assert len(by) <= sum(n for _, n in packing.best_fit_decreasing(counts))
    assert packing.pack(empty(spark)).collect() == []


def fewest(items, capacity):
    best = [len(items)]
    items = sorted(items, reverse=True)

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        tried = set()
        for k in range(len(bins)):
            if bins[k] + items[i] <= capacity and bins[k] not in tried:
                tried.add(bins[k])
                bins[k] += items[i]
                go(i + 1, bins)
                bins[k] -= items[i]
        bins.append(items[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return best[0]


def test_bin_completion_against_all_packings():
    rng = random.Random(8)
    for _ in range(120):
        capacity = rng.choice([20, 30])
        items = [rng.randint(3, capacity * 2 // 3) for _ in range(rng.randint(0, 11))]
        counts = np.bincount(items, minlength=capacity + 1)
        plan = packing.bin_completion(counts)
        used = np.zeros(capacity + 1, int)
        for filling, n in plan:
            assert sum(s * e for s, e in filling.items()) <= capacity
            for s, e in filling.items():
                used[s] += e * n
        assert np.array_equal(used, counts)
        assert packing.lower_bound(counts) <= fewest(items, capacity) == sum(n for _, n in plan)


def test_bin_completion_improves_on_best_fit():
    items = np.random.default_rng(1).integers(300, 900, 1000)
    counts = np.bincount(items, minlength=2049)
    size = lambda plan: sum(n for _, n in plan)
    assert packing.lower_bound(counts) <= size(packing.bin_completion(counts)) < size(packing.best_fit_decreasing(counts))
