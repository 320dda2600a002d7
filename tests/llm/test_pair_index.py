"""BPE by the pair occurrence index, against the library."""

import hashlib
import json
import random

import numpy as np
import pytest

from redliner.llm import pair_index
from tests.llm.frames import awkward, empty, prose, with_clashes

SPECIAL = ["<|endoftext|>", "x <|endoftext|> \n<|endoftext|><|endoftext|>y", "<|ENDOFTEXT|>", " <|endoftext|"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(pair_index.vocabulary_path())


def texts():
    rng = random.Random(4)
    letters = "abcZé ñ'ÀÿΣ́  1٣½!…“\n\t‍ßaaaeee<|>endoftx\0"
    runs = ["a" * 5000, "ab" * 900 + " !" * 50, "=-" * 400, "haha" * 301 + "the" * 1000, "日本語 テスト", "\U0001F600 :) 'll 'tis"]
    return [*SPECIAL, *runs, None, "", *("".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(3000)), *(prose(i) for i in range(20))]


def test_ids_and_texts_equal_the_library(library):
    bpe, known = pair_index.PairIndexBPE(pair_index.vocabulary_path(), remembered=50), texts()
    for at in range(0, len(known), 150):
        part = known[at:at + 150]
        ids, counts = bpe.encode(part)
        ends = np.cumsum(counts)
        for text, a, b, decoded in zip(part, ends - counts, ends, bpe.decode(ids, counts), strict=True):
            want = library.encode(text or "", add_special_tokens=False).ids
            assert ids[a:b].tolist() == want
            assert decoded == library.decode(want, skip_special_tokens=False)


def test_every_code_point_is_split_like_in_the_library(library):
    bpe = pair_index.PairIndexBPE(pair_index.vocabulary_path())
    points = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 10_000):
        part = [f"a{c}1 {c}{c} !" for c in points[at:at + 10_000]]
        ids, counts = bpe.encode(part)
        want = [e.ids for e in library.encode_batch(part, add_special_tokens=False)]
        assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


def test_words_of_a_task_are_folded_as_each_alone():
    bpe = pair_index.PairIndexBPE(pair_index.vocabulary_path())
    words = [b"", b"a", b"aa", b"aaa", b"aaaaaaa", b" thereation", "é".encode(), b"\0", b"xyxyxyxyx", b"", b" the" * 40]
    assert bpe.fold(words) == [bpe.fold([w])[0] for w in words]
    assert bpe.fold([]) == []


def test_ids_that_form_no_text(library):
    bpe = pair_index.PairIndexBPE(pair_index.vocabulary_path())
    broken = bpe.encode(["é日"])[0][[0, 2]]
    assert bpe.decode(np.concatenate([broken, [70_000, -1]]), np.array([0, len(broken), 2])) == ["", library.decode(broken.tolist(), skip_special_tokens=False), ""]


def test_vocabulary_whose_ranks_do_not_ascend_is_refused(tmp_path):
    with open(pair_index.vocabulary_path(), encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"]["merges"] = spec["model"]["merges"][::-1]
    path = tmp_path / "turned.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError, match="lower rank"):
        pair_index.PairIndexBPE(str(path))


def test_digests_of_awkward_rows(spark, library):
    docs = awkward(spark, [(30 + k, t, "en", "s", 1) for k, t in enumerate(SPECIAL)])
    got = sorted(map(tuple, pair_index.digests(with_clashes(docs)).collect()), key=str)
    want = []
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert pair_index.digests(empty(spark)).collect() == []


def test_null_ids_and_other_names(spark):
    coded = spark.createDataFrame([("x", [1, None, 2]), ("y", None), (None, [])], "id string, ids array<int>").withColumnsRenamed({"id": "ids_of", "ids": "n"})
    got = {r["ids_of"]: (r["n"], r["decoded"]) for r in pair_index.decode(coded, "ids_of", "n").collect()}
    assert got["y"] == (None, None) and got[None] == ([], "") and got["x"][0] == [1, None, 2] and len(got["x"][1]) == 2
