"""Ranked lexical search by pipelined term partitioning.

Terms belong to owners: an owner holds the postings of its terms, cut into blocks
of documents. An item's bundle starts for every block with no accumulator and is
sent from owner to owner, rare terms first: each stage cogroups the bundles with
the owner's postings of the block and adds its integer contributions to the sparse
accumulators that the bundle carries on. The last stage selects each block's best
documents, and a ranking over the blocks selects the item's.

A bundle leaves behind what cannot win any more: a document whose score so far,
with the most that all coming owners can add, is below the score so far of the
block's k-th document. Such a document may be met again later; its score is then
too low, and still below k others. So the result is exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from redliner.session import durable

#: results of an item
BEST = 50
#: owners take terms by the part of all documents that hold them: at most 1 in 100, at most 1 in 10, the rest
OWNERS = (100, 10)
#: documents of a block and items of a group, which bound a task's memory; both only divide the work
BLOCK, GROUP = 8_192, 256
#: a contribution is below its term's weight times this
UNIT = 1_000_000

_SEPARATORS = bytes(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))
_LOWER = bytes(32 if b in _SEPARATORS else b + 32 if 65 <= b <= 90 else b for b in range(256))


def terms(text: str | None) -> Counter[str]:
    """Occurrences of the maximal runs of ASCII letters, digits and characters beyond ASCII; only A-Z are lower-cased."""
    found = Counter((text or "").encode("utf-8", "replace").translate(_LOWER).decode().split(" "))
    found.pop("", None)
    return found


def _postings(rows: DataFrame, keep: list[str]) -> DataFrame:
    """(row, *keep, n, word, tf): each row's distinct terms; with them the empty word, which is no term, once for all n of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                words, counts, ends, sizes = [], [], [0], []
                for text in part.column(part.num_columns - 1).to_pylist():
                    found = terms(text)
                    sizes.append(found.total())
                    found[""] = sizes[-1]
                    words.extend(found)
                    counts.extend(found.values())
                    ends.append(len(words))
                offsets = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(words, pa.string())),
                     pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64()))], names=["row", *keep, "n", "words", "counts"])

    columns = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in keep)
    counted = rows.select("row", *keep, "text").mapInArrow(run, f"row long, {columns}n long, words array<string>, counts array<long>")
    pair = F.explode(F.arrays_zip("words", "counts")).alias("t")
    return counted.filter("n > 0").select("row", *keep, "n", pair).select("row", *keep, "n", F.col("t.words").alias("word"), F.col("t.counts").alias("tf"))


def _owner(df: Column, n: int) -> Column:
    owner = F.lit(len(OWNERS))
    for k in reversed(range(len(OWNERS))):
        owner = F.when(df * OWNERS[k] <= n, k).otherwise(owner)
    return owner


def _stage(owner: int, best: int):
    """One owner's work on all bundles of a block and a group of items."""
    last = owner == len(OWNERS)

    def run(bundles: pa.Table, postings: pa.Table) -> pa.Table:
        columns = ["item", "item_id", "part", "block", "terms", "docs", "ids", "scores"]
        if not bundles.num_rows:
            return pa.table({c: bundles[c] for c in columns})
        term, doc = postings["term"].to_numpy(), postings["doc"].to_numpy()
        order = np.lexsort((doc, term))
        term, doc, points = term[order], doc[order], postings["points"].to_numpy()[order]
        known, first = np.unique(doc, return_index=True)
        id_of = postings["id"].combine_chunks().take(pa.array(order[first]))
        place = np.searchsorted(known, doc)
        owned, starts = np.unique(term, return_index=True)
        spans = dict(zip(owned.tolist(), zip(starts.tolist(), [*starts.tolist()[1:], len(term)])))
        held_docs, held_ids, held_scores, counts = [], [], [], []
        for k in range(bundles.num_rows):
            mine = bundles["terms"][k].as_py()
            came_docs, came_scores = (bundles[c][k].values.to_numpy() for c in ("docs", "scores"))
            # sums of the documents of this owner's postings, then those that came with the bundle
            sums = np.zeros(len(known), np.int64)
            for t in mine:
                if t["owner"] == owner and t["term"] in spans:
                    a, b = spans[t["term"]]
                    sums[place[a:b]] += points[a:b]
            at = np.minimum(np.searchsorted(known, came_docs), max(len(known) - 1, 0))
            met = known[at] == came_docs if len(known) else np.zeros(len(came_docs), bool)
            sums[at[met]] += came_scores[met]
            some = np.flatnonzero(sums > 0)
            docs = np.concatenate([known[some], came_docs[~met]])
            ids = pa.concat_arrays([id_of.take(pa.array(some)), bundles["ids"][k].values.filter(pa.array(~met))])
            scores = np.concatenate([sums[some], came_scores[~met]])
            if len(scores) > best:
                coming = sum(t["weight"] for t in mine if t["owner"] > owner) * UNIT
                kth = np.partition(scores, len(scores) - best)[len(scores) - best]
                keep = np.flatnonzero(scores + coming >= kth)
                docs, ids, scores = docs[keep], ids.take(pa.array(keep)), scores[keep]
            if last:
                # nulls after all numbers
                by = np.lexsort((docs, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), -scores))[:best]
                docs, ids, scores = docs[by], ids.take(pa.array(by)), scores[by]
            held_docs.append(docs)
            held_ids.append(ids)
            held_scores.append(scores)
            counts.append(len(docs))
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, v) for v in (pa.array(np.concatenate(held_docs)), pa.concat_arrays(held_ids), pa.array(np.concatenate(held_scores)))]
        return pa.table([*(bundles[c] for c in columns[:5]), *lists], names=columns)

    return run


def rank(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", best: int = BEST,
         block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """(item, rank, id, score): the ``best`` documents with a score above 0 of every item.

    Every row counts as a document and as an item of its own, also where ids
    repeat or are null; ids of documents are integers, and null ones come after
    all others among equal scores. Null and empty texts have no terms: such
    items find nothing, such documents do not count. Very long texts are taken
    whole. Other columns are ignored, whatever their names. No documents or no
    items give an empty result.
    """
    asked = items.select(F.monotonically_increasing_id().alias("row"), F.col(item).alias("item_id"), F.col(item_text).alias("text"))
    asked = durable(_postings(asked, ["item_id"]).select("row", "item_id", "word"))
    # row and term numbers are fixed by being written
    wanted = durable(asked.select("word").distinct().withColumn("term", F.monotonically_increasing_id()))
    given = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    postings = durable(_postings(given, ["id"]).join(wanted, "word").select(F.col("row").alias("doc"), "id", "n", "tf", "term", (F.col("word") == "").alias("whole")))
    N, L = postings.filter("whole").agg(F.count("*"), F.sum("n")).first()
    result = f"{item} {items.schema[item].dataType.simpleString()}, rank int, {id} long, score long"
    if not N:
        return docs.sparkSession.createDataFrame([], result)

    groups = max(1, -(-asked.filter("word = ''").count() // group))
    part = F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int")
    held = postings.filter("not whole").groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * N + 2) / (2 * F.col("df") + 1)))
    owned = durable(held.select("term", weight.alias("weight"), _owner(F.col("df"), N).alias("owner")))
    needs = asked.withColumn("part", part).join(wanted.filter("word <> ''"), "word").join(owned, "term")
    bundles = needs.groupBy(F.col("row").alias("item"), "item_id", "part").agg(F.collect_list(F.struct("term", "owner", "weight")).alias("terms"))
    # every block of documents gets a bundle of every item
    blocks = -(-N // block)
    none = F.array().cast("array<bigint>")
    bundles = bundles.select("item", "item_id", "part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "terms",
                             none.alias("docs"), none.alias("ids"), none.alias("scores"))

    share = F.expr(f"(1000000000 * tf) div (1000 * tf + 20 * (50 + (50 * n * {N}L) div {L}L))")
    points = postings.filter("not whole").join(owned, "term").select(
        "doc", "id", "term", "owner", (F.col("weight") * share).alias("points"), F.pmod(F.xxhash64("doc"), F.lit(blocks)).cast("int").alias("block"))
    # the groups that a term's postings go to
    points = points.join(needs.select("term", "part").distinct(), "term").filter("points > 0")
    schema = bundles.schema
    for owner in range(len(OWNERS) + 1):
        mine = points.filter(F.col("owner") == owner).select(*(F.col(c).alias(c) for c in ("part", "block", "term", "doc", "id", "points")))
        bundles = bundles.groupBy("part", "block").cogroup(mine.groupBy("part", "block")).applyInArrow(_stage(owner, best), schema)
    found = bundles.select("item", "item_id", F.explode(F.arrays_zip("docs", "ids", "scores")).alias("f")).select("item", "item_id", "f.*")
    order = Window.partitionBy("item").orderBy(F.desc("scores"), F.asc_nulls_last("ids"), "docs")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best).select(
        F.col("item_id").alias(item), F.col("rank").cast("int").alias("rank"), F.col("ids").alias(id), F.col("scores").alias("score"))


def oracle() -> str:
    """The same ranking in SQL over whole tables."""
    from string import ascii_lowercase, ascii_uppercase

    words = rf"regexp_extract_all(translate(text, '{ascii_uppercase}', '{ascii_lowercase}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
with doc as (select row_number() over () as doc, doc_id, {words} as words from documents),
corpus as (select count(*) as many, sum(len(words)) as total from doc where len(words) > 0),
item as (select row_number() over () as item, item_id, {words} as words from benchmark),
need as (select distinct item, unnest(words) as word from item),
posting as (select doc, word, count(*) as tf from (select doc, unnest(words) as word from doc) where word in (select word from need) group by doc, word),
weight as (select word, cast(floor(1000 * ln((2 * many + 2) / (2 * count(*) + 1))) as bigint) as w from posting, corpus group by word, many),
score as (
  select item, doc, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(words) * many) // total)))) as score
  from need join posting using (word) join weight using (word) join doc using (doc), corpus group by item, doc),
best as (
  select item_id, item, doc_id, score, row_number() over (partition by item order by score desc, doc_id nulls last, doc) as rank
  from score join doc using (doc) join item using (item) where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, cast(score as bigint) as score from best where rank <= {BEST}
"""
