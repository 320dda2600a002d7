"""Spelling variants: words one edit apart, found by a frontier of states in a distributed trie.

The trie is a table of edges. A node with more than ``LEAF`` words below it has an
edge for each next code point; below any other node its words stand as a whole in a
leaf. A state with one edit spent says that what follows a place in a word has to
follow a node too: either (word, position, node), or, for all words below a node at
once, (node, node). States begin at the edges of every node, two edges for a
replaced code point, one for an inserted one, and each round joins them with the
edges of their nodes by the next code point, until none is left. Where two leaves
meet, the words with equal rests are neighbours. The first difference of two words
fixes the edit, so that every pair of neighbours comes from exactly one state.

Nodes are 64-bit hashes of prefixes. Each edge carries a mask with a bit for the
hash of every rest below it; states whose masks have no common bit are dropped. A
collision can only bring a wrong pair, which the distance check at the end removes.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redliner.session import durable

RUNS = "[A-Za-zÀ-ÿ]+"
#: one in so many (document, run) pairs loses a code point
SLIP = 97
LENGTH, OCCURRENCES = 5, 3
#: words that stand in a leaf at most
LEAF = 8
#: depth to which the trie is built first; it doubles while nodes go on below
DEPTH = 32


def counts(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): the words of all texts with their occurrences, after the slips."""
    runs = docs.select(F.coalesce(F.col(id).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text), F.lit(RUNS), F.lit(0))).alias("run"))
    runs = runs.filter(F.length("run") >= LENGTH).select("id", F.translate("run", ascii_uppercase, ascii_lowercase).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    slipped = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % SLIP == 0, slipped).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= LENGTH).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= OCCURRENCES)


# --- the trie -----------------------------------------------------------------------------------------------------


def _node(word: Column, depth: Column) -> Column:
    return F.xxhash64(F.substring(word, F.lit(1), depth))


def _rest(word: Column, depth: Column) -> Column:
    return F.substring(word, depth + 1, F.length(word))


def _bit(word: Column, depth: Column) -> Column:
    """A one in 64 bits for what follows the first ``depth`` code points."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(_rest(word, depth)), F.lit(64)).cast("int"))


def _edges(words: DataFrame, leaf: int, depth: int) -> DataFrame:
    """(parent, c, depth, mask, child, words): each edge with the depth of its end, and the node or the words there.

    The end of a word at a node is an edge with an empty ``c``.
    """
    word, at = F.col("word"), F.col("depth")
    left, low, inner, ends = words.select("word"), 0, None, []
    while True:
        steps = left.select("word", F.explode(F.sequence(F.lit(low), F.least(F.length("word"), F.lit(low + depth - 1)))).alias("depth")).withColumn("node", _node(word, at))
        nodes = steps.groupBy("node").agg(F.count("*").alias("n"), F.any_value("depth").alias("depth"), F.bit_or(_bit(word, at)).alias("mask"),
                                          F.any_value(F.when(at > 0, _node(word, at - 1))).alias("parent"), F.any_value(F.substring(word, at, F.lit(1))).alias("c"))
        big = durable(nodes.filter((F.col("n") > leaf) | (at == low)).select("node", "parent", "c", "depth", "mask"))
        deepest = durable(steps.join(big.select("node"), "node").groupBy("word").agg(F.max("depth").alias("k")))
        # words that go on below a node at the last depth
        on = (F.col("k") == low + depth - 1) & (F.length("word") > F.col("k"))
        ends.append(deepest.filter(~on))
        # the first node of a later window was the last of the one before
        inner = big.filter("depth > 0") if inner is None else inner.union(big.filter(at > low))
        rest = deepest.filter(on)
        if rest.isEmpty():
            break
        low, depth, left = low + depth - 1, 2 * depth, rest.select("word")
    ended = ends[0]
    for more in ends[1:]:
        ended = ended.union(more)
    k = F.col("k")
    leaves = ended.groupBy(_node(word, k).alias("parent"), F.substring(word, k + 1, F.lit(1)).alias("c")).agg(
        (F.min("k") + 1).alias("depth"), F.bit_or(_bit(word, k + 1)).alias("mask"), F.array_sort(F.collect_list("word")).alias("words"))
    return inner.select("parent", "c", "depth", "mask", F.col("node").alias("child"), F.lit(None).cast("array<string>").alias("words")).unionByName(
        leaves.withColumn("child", F.lit(None).cast("long")))


# --- the frontier -------------------------------------------------------------------------------------------------

STATE = "array<struct<word:string,other:string,position:int,own:bigint,node:bigint>>"


def _meet(words: Column, child: Column, depth: Column, words2: Column, child2: Column, depth2: Column) -> Column:
    """The states and pairs that two ends make whose rests have to be equal."""
    none = F.lit(None)
    pairs = F.flatten(F.transform(words, lambda x: F.transform(F.filter(words2, lambda y: _rest(x, depth) == _rest(y, depth2)), lambda y: F.struct(x, y, none, none, none))))
    walk = lambda ws, d, node: F.transform(ws, lambda x: F.struct(x, none, d, none, node))
    return (F.when(words.isNotNull() & words2.isNotNull(), pairs.cast(STATE)).when(words.isNotNull(), walk(words, depth, child2).cast(STATE))
            .when(words2.isNotNull(), walk(words2, depth2, child).cast(STATE)).otherwise(F.array(F.struct(none, none, none, child, child2)).cast(STATE)))


def _side(edges: DataFrame, name: str) -> DataFrame:
    return edges.select([F.col(c).alias(f"{name}_{c}") for c in edges.columns])


def _of(name: str) -> tuple[Column, Column, Column]:
    return F.col(f"{name}_words"), F.col(f"{name}_child"), F.col(f"{name}_depth")


def _common(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b) != 0


def pairs(words: DataFrame, leaf: int = LEAF, depth: int = DEPTH) -> DataFrame:
    """(word, other) for every two words exactly one inserted, deleted or replaced code point apart, once each.

    ``words`` has different words in a column ``word``.
    """
    edges = durable(_edges(words, leaf, depth))
    a, b = _side(edges, "a"), _side(edges, "b")
    inline = lambda frame, states: frame.select(F.inline(states))
    # words of the same leaf
    near = F.flatten(F.transform("words", lambda x: F.transform(F.filter("words", lambda y: (x < y) & (F.levenshtein(x, y, 1) == 1)), lambda y: F.struct(x, y))))
    found = [inline(edges.filter(F.size("words") > 1), near.cast("array<struct<word:string,other:string>>"))]
    # a replaced code point: two edges of a node
    both = a.join(b, (F.col("a_parent") == F.col("b_parent")) & (F.col("a_c") < F.col("b_c")) & _common(F.col("a_mask"), F.col("b_mask")) & (F.col("a_c") != ""))
    start = inline(both, _meet(*_of("a"), *_of("b")))
    # an inserted one: an edge against its own node, which another code point has to follow
    own = edges.filter("c <> ''")
    after = lambda x: F.substring(x, F.col("depth") + 1, F.lit(1))
    inserted = F.when(F.col("words").isNotNull(), F.transform(F.filter("words", lambda x: after(x) != F.col("c")), lambda x: F.struct(x, F.lit(None), F.col("depth"), F.lit(None), F.col("parent"))).cast(STATE))
    start = start.withColumn("skip", F.lit("-")).union(inline(own, inserted).withColumn("skip", F.lit("-"))).union(
        own.filter("child is not null").select(F.lit(None), F.lit(None), F.lit(None), "parent", "child", "c"))
    frontier = durable(start)
    while not frontier.isEmpty():
        found.append(frontier.filter("other is not null").select("word", "other"))
        single = frontier.filter("other is null and word is not null").select("word", "position", F.col("node").alias("a_parent"), F.substring("word", F.col("position") + 1, F.lit(1)).alias("a_c"))
        single = single.join(a, ["a_parent", "a_c"]).filter(_common(F.col("a_mask"), _bit(F.col("word"), F.col("position") + 1)))
        stepped = inline(single, _meet(F.array("word"), F.lit(None).cast("long"), F.col("position") + 1, *_of("a")))
        double = frontier.filter("word is null").select(F.col("own").alias("a_parent"), F.col("node").alias("b_parent"), "skip").join(a, "a_parent").filter(F.col("a_c") != F.col("skip"))
        double = double.withColumn("b_c", F.col("a_c")).join(b, ["b_parent", "b_c"]).filter(_common(F.col("a_mask"), F.col("b_mask")))
        frontier = durable(stepped.union(inline(double, _meet(*_of("a"), *_of("b")))).withColumn("skip", F.lit("-")))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.filter(F.levenshtein("word", "other", 1) == 1)


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last of the forms that lead on from each word that has one."""
    state = durable(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        state = durable(state.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if state.filter("moved").isEmpty():
            return state.select("word", "root")
        state = state.select("word", "root")


def variants(docs: DataFrame, id: str = "doc_id", text: str = "text", leaf: int = LEAF, depth: int = DEPTH) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word with at least five code points and three occurrences.

    Every row counts, also repeated ones; a null id is an empty text before the
    colon; null and empty texts hold no words. Very long texts and words are
    taken whole. Among equally frequent near words the smallest in code-point
    order is the form. Other columns are ignored, whatever their names; an empty
    table gives an empty result.
    """
    words = durable(counts(docs, id, text))
    linked = durable(pairs(words, leaf, depth))
    near = linked.union(linked.select("other", "word")).toDF("word", "near").join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    follows = -F.col("best.m") >= 2 * F.col("n")
    known = durable(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(follows, F.col("best.near")).alias("form"), F.when(follows, -F.col("best.m")).alias("form_n")))
    return known.join(_roots(known.filter("form is not null")), "word", "left").withColumn("root", F.coalesce("root", "word"))


def oracle() -> str:
    """The same groups in SQL over whole tables: crc32 byte by byte, deletion keys for the neighbours."""
    return f"""
with recursive bits as (
  select i as entry, i::bigint as c, 0 as k from range(256) t(i)
  union all select entry, case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end, k + 1 from bits where k < 8),
crc as (select list(c order by entry) as entries from bits where k = 8),
run as (
  select id, run, count(*) as times from (
    select coalesce(doc_id::varchar, '') as id, translate(unnest(regexp_extract_all(text, '{RUNS}')), '{ascii_uppercase}', '{ascii_lowercase}') as run from documents)
  where length(run) >= {LENGTH} group by id, run),
hashed as (
  select run, times, xor(list_reduce(list_transform(range(0, length(h), 2), lambda i: ('0x' || substr(h, i + 1, 2))::bigint),
                                     lambda c, byte: xor(c >> 8, entries[xor(c & 255, byte) + 1]), 4294967295::bigint), 4294967295::bigint) as h
  from (select run, times, hex(encode(id || ':' || run)) as h from run), crc),
slip as (
  select case when h % {SLIP} = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, times from hashed),
word as (select word, sum(times)::bigint as n from slip where length(word) >= {LENGTH} group by word having sum(times) >= {OCCURRENCES}),
gap as (select word, i, substr(word, 1, i) || substr(word, i + 2) as rest from word, unnest(range(0, length(word))) t(i)),
near as (
  select a.word, b.word as near from gap a join gap b on a.i = b.i and a.rest = b.rest and length(a.word) = length(b.word) and a.word <> b.word
  union select g.word, w.word from gap g join word w on g.rest = w.word
  union select w.word, g.word from gap g join word w on g.rest = w.word),
best as (
  select near.word, count(*) as n_near, first(near order by w.n desc, near) as near, max(w.n) as near_n
  from near join word w on w.word = near.near group by near.word),
known as (
  select word, n, coalesce(n_near, 0) as n_near, case when near_n >= 2 * n then near end as form, case when near_n >= 2 * n then near_n end as form_n
  from word left join best using (word)),
chain as (
  select word, word as root, 0 as steps from known
  union all select c.word, k.form, steps + 1 from chain c join known k on k.word = c.root where k.form is not null)
select word, n, n_near, form, form_n, arg_max(root, steps) as root from known join chain using (word) group by all
"""
