"""Spelling variants: words one edit apart, by a trie that is a table.

A trie's nodes are prefixes, hashed; an edge leads from a node over a label to the next node. Only
nodes where words part or end are kept, so a label may be long and unary chains cost nothing.
A state of the search is (word, position, node, edits); the states of a level are a table, joined
with the table of edges by node, which gives the next level's. A state of one edit that reaches the end of
its word at a node where a word ends is a pair of neighbours.

1. Words send their prefixes as rows (node, next letter). A node is kept if its rows have two
   letters or more, or a word ends there; a minimum and a maximum tell, combined before the shuffle.
2. A word's rows at kept nodes are its own path: the states without an edit, and the edges.
   At most 91 edges leave a node (a-z, 64 letters beyond ASCII, the end).
3. The edit is made where the two words part, so it leads from a kept node into an edge of another
   letter: that letter, a later one of the alphabet, replaces the word's next one, or it's the one after
   it, which is taken out. (Earlier letters and insertions are the same pairs, seen from the other
   word.) The state then knows the neighbour's spelling that it looks for and follows it edge by
   edge, level by level; a label that differs ends it.
4. Near the root every letter goes on, and each word would send hundreds of states. An edit in the
   first half of a word leaves its second half as it is: so edits are looked for in the second half only,
   in the trie of the words and in that of the reversed words. Pairs that both find are left
   to the former. Nodes above the halves aren't made.

Then each word's form is its most frequent neighbour, if that is ``RATIO`` times as frequent, and its
root the end of the chain of forms (pointer jumping; each step is ``RATIO`` times as frequent, so
a chain has few).

A hot node (a beginning of a third of all words) has its rows combined before the shuffle, and in the
joins is the split side of a skewed join; it's one row of at most 182 edges on the other. Two prefixes of equal
64-bit hash would be one node; a neighbour found by that still has the spelling looked for, or isn't one.

Defined cases: null or empty text has no words; a null doc_id is the empty text before the colon;
rows of equal doc_id count each; words of any length; an empty table gives no rows; other columns
aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.llm.common import freeze, prepare_workers, read_table
from mercato.llm.textbytes import LOWER as LOWERED
from mercato.llm.textbytes import chunks, column, mix
from mercato.session import scratch_path

LENGTH, COUNT, RATIO, EVERY = 7, 2, 10, 31
#: bytes of text looked through at once
TEXT_BYTES = 1 << 20
ASCII = np.zeros(256, dtype=bool)
ASCII[65:91] = ASCII[97:123] = True
#: prefix rows that a task hands on at once
ROWS = 1 << 17
_SIDES = (np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E6C63D0876A9A47))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def letter_runs(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs(doc_id, text) -> id (as text, null is empty), run: maximal runs of [A-Za-z\u00C0-\u00FF] of at least
    ``length`` code points, A-Z lower-cased."""
    schema = pa.schema([("id", pa.string()), ("run", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pc.fill_null(column(batch, "id"), "")
            for texts in chunks(column(batch, "text"), TEXT_BYTES):
                # U+00C0 to U+00FF are C3 and one more byte, and nothing else has a C3
                lead = texts.data == 0xC3
                letter = ASCII[texts.data] | lead
                letter[1:] |= lead[:-1]
                edge = np.zeros(len(letter) + 1, bool)
                edge[texts.at] = True                            # rows end runs
                first, last = letter.copy(), letter.copy()
                first[1:] &= ~letter[:-1] | edge[1:-1]
                last[:-1] &= ~letter[1:] | edge[1:-1]
                start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
                two = np.concatenate([[0], np.cumsum(lead)])
                long = end - start - (two[end] - two[start]) >= length
                start, end = start[long], end[long]
                at = np.concatenate([[0], np.cumsum(end - start)])
                letters = LOWERED[texts.data[np.repeat(start - at[:-1], end - start) + np.arange(at[-1])]]
                row = np.searchsorted(texts.at, start, side="right") - 1
                runs = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(letters))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(texts.first + row)).cast(pa.string()), runs.cast(pa.string())], schema=schema)

    return docs.select(F.col("doc_id").cast("string").alias("id"), "text").mapInArrow(run, "id string, run string")


def counted_words(docs: DataFrame, length: int = LENGTH, count: int = COUNT, every: int = EVERY) -> DataFrame:
    """docs(doc_id, text) -> word, n: runs of letters; those whose crc32 (with the id) ``every`` divides have
    lost a letter. Words of at least ``length`` code points and ``count`` occurrences."""
    prepare_workers(docs.sparkSession)
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % every == 0, F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))).otherwise(F.col("run"))
    return (letter_runs(docs, length).withColumn("h", h).select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
            .where((F.col("n") >= count) & (F.length("word") >= length)))


def prefixes(words: DataFrame) -> DataFrame:
    """words(word) -> wid, side, d, node, c: the word's prefixes (side 0) and those of the reversed word (1), from
    half of its length on, and the letter that follows; 0 after the whole word."""
    schema = pa.schema([("wid", pa.int64()), ("side", pa.int32()), ("d", pa.int32()), ("node", pa.int64()), ("c", pa.int32())])

    def one_side(side: int, wid: np.ndarray, size: np.ndarray, at: np.ndarray, letters: np.ndarray) -> Iterator[pa.RecordBatch]:
        # words by falling length, so that those that reach depth d are the first ones
        low = (size - 1) // 2 if side == 0 else size // 2
        held, total = [], 0
        state = np.full(len(size), _SIDES[side])
        some = len(size)
        for d in range(int(size[0]) + 1 if len(size) else 0):
            while some and size[some - 1] < d:
                some -= 1
            own = size[:some] > d
            place = np.where(own, at[:some] + (d if side == 0 else size[:some] - 1 - d), 0)
            c = np.where(own, letters[place], 0)
            asked = low[:some] <= d
            if asked.any():
                node = mix(state[:some][asked])
                held.append((wid[:some][asked], np.full(len(node), side), np.full(len(node), d), node.view(np.int64), c[asked]))
                total += len(node)
            state[:some] = state[:some] * _BASE + c.astype(np.uint64) + np.uint64(1)
            if total >= ROWS:
                yield _table(held)
                held, total = [], 0
        if held:
            yield _table(held)

    def _table(held: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(t.to_pandas_dtype())) for x, t in zip(zip(*held, strict=True), schema.types, strict=True)],
                                          schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = column(batch, "word").to_pylist()
            size = np.array([len(w) for w in words], np.int64)
            order = np.argsort(-size, kind="stable")
            letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
            at = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64) if len(size) else size
            wid = column(batch, "wid").to_numpy()
            for side in (0, 1):
                yield from one_side(side, wid[order], size[order], at[order], letters)

    return words.select(F.xxhash64("word").alias("wid"), "word").mapInArrow(run, "wid long, side int, d int, node long, c int")


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def own_paths(words: DataFrame) -> DataFrame:
    """words(word, n) -> word, n, side, path: the kept nodes (d, node) of a word's own prefixes, by depth.
    On side 1 the word is reversed."""
    rows = prefixes(words)
    kept = (rows.groupBy("node").agg(F.min("c").alias("least"), F.max("c").alias("most"))
            .where("least = 0 or least < most").select("node"))
    paths = (rows.drop("c").join(kept.hint("shuffle_hash"), "node", "left_semi")
             .groupBy("wid", "side").agg(F.sort_array(F.collect_list(F.struct("d", "node"))).alias("path")))
    spelled = words.select(F.xxhash64("word").alias("wid"), "word", "n")
    return (paths.join(spelled, "wid")
            .select(F.when(F.col("side") == 0, F.col("word")).otherwise(F.reverse("word")).alias("word"), "n", "side", "path"))


def edge_table(paths: DataFrame) -> DataFrame:
    """paths -> node, edges: array of (c: first letter, label, to: next kept node, d: its depth, n, follow: the
    letters that come after the first one, a space for a word's end). An edge that ends at the end of a word
    has its n; one that goes on beyond has null, so there may be both. The word that ends at the node itself
    is an edge of no letter."""
    word = F.col("word")

    def edge(x: Column, i: Column) -> Column:
        d, nxt = x["d"], F.get("path", i + 1)
        to = F.coalesce(nxt["d"], d)
        label = F.substr(word, d + 1, to - d)
        return F.struct(x["node"].alias("node"), F.struct(
            F.substr(label, F.lit(1), F.lit(1)).alias("c"), label.alias("label"), nxt["node"].alias("to"), to.alias("d"),
            F.when(to == F.length(word), F.col("n")).alias("n")).alias("edge"),
            F.struct(F.substr(label, F.lit(1), F.lit(1)).alias("c"), _or_end(F.substr(word, d + 2, F.lit(1))).alias("then")).alias("two"))

    rows = (paths.select(F.explode(F.transform("path", edge)).alias("x")).select("x.node", "x.edge", "x.two")
            .groupBy("node").agg(F.collect_set("edge").alias("edges"), F.collect_set("two").alias("twos")))
    follow = lambda e: F.array_join(F.transform(F.filter("twos", lambda t: t["c"] == e["c"]), lambda t: t["then"]), "")
    return rows.select("node", F.transform("edges", lambda e: F.struct(*(e[k].alias(k) for k in ("c", "label", "to", "d", "n")),
                                                                        follow(e).alias("follow"))).alias("edges"))


def _or_end(letter: Column) -> Column:
    return F.when(letter == "", F.lit(" ")).otherwise(letter)


def _follow(states: DataFrame) -> DataFrame:
    """states(word, n, side, near, d, e: an edge) whose edge spells on what is looked for: either a neighbour
    (near_n is not null) or a state of the next level."""
    e, near = F.col("e"), F.col("near")
    ends = e["d"] == F.length(near)
    return (states.where((F.substr(near, F.col("d") + 1, F.length(e["label"])) == e["label"])
                         & F.when(ends, e["n"].isNotNull()).otherwise((e["d"] < F.length(near)) & e["n"].isNull()))
            .select("word", "n", "side", "near", e["d"].alias("d"), F.when(~ends, e["to"]).alias("node"), F.when(ends, e["n"]).alias("near_n")))


def first_level(paths: DataFrame, table: DataFrame) -> DataFrame:
    """States without an edit, at the kept nodes of the second half, joined with the edges: an edge of another
    letter takes an edit."""
    half = F.when(F.col("side") == 0, F.floor(F.length("word") / 2)).otherwise(F.ceil(F.length("word") / 2))
    states = (paths.select("word", "n", "side", half.cast("int").alias("half"), F.explode("path").alias("x"))
              .where("x.d >= half and x.d < length(word)").select("word", "n", "side", "x.d", "x.node"))
    word, d, c = F.col("word"), F.col("d"), F.col("e")["c"]
    letter = lambda k: F.substr(word, d + k, F.lit(1))
    # the edge of no letter is that of a word which ends here: this one without its last letter
    # an edge is taken if the letter to come follows on it too: near a root most edges fit, and few go on
    own, after, later = F.col("own"), F.col("after"), F.col("later")
    replaces = lambda e: (e["c"] > own) & F.contains(e["follow"], _or_end(after))
    deletes = lambda e: (e["c"] == after) & (e["c"] != own) & F.contains(e["follow"], later)
    joined = (states.join(table, "node").withColumns({"own": letter(1), "after": letter(2), "later": _or_end(letter(3))})
              .select("word", "n", "side", "d", "own", "after", "later", F.explode(F.filter("edges", lambda e: replaces(e) | deletes(e))).alias("e")))
    before, rest = F.substr(word, F.lit(1), d), F.substr(word, d + 2)
    near = F.array_compact(F.array(F.when(replaces(F.col("e")), F.concat(before, c, rest)), F.when(deletes(F.col("e")), F.concat(before, rest))))
    return _follow(joined.select("word", "n", "side", "d", "e", F.explode(near).alias("near")))


def neighbours(words: DataFrame) -> DataFrame:
    """words(word, n) -> word, n, near, near_n: both ways, all pairs one insertion, deletion or replacement apart."""
    prepare_workers(words.sparkSession)
    paths = _stored(own_paths(words), "paths")
    table = _stored(edge_table(paths), "edges")
    level = _stored(first_level(paths, table), "level")
    found = level.where("near_n is not null")
    while not (states := level.where("near_n is null")).isEmpty():
        # the edge of the letter that comes next: one that goes on, or that ends, or both
        wanted = F.filter("edges", lambda e: e["c"] == F.substr("near", F.col("d") + 1, F.lit(1)))
        level = _stored(_follow(states.join(table, "node").select("word", "n", "side", "near", "d", F.explode(wanted).alias("e"))), "level")
        found = found.unionByName(level.where("near_n is not null"))
    forth = found.where("side = 0").select("word", "n", "near", "near_n")
    back = found.where("side = 1").select(F.reverse("word").alias("word"), "n", F.reverse("near").alias("near"), "near_n")
    half = F.floor(F.length("word") / 2).cast("int")
    other = F.substr("word", F.lit(1), half) != F.substr("near", F.lit(1), half)
    pairs = forth.unionByName(back.where(other))
    both = F.array(F.struct("word", "n", "near", "near_n"),
                   F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return pairs.select(F.explode(both).alias("x")).select("x.*")


def chain_ends(forms: DataFrame) -> DataFrame:
    """forms(word, form) -> word, root: the last one of the chain of forms; each word has one form at most and
    there are no rings."""
    held = freeze(forms.select("word", F.col("form").alias("root")))
    while True:
        on = held.select(F.col("word").alias("by"), F.col("root").alias("further"))
        step = freeze(held.join(on, F.col("root") == F.col("by"), "left")
                      .select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        held = step.select("word", "root")
        if step.where("moved").isEmpty():
            return held


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """words(word, n) -> word, form, root, n, n_near, form_n."""
    near = neighbours(words)
    # the most frequent neighbour, the first in code-point order of several
    best = freeze(near.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
                  .select("word", "n_near", F.when(-F.col("best")["minus"] >= ratio * F.col("n"), F.col("best")["near"]).alias("form"),
                          F.when(-F.col("best")["minus"] >= ratio * F.col("n"), -F.col("best")["minus"]).alias("form_n")))
    roots = chain_ends(best.where("form is not null").select("word", "form"))
    return (words.join(best.join(roots, "word", "left"), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n",
                    F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(freeze(counted_words(read_table(spark, sf_dir, "documents"))))
