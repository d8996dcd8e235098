"""Benchmark decontamination with an FM-index for each shard of the training texts.

Words are the runs of letters, digits and characters beyond ASCII, A-Z lower-cased.
A phrase is a window of ``size`` words of an item, or a shorter item as a whole.

A shard is a few MB of whole documents. Its words are hashed in numpy and mapped to
the phrases' alphabet; a word outside of it ends a stretch, as does a document's end,
and stretches shorter than the shortest phrase hold no occurrence. The rest is indexed:
all phrases are searched backward at once through the ranks of a wavelet matrix,
occurrences are located by sampled suffix positions, and their spans are merged.
Documents are never shuffled, and a shard's memory is bounded by its bytes.

The phrases are read in packs of items, of at most ``PACK_BYTES`` of text each by a
checked sum (an item above that is a pack alone); a broadcast holds one pack.

Words are compared by 64-bit hashes: a false occurrence needs all words of a phrase to
collide. Defined cases: null or empty text has no words and no hits; items without words
are dropped; a null item_id is named ``null``; equal items all count; rows with equal
doc_id are judged each by itself; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from mercato.llm.common import free_names, prepare_workers, read_table
from mercato.llm.fm_index import FMIndex
from mercato.llm.textbytes import ALNUM, Texts, chunks, column, word_hashes

SIZE = 10
PACK_BYTES = 16 << 20
#: bytes of text that an index is made of
SHARD_BYTES = 1 << 20
REPORT = ("n_words", "n_hit", "n_items", "item_ids", "spans")


class Phrases(NamedTuple):
    alphabet: np.ndarray          # sorted word hashes; symbol = place + 2, 1 separates
    windows: dict[int, np.ndarray]  # length -> distinct windows, symbols
    item_at: dict[int, np.ndarray]  # length -> items of window i: items[at[i]:at[i + 1]]
    items: dict[int, np.ndarray]
    names: list[str]
    shortest: int


def phrases(items: list[tuple[str, str]], size: int = SIZE) -> Phrases:
    texts = next(chunks(pa.array([t for _, t in items], pa.string()), 1 << 62), None)
    if texts is None:
        return Phrases(np.zeros(0, np.uint64), {}, {}, {}, [], 1)
    found, hashes = word_hashes(texts, ALNUM)
    alphabet, symbols = np.unique(hashes, return_inverse=True)
    symbols = symbols.astype(np.int64) + 2
    by_length: dict[int, tuple[list, list]] = {}
    for i, (a, b) in enumerate(zip(found.row_at[:-1], found.row_at[1:], strict=True)):
        if a == b:
            continue
        length = min(size, int(b - a))
        windows, owners = by_length.setdefault(length, ([], []))
        windows.append(np.lib.stride_tricks.sliding_window_view(symbols[a:b], length))
        owners.append(np.full(len(windows[-1]), i))
    out_windows, item_at, out_items = {}, {}, {}
    for length, (windows, owners) in by_length.items():
        out_windows[length], which = np.unique(np.concatenate(windows), axis=0, return_inverse=True)
        pairs = np.unique(np.stack([which.ravel(), np.concatenate(owners)], axis=1), axis=0)
        item_at[length] = np.searchsorted(pairs[:, 0], np.arange(len(out_windows[length]) + 1))
        out_items[length] = pairs[:, 1]
    return Phrases(alphabet, out_windows, item_at, out_items, [n for n, _ in items], min(by_length, default=1))


def _spread(at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges at[i]..end[i]-1, and for each the i."""
    many = end - at
    which = np.repeat(np.arange(len(at)), many)
    upto = np.cumsum(many) - many
    return np.arange(len(which)) - upto[which] + at[which], which


def occurrences(found, hashes: np.ndarray, pack: Phrases) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, first word, window) of all occurrences in a shard, no one across rows."""
    if not len(hashes) or not len(pack.alphabet):
        return
    place = np.minimum(np.searchsorted(pack.alphabet, hashes), len(pack.alphabet) - 1)
    known = pack.alphabet[place] == hashes
    # stretches of known words within a row
    breaks = np.zeros(len(hashes) + 1, bool)
    breaks[found.row_at] = True
    starts = known & (breaks[:-1] | ~np.concatenate([[False], known[:-1]]))
    ends = known & (breaks[1:] | ~np.concatenate([known[1:], [False]]))
    first, after = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    long = after - first >= pack.shortest
    first, after = first[long], after[long]
    if not len(first):
        return
    word, stretch = _spread(first, after)
    # a separator behind each stretch
    at = np.arange(len(word)) + stretch
    text = np.ones(len(word) + len(first), np.int64)
    text[at] = place[word] + 2
    source = np.zeros(len(text), np.int64)
    source[at] = word
    index = FMIndex(text, len(pack.alphabet) + 1)
    for length, windows in pack.windows.items():
        low, high = index.search(windows)
        rows, window = _spread(low, high)
        if len(rows):
            yield length, source[index.locate(rows)], window


def judge(texts: Texts, packs: list[Phrases]) -> list[tuple]:
    """A tuple for each row: n_words, n_hit, n_items, item_ids, spans (bytes of merged hits)."""
    found, hashes = word_hashes(texts, ALNUM)
    n, rows = len(hashes), len(texts.at) - 1
    cover = np.zeros(n + 1, np.int64)
    names: dict[int, set[str]] = {}
    for pack in packs:
        for length, first, window in occurrences(found, hashes, pack):
            np.add.at(cover, first, 1)
            np.add.at(cover, first + length, -1)
            item, which = _spread(pack.item_at[length][window], pack.item_at[length][window + 1])
            row = np.searchsorted(found.row_at, first, side="right") - 1
            for r, i in np.unique(np.stack([row[which], pack.items[length][item]], axis=1), axis=0).tolist():
                names.setdefault(r, set()).add((i, pack.names[i]))
    hit = np.cumsum(cover[:-1]) > 0
    hits = np.concatenate([[0], np.cumsum(hit)])
    out = []
    for r in range(rows):
        a, b = int(found.row_at[r]), int(found.row_at[r + 1])
        n_hit = int(hits[b] - hits[a])
        ids = sorted(name for _, name in names.get(r, ()))
        spans = []
        if n_hit:
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[a:b].astype(np.int8), [0]])))
            base = texts.at[r]
            spans = [(int(found.start[a + s] - base), int(found.end[a + e - 1] - base))
                     for s, e in zip(edge[::2], edge[1::2], strict=True)]
        out.append((b - a, n_hit, len(ids), ids, spans))
    return out


def phrase_packs(benchmark: DataFrame, size: int = SIZE, pack_bytes: int = PACK_BYTES) -> list:
    """benchmark(item_id, text) -> broadcasts of phrases, a bounded part of the items each."""
    spark = benchmark.sparkSession
    items = benchmark.where("text is not null").select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(total // pack_bytes) + 1
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [spark.sparkContext.broadcast(phrases([(r[0], r[1]) for r in items.where(part == k).collect()], size))
            for k in range(n)]


def mark_benchmark(docs: DataFrame, benchmark: DataFrame, size: int = SIZE,
                   names: tuple[str, ...] | None = None) -> DataFrame:
    """``docs`` with the columns ``names`` (REPORT, with an underscore behind a taken one): words, hit words, occurring items (number and
    sorted ids, repeated where items share an id), merged spans of hits as bytes from..to."""
    spark = docs.sparkSession
    prepare_workers(spark)
    names = names or tuple(free_names(docs.columns, *REPORT))
    packs = phrase_packs(benchmark, size)
    span = T.ArrayType(T.StructType([T.StructField("from", T.IntegerType()), T.StructField("to", T.IntegerType())]))
    kinds = (T.LongType(), T.LongType(), T.LongType(), T.ArrayType(T.StringType()), span)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in zip(names, kinds, strict=True))])
    new = to_arrow_schema(T.StructType(schema.fields[-5:]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row for texts in chunks(column(batch, "text"), SHARD_BYTES) for row in judge(texts, [p.value for p in packs])]
            columns = [[r[k] for r in rows] for k in range(4)]
            columns.append([[{"from": a, "to": b} for a, b in r[4]] for r in rows])
            cols = [pa.array(v, f.type) for v, f in zip(columns, new, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)


def remove_spans(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """``docs`` without the merged spans of hits; n_chars is set anew where there is one."""
    names = tuple(free_names(docs.columns, *REPORT))
    marked = mark_benchmark(docs, benchmark, size, names)
    spans, raw = F.col(names[4]), F.col("text").cast("binary")
    size_of = F.octet_length("text")
    ends = F.concat(F.transform(spans, lambda s: s["from"]), F.array(size_of))
    begins = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["to"]))
    parts = F.transform(F.arrays_zip(begins.alias("b"), ends.alias("e")),
                        lambda p: F.substring(raw, p["b"] + 1, p["e"] - p["b"]).cast("string"))
    out = marked.withColumn("text", F.when(F.size(spans) == 0, F.col("text")).otherwise(F.array_join(parts, "")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(names[1]) == 0, F.col("n_chars")).otherwise(
            F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = mark_benchmark(read_table(spark, sf_dir, "documents").select("doc_id", "text"),
                            read_table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", "n_words", "n_hit", "n_items",
                         F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
                         (F.col("n_hit") > 0).alias("contaminated"))


#: A word's window is a list of its words; documents and items are cut into words alike.
SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
spots AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, spots.n, i, item_id FROM spots JOIN win ON win.n = spots.n AND win.phrase = spots.phrase),
hit_words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY 1),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
              FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
