"""Phrases whose words belong together, from a weighted de Bruijn graph.

Texts are cut into pieces, pieces into words. The longest phrases asked for have ``LONGEST`` = 3
words, so a node is a run of two words and an edge a run of three: it leads from its first two
words to its last two and weighs as often as it occurs. Everything is by language, which is part
of each word's 64-bit hash.

1. Each word occurrence sends one row, its window: itself and the next two words of its piece,
   with 0 behind a piece's end. Without a 0 that is an edge; with one it is the correction for a
   node (one 0) or a word (two) that ends a piece. Equal windows are counted in each batch, then
   by Spark, dealt out by node.
2. Shorter counts are flows: a node occurs as often as the edges that leave it, and its piece
   ends; a word as often as the nodes that begin with it, and its piece ends. No phrase of one or
   two words is counted in the texts.
3. Edges and nodes of at least ``LEAST`` occurrences are the graph of candidates. Paths through
   nodes of one edge in and one out are compacted: by pointer jumping each edge learns the first
   of its path and its place, and paths are cut into rows of at most ``PATH_EDGES`` edges. A ring of
   such nodes has no first edge; its edges stay single.
4. A node's heaviest edge decides whether the node's phrase is dropped as part of a longer one:
   inside a path it is one of two neighbours, at its ends the heaviest of all paths that meet.
5. Scores use decimals of 38 digits; the first rows of each language are taken before the shuffle
   and again after it.

No group is gathered: a hot node's windows are counted before they are sent, windows of words
are sums. Two words of equal hash would count as one; at 10**8 different words that has a chance
of 1 in 3,700.

Defined cases: null text is empty; null lang is ``und`` and the same as the text ``und``; pieces of
one or two words count for what they have; rows of equal or null doc_id are texts by themselves;
an empty table, or one without frequent phrases, gives no rows; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mercato.llm.common import freeze, prepare_workers, read_table
from mercato.llm.textbytes import LOWER, Texts, chunks, column, mix, span_hashes, words

LONGEST, LEAST, TOP = 3, 10, 2_000
#: of a longer phrase's occurrences in a hundred of the shorter one's, from which that is dropped
PART = 50
#: word occurrences that a batch counts together
FLUSH = 2_000_000
#: bytes of text hashed at once
TEXT_BYTES = 1 << 20
PATH_EDGES = 1_000

#: bytes that end pieces, [.,;:!?\x0A-\x0D], and bytes of words, neither these nor [\x20\x09]
ENDS = np.zeros(256, dtype=bool)
ENDS[list(b".,;:!?\n\x0b\x0c\r")] = True
WORD = ~ENDS
WORD[[32, 9]] = False


def _lang_key(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


def word_windows(texts: Texts, langs: list[str]) -> tuple:
    """Of all words of the rows: hash, those of the next two or 0, row, first and last byte."""
    found = words(texts, WORD)
    row = np.repeat(np.arange(len(texts.at) - 1), np.diff(found.row_at))
    keys = np.array([_lang_key(x) for x in langs], np.uint64)
    h = mix(span_hashes(LOWER[texts.data], found.start, found.end) ^ (keys[row] if len(row) else np.zeros(0, np.uint64)))
    h[h == 0] = 1
    piece = np.cumsum(ENDS[texts.data])[found.start] if len(h) else h
    on = np.zeros(len(h) + 2, bool)                  # the next word is of the same piece
    on[1:len(h)] = (row[1:] == row[:-1]) & (piece[1:] == piece[:-1])
    later = np.concatenate([h, np.zeros(2, np.uint64)])
    one = np.where(on[1:-1], later[1:-1], np.uint64(0))
    two = np.where(on[1:-1] & on[2:], later[2:], np.uint64(0))
    return h, one, two, row, found.start, found.end


def _counted(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple:
    """Equal windows together, with their number, in an order in which like ones are near."""
    key = (a >> np.uint64(44) << np.uint64(44)) | (b >> np.uint64(44) << np.uint64(24)) | (c >> np.uint64(40))
    order = np.argsort(key, kind="stable")
    a, b, c = a[order], b[order], c[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])
    at = np.flatnonzero(new)                         # a clash of keys gives a window two rows, no other count
    return a[at], b[at], c[at], np.diff(np.append(at, len(new)))


def windows(docs: DataFrame) -> DataFrame:
    """docs(lang, text) -> a, b, c, n: windows of words, counted by batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def flush() -> pa.RecordBatch:
            a, b, c, n = _counted(*(np.concatenate(x) for x in zip(*held, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b, c)] + [pa.array(n, pa.int64())], names=["a", "b", "c", "n"])

        for batch in batches:
            langs = column(batch, "lang").to_pylist()
            for texts in chunks(column(batch, "text"), TEXT_BYTES):
                a, b, c, *_ = word_windows(texts, langs[texts.first:texts.first + len(texts.at) - 1])
                held.append((a, b, c))
                total += len(a)
                if total >= FLUSH:
                    whole = flush()
                    for at in range(0, len(whole), 1 << 18):
                        yield whole.slice(at, 1 << 18)
                    held, total = [], 0
        if total:
            whole = flush()
            for at in range(0, len(whole), 1 << 18):
                yield whole.slice(at, 1 << 18)

    return docs.select("lang", "text").mapInArrow(run, "a long, b long, c long, n long")


def spellings(docs: DataFrame) -> DataFrame:
    """docs(lang, text) -> h, lang, word, n: by batch, the words behind the hashes; a row of h = 0 has
    the number of all its words of a language."""
    schema = pa.schema([("h", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for batch in batches:
            langs = column(batch, "lang").to_pylist()
            for texts in chunks(column(batch, "text"), TEXT_BYTES):
                own = langs[texts.first:texts.first + len(texts.at) - 1]
                h, _, _, row, start, end = word_windows(texts, own)
                each, at = np.unique(h, return_index=True)
                low = LOWER[texts.data].tobytes()
                rows = []
                for x, k in zip(each.view(np.int64).tolist(), at.tolist(), strict=True):
                    if x not in known:
                        known.add(x)
                        rows.append((x, own[row[k]], low[start[k]:end[k]].decode(), 0))
                many: dict[str, int] = {}
                for lang, n in zip(own, np.bincount(row, minlength=len(own)).tolist(), strict=True):
                    many[lang] = many.get(lang, 0) + n
                rows += [(0, lang, None, n) for lang, n in many.items()]
                if len(known) > FLUSH // 2:
                    known.clear()
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(schema.types)], schema=schema)

    return docs.select("lang", "text").mapInArrow(run, "h long, lang string, word string, n long")


def frequent(counted: DataFrame, least: int) -> DataFrame:
    """counted(a, b, c, n) -> edges (a, b, c, n), nodes (a, b, null, n) and words (a, null, null, n) of at
    least ``least`` occurrences; the latter two from flows and piece ends."""
    # one exchange serves all three: windows of a node stand together. A flow is the sum over the edges'
    # shares, so it needs no counted edges first. What tells edges and nodes from ends is aggregated, and each
    # sum looks at all columns, else filters or a choice of columns below the exchange would make three of it
    dealt = counted.repartition("a", "b")
    graph = dealt.groupBy("a", "b", "c").agg(F.sum("n").alias("n"), F.max(F.col("c") != 0).alias("whole"))
    node = dealt.groupBy("a", "b").agg(F.sum("n").alias("n"), F.max((F.col("b") != 0) | (F.col("c") != 0)).alias("whole"))
    word = dealt.groupBy("a").agg(F.sum("n").alias("n"), F.max(F.greatest("b", "c")).alias("whole"))
    none = F.lit(None).cast("long")
    often = F.col("n") >= least
    return (graph.where(often & F.col("whole")).select("a", "b", "c", "n")
            .unionByName(node.where(often & F.col("whole")).select("a", "b", none.alias("c"), "n"))
            .unionByName(word.where(often & F.col("whole").isNotNull()).select("a", none.alias("b"), none.alias("c"), "n")))


def compact(edges: DataFrame) -> DataFrame:
    """edges(a, b, c, n) -> path, part, hashes array, weights array: rows of at most ``PATH_EDGES`` edges of
    the unary paths; ``hashes`` are the words, two more than edges."""
    into = edges.groupBy("b", "c").agg(F.count("*").alias("ins"))
    out = edges.groupBy("a", "b").agg(F.count("*").alias("outs"))
    # a node of one edge in and one out
    unary = (into.where("ins = 1").select(F.col("b").alias("x"), F.col("c").alias("y"))
             .join(out.where("outs = 1").select(F.col("a").alias("x"), F.col("b").alias("y")), ["x", "y"]))
    edge = lambda df, *by: F.struct(*(df[c] for c in by))
    before = edges.select(F.col("a").alias("p_a"), F.col("b").alias("x"), F.col("c").alias("y")).join(unary, ["x", "y"])
    joined = edges.join(before, (edges["a"] == before["x"]) & (edges["b"] == before["y"]), "left")
    own = edge(edges, "a", "b", "c")
    held = freeze(joined.select(own.alias("e"), "n", F.when(F.col("p_a").isNull(), own).otherwise(
        F.struct(F.col("p_a").alias("a"), edges["a"].alias("b"), edges["b"].alias("c"))).alias("up"),
        F.col("p_a").isNotNull().cast("long").alias("far")))
    # double the reach of each edge that hasn't found a path's first one, whose reach is 0
    left = None
    while True:
        heads = held.select(F.col("e").alias("h_e"), F.col("up").alias("h_up"), F.col("far").alias("h_far"))
        now = held.join(heads.where("h_far = 0"), F.col("up") == F.col("h_e"), "left_anti").count()
        if now == 0 or now == left:                  # what is left are rings
            break
        left = now
        held = freeze(held.join(heads, F.col("up") == F.col("h_e")).select(
            "e", "n", F.col("h_up").alias("up"), (F.col("far") + F.col("h_far")).alias("far")))
    heads = held.where("far = 0").select(F.col("e").alias("h_e"))
    told = held.join(heads, F.col("up") == F.col("h_e"), "left")
    ring = F.col("h_e").isNull()
    rows = told.select(F.when(ring, F.col("e")).otherwise(F.col("up")).alias("path"),
                       F.when(ring, 0).otherwise(F.col("far")).alias("far"), "e", "n")
    return (rows.groupBy("path", F.floor(F.col("far") / PATH_EDGES).alias("part"))
            .agg(F.sort_array(F.collect_list(F.struct("far", "e", "n"))).alias("es"))
            .select("path", "part", F.concat(F.array(F.col("es")[0]["e"]["a"], F.col("es")[0]["e"]["b"]),
                                             F.transform("es", lambda x: x["e"]["c"])).alias("hashes"),
                    F.transform("es", lambda x: x["n"]).alias("weights")))


def heaviest(paths: DataFrame) -> DataFrame:
    """paths -> a, b, longer: of each node, the weight of its heaviest edge."""
    w = F.col("weights")
    nodes = F.transform(F.sequence(F.lit(0), F.size(w)), lambda i: F.struct(
        F.get("hashes", i).alias("a"), F.get("hashes", i + 1).alias("b"),
        F.greatest(F.get(w, i - 1), F.get(w, i)).alias("longer")))
    return paths.select(F.explode(nodes).alias("x")).select("x.*").groupBy("a", "b").agg(F.max("longer").alias("longer"))


def _exact(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (l * r)) in whole decimals; counts have at most 15 digits."""
    big = lambda x: x.cast("decimal(15,0)")
    return F.call_function("div", big(a) * big(a) * F.lit(1_000_000).cast("decimal(7,0)"), big(left) * big(right))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, part: int = PART) -> DataFrame:
    """docs(lang, text) -> lang, rank, phrase, a, l, r, n, score."""
    prepare_workers(docs.sparkSession)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    found = freeze(frequent(windows(texts), least))
    edges = found.where("c is not null").select("a", "b", "c", "n")
    nodes = found.where("b is not null and c is null").select("a", "b", "n")
    once = found.where("b is null").select("a", "n")
    inside = heaviest(compact(edges))

    flow = lambda name: once.select(F.col("a").alias(name), F.col("n").alias(f"f_{name}"))
    pair = lambda x, y: nodes.select(F.col("a").alias(x), F.col("b").alias(y), F.col("n").alias(f"f_{x}{y}"))
    two = (nodes.join(inside, ["a", "b"], "left").where(f"longer is null or 100 * longer < {part} * n")
           .join(flow("a"), "a").join(flow("b"), "b")
           .select("a", "b", F.lit(None).cast("long").alias("c"), "n", F.col("f_a").alias("l"), F.col("f_b").alias("r")))
    three = edges.join(pair("b", "c"), ["b", "c"]).join(pair("a", "b"), ["a", "b"]).join(flow("a"), "a").join(flow("c"), "c")
    cuts = F.array_min(F.array(*[F.struct(_exact(F.col("n"), F.col(x), F.col(y)).alias("score"), F.lit(k).alias("k"),
                                          F.col(x).alias("l"), F.col(y).alias("r"))
                                 for k, x, y in ((1, "f_a", "f_bc"), (2, "f_ab", "f_c"))]))
    rows = (two.select("a", "b", "c", "n", "l", "r", _exact(F.col("n"), F.col("l"), F.col("r")).alias("score"))
            .unionByName(three.withColumn("cut", cuts).select("a", "b", "c", "n", "cut.l", "cut.r", "cut.score")))

    # h = 0 are the sums of each language; it stands among the words asked for, so that one scan gives both
    asked = once.select(F.col("a").alias("h")).unionByName(docs.sparkSession.range(1).select(F.col("id").alias("h")))
    known = freeze(spellings(texts).join(asked, "h", "left_semi").groupBy("h", "lang").agg(F.min("word").alias("word"), F.sum("n").alias("n")))
    total = known.where("h = 0").select("lang", F.col("n").alias("words"))
    word = lambda name: known.where("h != 0").select(F.col("h").alias(name), F.col("lang").alias(f"lang_{name}"), F.col("word").alias(f"w_{name}"))
    named = (rows.join(word("a"), "a").join(word("b"), "b").join(word("c"), "c", "left")
             .select(F.col("lang_a").alias("lang"), F.concat_ws(" ", "w_a", "w_b", "w_c").alias("phrase"), F.col("n").alias("a"), "l", "r", "score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (named.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
            .join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("words").alias("n"), "score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


SQL = r"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS piece, p
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[.,;:!?\x0A-\x0D]')) AS p
        FROM documents)),
listed AS (SELECT lang, piece, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM pieces),
placed AS (SELECT lang, piece, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM listed),
runs AS (SELECT lang, w AS a, lead(w) OVER x AS b, lead(w, 2) OVER x AS c FROM placed WINDOW x AS (PARTITION BY piece ORDER BY i)),
total AS (SELECT lang, count(*) AS n FROM runs GROUP BY lang),
one AS (SELECT lang, a, count(*) AS n FROM runs GROUP BY lang, a HAVING count(*) >= 10),
two AS (SELECT lang, a, b, count(*) AS n FROM runs WHERE b IS NOT NULL GROUP BY lang, a, b HAVING count(*) >= 10),
three AS (SELECT lang, a, b, c, count(*) AS n FROM runs WHERE c IS NOT NULL GROUP BY lang, a, b, c HAVING count(*) >= 10),
longer AS (SELECT lang, a, b, max(n) AS n
           FROM (SELECT lang, a, b, n FROM three UNION ALL SELECT lang, b, c, n FROM three) GROUP BY lang, a, b),
pairs AS (
  SELECT t.lang, t.a || ' ' || t.b AS phrase, t.n AS a, x.n AS l, y.n AS r, 1000000::HUGEINT * t.n * t.n // (x.n::HUGEINT * y.n) AS score
  FROM two t JOIN one x ON x.lang = t.lang AND x.a = t.a JOIN one y ON y.lang = t.lang AND y.a = t.b
  LEFT JOIN longer m ON m.lang = t.lang AND m.a = t.a AND m.b = t.b
  WHERE m.n IS NULL OR 100 * m.n < 50 * t.n),
cuts AS (
  SELECT t.lang, t.a || ' ' || t.b || ' ' || t.c AS phrase, t.n AS a, x.n AS l1, bc.n AS r1, ab.n AS l2, z.n AS r2,
         1000000::HUGEINT * t.n * t.n // (x.n::HUGEINT * bc.n) AS s1, 1000000::HUGEINT * t.n * t.n // (ab.n::HUGEINT * z.n) AS s2
  FROM three t
  JOIN one x ON x.lang = t.lang AND x.a = t.a
  JOIN one z ON z.lang = t.lang AND z.a = t.c
  JOIN two ab ON ab.lang = t.lang AND ab.a = t.a AND ab.b = t.b
  JOIN two bc ON bc.lang = t.lang AND bc.a = t.b AND bc.b = t.c),
scored AS (
  SELECT lang, phrase, a, l, r, score FROM pairs
  UNION ALL
  SELECT lang, phrase, a, CASE WHEN s2 < s1 THEN l2 ELSE l1 END, CASE WHEN s2 < s1 THEN r2 ELSE r1 END, least(s1, s2) FROM cuts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM scored)
SELECT s.lang, s.rank, s.phrase, s.a, s.l, s.r, t.n, s.score::BIGINT AS score
FROM ranked s JOIN total t ON t.lang = s.lang
WHERE s.rank <= 2000
"""
