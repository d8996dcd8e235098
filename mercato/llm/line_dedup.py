"""Line dedup: winnowing over line hashes.

The items of a document are its non-blank lines, trimmed. Over the sequence of
line hashes each window of ``window`` consecutive lines selects its minimum (the
last of equal ones) as a fingerprint. Two copies of a run of ``window`` lines hold
the same window, and the same window selects the same line, so every run of at
least ``window`` lines that occurs twice shares a fingerprint: that is the
guarantee. A line of at least ``long_words`` words is a run by itself and its own
fingerprint.

1. fingerprints are aggregated (combined before the shuffle) and those that occur
   at one position only are dropped;
2. the positions of the others are joined with them, and each position's windows
   are matched by their full content: the runs of ``window`` lines around the
   fingerprint, to the left and to the right of it. Where neighbouring windows
   match as well, their union is the match extended both ways;
3. a window that occurs at an earlier (doc_id, line) is a later repeat, and its
   lines are deleted.

Everything is DataFrame functions. Groups are reduced to their first position
before a join, so a hot line costs its rows once and AQE may split them.

Defined cases: null text stays null (0 lines); blank lines are no items and stay;
rows of equal doc_id and text are one document and treated alike; a null doc_id
sorts before all others; a run may overlap its own later copy (ten equal lines
leave one). Text shorter than a run is left alone unless it has a long line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.llm.common import free_names, freeze, read_table, sha256

#: lines of the shortest run that is always found
WINDOW = 2
#: words of a line that counts as a run alone, told by runs of white space
LONG_WORDS = 8
WHITE = r"\t-\r \u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: letters in a row from which on a line of a script without spaces is long
LONG_UNSPACED = 24
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}\p{IsYi}\p{IsJavanese}]"
#: digits and signs that may stand between them
SIGNS = r"[0-9\u3001-\u3004\u3008-\u3020\u30FB\u30FC\uFF01-\uFF65\u2018-\u201D\u2026]{0,8}+"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _long(line: Column, words: int) -> Column:
    """Whether a trimmed line has so many words, told by runs of white space; a text of a script
    without spaces is long by its length. One look at a line, that ends with the last word asked for."""
    many = F.regexp_like(line, F.lit(rf"^[{WHITE}]*+(?:[^{WHITE}]++[{WHITE}]++){{{words - 1}}}[^{WHITE}]"))
    unspaced = F.regexp_like(line, F.lit(rf"(?:{UNSPACED}{SIGNS}){{{LONG_UNSPACED}}}"))
    # no so many words in fewer characters; ASCII has a byte a character
    return (((F.length(line) >= 2 * words - 1) & many)
            | ((F.length(line) >= LONG_UNSPACED) & (F.octet_length(line) > F.length(line)) & unspaced))


def line_runs(docs: DataFrame, window: int = WINDOW, long_words: int = LONG_WORDS) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, body, line_nos): for each document with
    repeats, the numbers (from 0) of the lines to delete. ``body`` is the hash of its text."""
    lines = F.filter(F.transform(_lines(F.col("text")), lambda x, i: F.struct(i.alias("no"), F.trim(x).alias("line"))),
                     lambda x: x["line"] != "")
    items = F.transform(lines, lambda x: F.struct(
        x["no"].alias("no"), F.xxhash64(x["line"]).alias("h"),
        _long(x["line"], long_words).alias("long")))
    # repeated rows give equal run starts, which neither add nor remove a position
    base = (docs.where("text is not null")
            .select("doc_id", F.xxhash64("text").alias("body"), items.alias("items"))
            .where(F.size("items") > 0))
    # one row a run start: its lines, the fingerprint that its window selects, its content
    part = F.slice(F.col("items"), F.col("at") + 1, window)
    wide = (base.select("doc_id", "body", "items", F.posexplode("items").alias("at", "item"))
            .select("doc_id", "body", "at", part.alias("part")))
    wide = wide.select("doc_id", "body", "at", "part", F.array_min(F.transform("part", lambda x, j: F.struct(
        x["h"].alias("h"), (-j).alias("back")))).alias("least"))
    runs = wide.select("doc_id", "body", F.explode(F.concat(
        F.when(F.size("part") == window, F.array(F.struct(
            F.col("at").alias("at"), F.col("least.h").alias("fp"),
            (F.col("at") - F.col("least.back")).alias("fp_at"),
            F.xxhash64(F.transform("part", lambda x: x["h"])).alias("run"),
            F.transform("part", lambda x: x["no"]).alias("nos"))))
        .otherwise(F.array()),
        F.when(F.col("part")[0]["long"], F.array(F.struct(
            F.col("at").alias("at"), F.col("part")[0]["h"].alias("fp"), F.col("at").alias("fp_at"),
            F.xxhash64(F.array(F.col("part")[0]["h"]), F.lit(1)).alias("run"),
            F.array(F.col("part")[0]["no"]).alias("nos"))))
        .otherwise(F.array()))).alias("r")).select("doc_id", "body", "r.*")
    place = F.struct("doc_id", "body", "fp_at")
    # written, so that the join with them is one that Spark can split at a hot line
    prints = freeze(runs.groupBy("fp").agg(F.min(place).alias("first"), F.max(place).alias("last"))
                    .where("first != last").select("fp"))
    near = freeze(runs.join(prints, "fp").drop("fp", "fp_at"))       # used twice
    start = F.struct("doc_id", "body", "at")
    firsts = freeze(near.groupBy("run").agg(F.min(start).alias("first"), F.max(start).alias("last"))
                    .where("first != last").select("run", "first"))
    later = near.join(firsts, "run").where(F.struct("doc_id", "body", "at") > F.col("first"))
    return (later.select("doc_id", "body", F.explode("nos").alias("no"))
            .groupBy("doc_id", "body").agg(F.sort_array(F.collect_set("no")).alias("line_nos")))


def _flags(nos: Column) -> Column:
    """Sorted numbers -> an array that is true at each of them, up to the last."""
    before = F.concat(F.array(F.lit(-1)), F.slice(nos, F.lit(1), F.size(nos) - 1))
    return F.flatten(F.zip_with(nos, before, lambda n, b: F.concat(
        F.array_repeat(F.lit(False), n - b - 1), F.array(F.lit(True)))))


def dedup_lines(docs: DataFrame, window: int = WINDOW, long_words: int = LONG_WORDS,
                report: bool = False, drop_emptied: bool = False) -> DataFrame:
    """``docs`` with the later repeated runs deleted from ``text`` and n_chars set anew
    where there is such a column. ``drop_emptied`` leaves out documents of which only blank
    lines remain: all they said is said earlier. ``report`` adds n_lines, n_removed and n_runs (maximal
    runs of deleted lines; blank lines between them don't part them)."""
    k_id, k_body, nos, n_lines, n_removed, n_runs = free_names(
        docs.columns, "_k_id", "_k_body", "_nos", "n_lines", "n_removed", "n_runs")
    gone_at = F.struct(_flags(F.col("line_nos")).alias("flags"), F.size("line_nos").alias("n"))
    found = line_runs(docs, window, long_words).select(
        F.col("doc_id").alias(k_id), F.col("body").alias(k_body), gone_at.alias(nos))
    joined = docs.join(found, docs["doc_id"].eqNullSafe(F.col(k_id)) & (F.xxhash64(docs["text"]) == F.col(k_body)), "left")
    untouched = F.col(nos).isNull()
    # lines with their flags, walked once: nothing is looked up for a line
    marked = F.zip_with(_lines(F.col("text")), F.col(nos)["flags"], lambda x, f: F.struct(
        x.alias("line"), F.coalesce(f, F.lit(False)).alias("gone")))
    kept = F.transform(F.filter(marked, lambda x: ~x["gone"]), lambda x: x["line"])
    text = F.when(untouched, F.col("text")).otherwise(F.array_join(kept, "\n"))
    out = joined
    if report:
        flags = F.transform(F.filter(marked, lambda x: F.trim(x["line"]) != ""), lambda x: x["gone"])
        starts = F.zip_with(flags, F.concat(F.array(F.lit(False)), flags), lambda f, before: F.coalesce(f, F.lit(False)) & ~before)
        full = F.size(F.filter(_lines(F.col("text")), lambda x: F.trim(x) != ""))
        out = (out.withColumn(n_lines, F.when(F.col("text").isNull(), F.lit(0)).otherwise(full).cast("long"))
               .withColumn(n_removed, F.coalesce(F.col(nos)["n"], F.lit(0)).cast("long"))
               .withColumn(n_runs, F.when(untouched, F.lit(0)).otherwise(F.size(F.filter(starts, lambda s: s))).cast("long")))
    out = out.withColumn("text", text)
    if drop_emptied:
        out = out.where(untouched | (F.trim(F.regexp_replace("text", "\n", "")) != ""))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(untouched, F.col("n_chars")).otherwise(
            F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.drop(k_id, k_body, nos)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, report=True).select(
        "doc_id", "n_lines", "n_removed", "n_runs", sha256(F.col("text")).alias("text_sha256"))


SQL = r"""
WITH raw AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS raw_line,
         generate_subscripts(string_split(text, chr(10)), 1) AS no
  FROM documents WHERE text IS NOT NULL),
items AS (
  SELECT doc_id, no, trim(raw_line, ' ') AS line,
         row_number() OVER (PARTITION BY doc_id ORDER BY no) AS ix,
         lead(trim(raw_line, ' ')) OVER (PARTITION BY doc_id ORDER BY no) AS next_line
  FROM raw WHERE trim(raw_line, ' ') <> ''),
pairs AS (
  SELECT doc_id, ix, row_number() OVER (PARTITION BY line, next_line ORDER BY doc_id, ix) AS seen
  FROM items WHERE next_line IS NOT NULL),
longs AS (
  SELECT doc_id, ix, row_number() OVER (PARTITION BY line ORDER BY doc_id, ix) AS seen
  FROM items WHERE regexp_matches(line, '^[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]*(?:[^\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+){7}[^\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]')
     OR regexp_matches(line, '(?:[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}\p{Yi}\p{Javanese}][0-9\x{3001}-\x{3004}\x{3008}-\x{3020}\x{30FB}\x{30FC}\x{FF01}-\x{FF65}\x{2018}-\x{201D}\x{2026}]{0,8}){24}')),
gone AS (
  SELECT doc_id, ix FROM pairs WHERE seen > 1
  UNION SELECT doc_id, ix + 1 FROM pairs WHERE seen > 1
  UNION SELECT doc_id, ix FROM longs WHERE seen > 1),
stats AS (
  SELECT doc_id, count(*) AS n_lines, count(g.ix) AS n_removed,
         count(CASE WHEN g.ix IS NOT NULL AND p.ix IS NULL THEN 1 END) AS n_runs
  FROM items i LEFT JOIN gone g USING (doc_id, ix)
  LEFT JOIN gone p ON p.doc_id = i.doc_id AND p.ix = i.ix - 1
  GROUP BY doc_id),
kept AS (
  SELECT r.doc_id, string_agg(r.raw_line, chr(10) ORDER BY r.no) AS text
  FROM raw r LEFT JOIN items i ON i.doc_id = r.doc_id AND i.no = r.no
  LEFT JOIN gone g ON g.doc_id = i.doc_id AND g.ix = i.ix
  WHERE g.ix IS NULL GROUP BY r.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       coalesce(n_runs, 0) AS n_runs,
       CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(kept.text, '')) END AS text_sha256
FROM documents d LEFT JOIN stats USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
