"""Document fingerprints from prefix polynomial hashes.

``PrefixHash`` keeps sum(c[j] * BASE**j, j < i) mod a prime for every i, so the hash of
any span is a difference, moved to position 0 by an inverse power; two spans are
compared in constant time and the longest common extension of two places is found by
binary search. The fingerprint keeps the hashes of a text's beginnings and endings at
lengths of a fixed grid (all up to 16, then ``PER_OCTAVE`` an octave) and of the whole, so
that the same binary search works on two fingerprints without their texts. Their likeness
is the share of the longer text that a common beginning and a common ending are known to
cover, 1 for equal texts.

``with_next`` hands each document its successor by doc_id: documents are dealt to ranges of
doc_id, each range also gets the first document of the following one (after the last: of the
first), and a task walks its sorted ranges with two documents in memory. One shuffle.

Defined cases: null text is empty; two empty texts have likeness 1, an empty and a non-empty
one 0; a null doc_id sorts before all; rows of equal doc_id are ordered by a hash of their
text, so each row has one successor; a single row succeeds itself; no rows give no rows. Only
doc_id and text are read.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.llm.common import prepare_workers, read_table
from mercato.llm.textbytes import column

PRIME = (1 << 31) - 1
BASE = 1_103_515_245 % PRIME
SECOND = 69_069           # for the second hash of the whole, against chance
PER_OCTAVE = 8
RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")

_tables: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) mod PRIME."""
    table = _tables.get(base, np.ones(1, np.uint64))
    while len(table) < n:
        table = np.concatenate([table, table * np.uint64(pow(base, len(table), PRIME)) % np.uint64(PRIME)])
        _tables[base] = table if len(table) <= 1 << 20 else table[:1 << 20]
    return table[:n]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


class PrefixHash:
    def __init__(self, points: np.ndarray, base: int = BASE):
        self.n, self.base = len(points), base
        terms = (points.astype(np.uint64) + np.uint64(1)) * powers(base, self.n) % np.uint64(PRIME)
        self.upto = np.zeros(self.n + 1, np.uint64)
        np.cumsum(terms, out=self.upto[1:])
        self.upto %= np.uint64(PRIME)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of spans, equal for equal spans wherever they are."""
        inverse = powers(pow(self.base, -1, PRIME), self.n + 1)
        return (self.upto[end] + np.uint64(PRIME) - self.upto[start]) % np.uint64(PRIME) * inverse[start] % np.uint64(PRIME)

    def equal(self, i: int, other: PrefixHash, j: int, size: int) -> bool:
        a, b = self.spans(np.array([i]), np.array([i + size])), other.spans(np.array([j]), np.array([j + size]))
        return bool(a[0] == b[0])

    def common_extension(self, i: int, other: PrefixHash, j: int) -> int:
        """The greatest size with equal spans at i and at j of the other."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            middle = (low + high + 1) // 2
            if self.equal(i, other, j, middle):
                low = middle
            else:
                high = middle - 1
        return low


_grid = list(range(1, 17))


def grid(n: int) -> list[int]:
    """The lengths kept for a text of n: those of the grid up to n."""
    k = len(_grid) - 16
    while _grid[-1] < n:
        k += 1
        _grid.append(int(16 * 2 ** (k / PER_OCTAVE)))
    return _grid[:bisect_right(_grid, n)]


def fingerprint(points: np.ndarray) -> str:
    """``n.whole.beginnings.endings``"""
    hashes, n = PrefixHash(points), len(points)
    whole = (int(hashes.upto[n]), int(PrefixHash(points, SECOND).upto[n]))
    size = np.array(grid(n), np.int64)
    beginnings = hashes.upto[size]
    endings = hashes.spans(n - size, np.full(len(size), n))
    encode = lambda a: base64.b64encode(a.astype("<u4").tobytes(), b"-_").decode()
    return f"{n}.{whole[0]:08x}{whole[1]:08x}.{encode(beginnings)}.{encode(endings)}"


def _parse(text: str) -> tuple[int, str, np.ndarray, np.ndarray]:
    n, whole, *parts = text.split(".")
    return int(n), whole, *(np.frombuffer(base64.b64decode(p, b"-_"), "<u4") for p in parts)


def _common(a: np.ndarray, b: np.ndarray, sizes: list[int]) -> int:
    """The greatest length of the grid at which the hashes agree, by binary search."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[middle - 1] == b[middle - 1]:
            low = middle
        else:
            high = middle - 1
    return sizes[low - 1] if low else 0


def likeness(one: str, two: str) -> float:
    n, whole, begin, end = _parse(one)
    m, other, begin2, end2 = _parse(two)
    if n == m and whole == other:
        return 1.0
    if not n or not m:
        return 0.0
    sizes = grid(max(n, m))
    return min(_common(begin, begin2, sizes) + _common(end, end2, sizes), min(n, m)) / max(n, m)


def with_next(docs: DataFrame, ranges: int) -> DataFrame:
    """docs(doc_id, text) -> (range, more, doc_id, text): sorted ranges of doc_id, each followed
    by the first document(s) of the next, marked ``more``."""
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), key.alias("key"))
    keys = rows.select("key")
    bounds = sorted({int(b) for b in keys.approxQuantile("key", [k / ranges for k in range(1, ranges)], 0.2 / ranges)}) if ranges > 1 else []
    step = max(1, int(len(bounds) ** 0.5))
    # ranges are numbered in two looks: over every step-th bound, then over the step between
    fine = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<long>")
    coarse = F.filter(fine, lambda b, i: (i % step == step - 1)) if bounds else fine
    passed = F.size(F.filter(coarse, lambda b: b <= F.col("key"))) * step
    number = passed + F.size(F.filter(F.slice(fine, passed + 1, step), lambda b: b <= F.col("key")))
    rows = rows.withColumn("range", number.cast("int"))
    firsts = sorted((r["range"], r["key"]) for r in rows.groupBy("range").agg(F.min("key").alias("key")).collect())  # one a range
    after = [(firsts[(k + 1) % len(firsts)][1], here) for k, (here, _) in enumerate(firsts)]
    also = spark.createDataFrame(after, "key long, also int").groupBy("key").agg(F.collect_list("also").alias("also"))
    dealt = rows.join(F.broadcast(also), "key", "left").select(
        "doc_id", "text", "key", F.explode(F.concat(
            F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("more"))),
            F.transform(F.coalesce("also", F.array().cast("array<int>")),
                        lambda r: F.struct(r.alias("range"), F.lit(True).alias("more"))))).alias("to"))
    return (dealt.select("to.range", "to.more", "key", "doc_id", "text").repartition(max(1, ranges), "range")
            .sortWithinPartitions("range", "more", "key", F.xxhash64("text")))


def fingerprints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """docs(doc_id, text) -> RESULT."""
    spark = docs.sparkSession
    prepare_workers(spark)
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            out = []
            for where, more, doc_id, text in zip(*(column(batch, c) for c in ("range", "more", "doc_id", "text")), strict=True):
                where, more, points = where.as_py(), more.as_py(), code_points(text.as_py())
                own = fingerprint(points)
                if held and held[0] == where and not held[1]:
                    _, _, last_id, last, mark = held
                    q = len(last) // 4
                    edited = np.concatenate([last[:len(last) - q], points[:q]])
                    edited_mark = fingerprint(edited)
                    raw = edited.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
                    out.append((last_id, len(last), hashlib.sha256(raw).hexdigest(), mark, edited_mark,
                                likeness(mark, edited_mark), likeness(mark, own)))
                held = (where, more, doc_id.as_py(), points, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), SCHEMA, strict=True)], schema=SCHEMA)

    return with_next(docs, n).select("range", "more", "doc_id", "text").mapInArrow(run, RESULT)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read_table(spark, sf_dir, "documents"))
