"""Best-fit packing planned over the histogram of piece lengths.

1. Tokenize, cut and measure: one pass without a shuffle. Each piece gets its rank
   among the pieces of its length in its task. The table of pieces (a few numbers a
   piece, no ids) is frozen, as it is used twice.
2. Count pieces by (task, length); a running sum over the tasks turns ranks in a
   task into ranks in the corpus. No group of equal lengths meets in one task.
3. Best-fit decreasing over the at most ``SEQ_LEN`` counts: whole groups of equal
   bins are filled at once, so planning takes the same time for any corpus. A plan row
   says: pieces of this length with ranks lo..hi-1 fill these sequences at this offset.
4. Pieces take their slots by joining the plan on length and rank.

Defined cases: null or empty text is one piece with the end token alone; every row
of the input is packed, repeated rows and null ids too; no rows give no plan. Only
doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mercato.llm.common import freeze, read_table, prepare_workers
from mercato.llm.textbytes import column
from mercato.llm.tokens import encoder, vocabulary_path

SEQ_LEN = 1024
END_ID = 2
PIECES = ("doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank_in_task long")


def cut(n: int, size: int = SEQ_LEN) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, the first may be shorter."""
    first = n % size if n > size else n
    out = [(0, first)] if first else []
    return out + [(s, size) for s in range(first, n, size)]


def pieces(docs: DataFrame, vocabulary: str, size: int = SEQ_LEN, end_id: int = END_ID) -> DataFrame:
    """docs(doc_id, text) -> PIECES."""
    tail = np.array([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, seen = encoder(vocabulary), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            for doc_id, text in zip(column(batch, "doc_id").to_pylist(), column(batch, "text"), strict=True):
                ids = np.concatenate([encode(text.as_py() or ""), tail])
                for k, (start, length) in enumerate(cut(len(ids), size)):
                    row = (doc_id, k, start, length, zlib.crc32(ids[start:start + length]), task, int(seen[length]))
                    seen[length] += 1
                    for col, value in zip(out, row, strict=True):
                        col.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(out, SCHEMA.types, strict=True)], schema=SCHEMA)

    prepare_workers(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                    ("ids_crc32", pa.int64()), ("task", pa.int32()), ("rank_in_task", pa.int64())])


def plan(counts: dict[int, int], size: int = SEQ_LEN) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts -> rows (length, lo, hi, first sequence, offset, per
    sequence): ranks lo..hi-1 go, ``per`` to a sequence, to the sequences from ``first`` on.

    Bins of equal room are kept as runs of sequence numbers. The smallest room that
    fits is best; it stays the smallest while pieces of this length fit, so a bin takes
    room // length of them before the next bin's turn."""
    rows, bins, opened = [], {}, 0          # bins: room -> [(first sequence, how many)]

    def put(room: int, first: int, many: int) -> None:
        if many and room:
            bins.setdefault(room, []).append((first, many))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = min((r for r in bins if r >= length), default=None)
            if room is None:
                per = size // length
                many = -(-left // per)
                first, opened, room = opened, opened + many, size
            else:
                first, many = bins[room].pop()
                if not bins[room]:
                    del bins[room]
                per = room // length
            full = min(many, left // per)
            if full:
                rows.append((length, rank, rank + full * per, first, size - room, per))
                rank, left = rank + full * per, left - full * per
                put(room - per * length, first, full)
            if full < many and left:        # fewer than ``per`` are left: one bin takes them
                rows.append((length, rank, rank + left, first + full, size - room, per))
                put(room - left * length, first + full, 1)
                full, left = full + 1, 0
            put(room, first + full, many - full)
    return rows


def pack(docs: DataFrame, vocabulary: str | None = None, size: int = SEQ_LEN, end_id: int = END_ID) -> DataFrame:
    """docs(doc_id, text) -> doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    cut_up = freeze(pieces(docs, vocabulary or vocabulary_path(), size, end_id))
    by_task = cut_up.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= size rows
    slots = spark.createDataFrame(plan(counts, size), "length long, lo long, hi long, first long, at long, per long")
    ranked = cut_up.join(offsets, ["task", "length"]).withColumn("rank", F.col("before") + F.col("rank_in_task"))
    # the plan has a few rows a length, whatever the size of the corpus
    placed = ranked.join(F.broadcast(slots), (ranked["length"] == slots["length"])
                         & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    nth = F.col("rank") - F.col("lo")
    return placed.select(
        "doc_id", "piece", "start", ranked["length"], "ids_crc32",
        (F.col("first") + F.floor(nth / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("at") + nth % F.col("per") * ranked["length"]).cast("long").alias("offset"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
