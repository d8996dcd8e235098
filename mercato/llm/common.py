"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import pathlib
import tempfile
import zipfile
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.session import checkpoint_dir

#: Bytes of a batch handed to Python, or one row: texts may be long.
BATCH_BYTES = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(taken: Iterable[str], *bases: str) -> list[str]:
    """Column names that clash with none of ``taken`` (names compare without case)."""
    used = {c.lower() for c in taken}
    out = []
    for base in bases:
        name = base
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def prepare_workers(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session and ship this package to the executors,
    where Python may not find it by itself."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        top = pathlib.Path(__file__).resolve().parents[1]
        archive = os.path.join(tempfile.mkdtemp(prefix="mercato-code-"), f"{top.name}.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for source in sorted(top.rglob("*.py")):
                z.write(source, source.relative_to(top.parent))
        sc.addPyFile(archive)
        _shipped.add(sc.applicationId)


_shipped: set[str] = set()


def give_back_memory() -> None:
    """Return what Python and numpy have freed to the system, where the C library can: a driver that
    has learned a model, or a worker between two stages, goes on with little memory."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def drop_unused(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files and checkpoints of tables that nothing refers to any more. Its
    cleaner learns of them when the driver collects garbage, which may be long after the job."""
    gc.collect()
    spark._jvm.System.gc()


def freeze(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there:
    lineage is cut and partition ids stay as they are. Survives a lost executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def held_out(doc_id: Column) -> Column:
    """The fixed fold: crc32 of the id as text, remainder 0 of 5. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def bounded_rows(df: DataFrame, order: Column, limit: int) -> list:
    """At most ``limit`` rows, those first by ``order`` -- a bounded sample for a fit."""
    return df.orderBy(order).limit(limit).collect()


def learning_texts(each: DataFrame, docs: DataFrame, rows: int, chars: int) -> list:
    """each(label, h, n: hash and length of a text), docs(text, lang, ...) -> (label, h, text, lang): of
    each label at most ``rows`` distinct texts of at most ``chars`` characters, the first by hash; where a label
    has fewer, also its shortest longer ones, while all are within ``rows * chars`` characters, and one at least."""
    each = freeze(each.groupBy("label", "h").agg(F.min("n").alias("n")))
    counts = {r["label"]: r["short"] for r in each.groupBy("label").agg(F.count(F.when(F.col("n") <= chars, 1)).alias("short")).collect()}
    share = F.lit(0.0)
    for label, n in counts.items():       # some to spare, of which the first are taken
        share = F.when(F.col("label") == label, F.lit(min(1.0, (1.3 * rows + 100) / max(1, n)))).otherwise(share)
    hashed = F.pmod("h", F.lit(1 << 30)) / float(1 << 30)
    chosen: dict = {label: [] for label in counts}
    room = dict.fromkeys(counts, rows * chars)
    some = each.where((F.col("n") <= chars) & (hashed < share)).collect()
    for r in sorted(some, key=lambda r: (r["h"] % (1 << 30), r["h"])):
        if len(chosen[r["label"]]) < rows:
            chosen[r["label"]].append(r["h"])
            room[r["label"]] -= r["n"]
    for label, n in counts.items():
        if n < rows:
            for r in each.where((F.col("label") == label) & (F.col("n") > chars)).orderBy("n", "h").limit(rows - n).collect():
                room[label] -= r["n"]
                if room[label] >= 0 or not chosen[label]:
                    chosen[label].append(r["h"])
    picked = [(label, h) for label, own in chosen.items() for h in own]
    if not picked:
        return []
    wanted = docs.sparkSession.createDataFrame(picked, each.select("label", "h").schema)
    return (docs.select(F.xxhash64("text").alias("h"), "text", "lang").join(F.broadcast(wanted), "h")
            .groupBy("label", "h").agg(F.first("text").alias("text"), F.min("lang").alias("lang")).orderBy("h", "label").collect())


def sha256(col: Column) -> Column:
    return F.sha2(col.cast("binary"), 256)
