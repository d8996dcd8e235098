"""Byte-level BPE: encoding by ranks, decoding to the very bytes.

Each match of a pattern (a pre-token) is merged by itself, so a text may be cut wherever a
pre-token begins. Where that is isn't known in the middle of a text; it is found by overlap:

1. A text beyond ``CHUNK`` code points is cut into chunks that overlap by ``OVERLAP``; chunks
   are rows, dealt to tasks by themselves, whatever their document's length.
2. Each chunk is pre-tokenised from its own beginning. At first it may be out of step with
   the whole text, but matching has no memory: from a place where its predecessor, known to
   be in step, begins a pre-token too, the two go on alike. Neighbours are joined on the first
   such place in their overlap. A place counts if the predecessor saw enough behind it to be
   sure, and if no white space stands before it (there the pattern looks ahead).
3. Neighbours without one (a word longer than the overlap) become one chunk, and the step is
   repeated for these until all are in step. Each round leaves fewer chunks.
4. The stretch between its own place and its successor's is encoded by each chunk, and a
   document's ids are put together in order. Decoding concatenates the ids' bytes.

Texts of one chunk are encoded as they are read. Ids are those of ``tiktoken`` for the ranks and
the pattern, without special tokens.

Defined cases: null is the empty text (no ids, empty bytes); rows of equal or null doc_id are
texts by themselves; white space only, one word of any length, text without spaces: as any
other; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mercato.llm.common import freeze, prepare_workers, read_table
from mercato.llm.textbytes import column

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: code points of a chunk, and of the next ones that it sees as well
CHUNK, OVERLAP = 16_384, 1_024
#: code points behind a pre-token's end that its match may look at
AHEAD = 3
_CHUNKS = "uid long, doc_id long, k int, start long, text string"
_made: dict[str, object] = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def default_pattern() -> str:
    import public_tokenizers
    return public_tokenizers.PATTERN


def encoding(vocabulary: str, pattern: str):
    """The ranks' encoding, kept for a worker's life."""
    key = f"{vocabulary}\0{pattern}"
    if key not in _made:
        import tiktoken
        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _made[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _made[key]


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def read_chunks(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """docs(doc_id, text) -> _CHUNKS: the overlapping chunks of each text, as rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows = []
            for doc_id, text in zip(column(batch, "doc_id").to_pylist(), column(batch, "text").to_pylist(), strict=True):
                uid += 1
                # a last chunk of the overlap only would say nothing new
                for k, start in enumerate(range(0, max(1, len(text) - overlap), chunk)):
                    rows.append((uid, doc_id, k, start, text[start:start + chunk + overlap]))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(schema.types)], schema=schema)

    schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("k", pa.int32()), ("start", pa.int64()), ("text", pa.string())])
    return docs.select("doc_id", "text").mapInArrow(run, _CHUNKS)


def boundaries(text: str, pattern: regex.Pattern, overlap: int, last: bool) -> tuple[list[int], list[int]]:
    """Beginnings of pre-tokens in a chunk's first ``overlap`` code points, and those in its last
    ones that are sure and have no white space before them."""
    starts, ends = [], []
    tail, size = len(text) - overlap, len(text)
    for m in pattern.finditer(text):
        s, e = m.span()
        if s < overlap:
            starts.append(s)
        # the end of a sure match is the beginning of the next
        if not last and tail <= e < size and e + AHEAD <= size and not text[e - 1].isspace():
            ends.append(e)
    return starts, ends


def in_step(chunks: DataFrame, pattern: str, overlap: int) -> DataFrame:
    """chunks(uid, k, start, text, ...) -> uid, k, here: the first place (in the whole text) where a
    chunk is in step with its predecessor; null if there is none, 0 for a text's first chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = regex.compile(pattern)
        for batch in batches:
            rows = []
            for uid, k, start, text in zip(*(column(batch, c).to_pylist() for c in ("uid", "k", "start", "text")), strict=True):
                head, tail = boundaries(text, match, overlap, False)
                rows.append((uid, k, [start + x for x in head], [start + x for x in tail]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema) \
                if rows else pa.RecordBatch.from_pylist([], schema=schema)

    schema = pa.schema([("uid", pa.int64()), ("k", pa.int32()), ("head", pa.list_(pa.int64())), ("tail", pa.list_(pa.int64()))])
    places = chunks.select("uid", "k", "start", "text").mapInArrow(run, "uid long, k int, head array<long>, tail array<long>")
    order = Window.partitionBy("uid").orderBy("k")     # the chunks of one text, with places near their ends only
    before = F.lag("tail").over(order)
    return places.select("uid", "k", F.when(F.row_number().over(order) == 1, F.lit(0).cast("long"))
                         .otherwise(F.array_min(F.array_intersect("head", before))).alias("here"))


def stitched(chunks: DataFrame, pattern: str, overlap: int) -> DataFrame:
    """chunks(uid, doc_id, k, start, text) -> the same with ``here`` and ``there``: the stretch of the
    whole text that a chunk is to encode (``there`` is null at a text's end)."""
    while True:
        chunks = freeze(chunks)
        marks = freeze(in_step(chunks, pattern, overlap))
        if marks.where("here is null").isEmpty():
            order = Window.partitionBy("uid").orderBy("k")
            return chunks.join(marks.select("uid", "k", "here", F.lead("here").over(order).alias("there")), ["uid", "k"])
        # runs of chunks that aren't in step become one, without what they share
        run = F.count("here").over(Window.partitionBy("uid").orderBy("k"))
        rows = F.sort_array(F.collect_list(F.struct("k", "start", "text")))
        chunks = (chunks.join(marks, ["uid", "k"]).withColumn("run", run).groupBy("uid", "doc_id", "run").agg(rows.alias("all"))
                  .select("uid", "doc_id", F.col("all")[0]["k"].alias("k"), F.col("all")[0]["start"].alias("start"),
                          F.array_join(F.transform("all", lambda x, i: F.when(i == 0, x["text"]).otherwise(
                              F.substr(x["text"], F.lit(overlap + 1)))), "").alias("text")))


def _encode_stretches(chunks: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """chunks(uid, doc_id, k, start, text, here, there) -> uid, doc_id, k, ids of the stretches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoding(vocabulary, pattern)
        for batch in batches:
            out = []
            for start, text, here, there in zip(*(column(batch, c).to_pylist() for c in ("start", "text", "here", "there")), strict=True):
                out.append(_packed(bpe.encode_ordinary(text[here - start:None if there is None else there - start])))
            yield pa.RecordBatch.from_arrays([column(batch, c) for c in ("uid", "doc_id", "k")] + [pa.array(out, pa.binary())],
                                             names=["uid", "doc_id", "k", "ids"])

    return chunks.select("uid", "doc_id", "k", "start", "text", "here", "there").mapInArrow(run, "uid long, doc_id long, k int, ids binary")


def encode(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None,
           chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """docs(doc_id, text) -> doc_id, ids: little-endian unsigned 32-bit numbers, a row for each row."""
    prepare_workers(docs.sparkSession)
    vocabulary, pattern = vocabulary or vocabulary_path(), pattern or default_pattern()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    several = F.length("text") > chunk + overlap
    # one chunk is a whole text: one stretch
    nothing = F.lit(0).cast("long")
    single = texts.where(~several).select(nothing.alias("uid"), "doc_id", F.lit(0).alias("k"), nothing.alias("start"), "text",
                                          nothing.alias("here"), F.lit(None).cast("long").alias("there"))
    cut = read_chunks(texts.where(several), chunk, overlap).repartition("uid", "k")
    parts = _encode_stretches(stitched(cut, pattern, overlap), vocabulary, pattern)
    # the ids of one text, in order
    whole = (parts.groupBy("uid", "doc_id").agg(F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("all"))
             .select("doc_id", F.aggregate("all", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids")))
    return _encode_stretches(single, vocabulary, pattern).select("doc_id", "ids").unionByName(whole)


def decode(encoded: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """encoded(ids, ...) -> the same with ``bytes``: those of the ids, one after the other."""
    prepare_workers(encoded.sparkSession)
    vocabulary, pattern = vocabulary or vocabulary_path(), pattern or default_pattern()
    names, kinds = encoded.columns, ", ".join(f"`{n}` {t}" for n, t in encoded.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoding(vocabulary, pattern)
        for batch in batches:
            out = [bpe.decode_bytes(np.frombuffer(x, "<u4").tolist()) for x in column(batch, "ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*names, "bytes"])

    return encoded.mapInArrow(run, f"{kinds}, bytes binary")


def digests(encoded: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """encoded(doc_id, ids) -> doc_id, n_tokens, and the digests of the ids as text and of the decoded bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many, told = [], []
            for x in column(batch, "ids").to_pylist():
                ids = np.frombuffer(x, "<u4").tolist()
                many.append(len(ids))
                told.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
            back = [hashlib.sha256(x).hexdigest() for x in column(batch, "bytes").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(many, pa.int64()), pa.array(told), pa.array(back)],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return decode(encoded, vocabulary, pattern).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode(read_table(spark, sf_dir, "documents")))
