"""Suffix-array dedup: bytes covered by a ``SPAN``-byte string that also starts in a document
with a smaller doc_id are removed.

Only some suffixes are sorted. Each window of ``SPAN`` bytes selects one of its ``SEED``-byte
strings, the one of the least hash, and so does every copy of the window; the selected places
are the anchors (about one in 17 bytes). A repeated window thus has an anchor with an equal
beginning in another document.

1. Shards: documents are packed into shards of a few MB, written once to the shared folder.
2. Seeds: shards send the hashes of their anchors' seeds, sorted; seeds of one document only
   drop out. What comes back is a byte a seed.
3. Runs: a shard's other anchors are reduced to distinct contexts -- the suffix's first
   ``SPAN`` bytes and the ``SPAN - SEED`` bytes before -- with the least doc_id. Sorted, they
   are a run, sent front-coded: the common prefix with the entry before, then the rest.
4. Merge: the runs of a range of seeds meet in one task, and a loser tree merges them. Entries
   carry the length of the prefix they share with the last output; only where two are equal
   are bytes compared, and from there on. The merged order comes with its common-prefix
   lengths, so for every place ``o`` of the anchor in a window, suffixes with equal windows to
   the right are neighbours, and with equal ``o`` bytes to the left they hold the same string.
   The least doc_id of each decides; a shard gets a bit for each context and place.
5. Hot seeds, in more than ``HOT`` documents, would make one group too large. Their windows are
   grouped by hash instead, combined in the shard before the shuffle.
6. Shards turn bits into spans of bytes and merge these.

Contexts are compared byte by byte to the right and by 64-bit hashes to the left; hot windows
by 64-bit hashes. Defined cases: null text is empty; texts shorter than ``SPAN`` are whole; a
null doc_id sorts before all others; rows of equal doc_id don't remove each other's bytes;
other columns aren't read. Strings are judged on the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.llm.common import freeze, prepare_workers, read_table
from mercato.llm.textbytes import chunks, column, mix, rolling_hashes, span_hashes

SPAN = 50
SEED = 16
LEFT = SPAN - SEED
SHARD_BYTES = 2 << 20
#: text for each range of seeds: some 350,000 anchors
RANGE_BYTES = 6 << 20
HOT = 60_000
_NULL = np.iinfo(np.int64).min
_POSITION = np.uint64(0xFFFFFFFF)

_SHARDS = "shard long, size long, doc_ids binary, at binary, data binary"
_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<int>"


class Shard(NamedTuple):
    doc_ids: np.ndarray
    at: np.ndarray       # bytes of row i: data[at[i]:at[i + 1]]
    data: np.ndarray


def shards(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    prepare_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, number = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId() << 32
        ids, ends, parts, size = [], [0], [], 0

        def flush() -> pa.RecordBatch:
            row = [number, size, np.concatenate(ids).tobytes(), np.array(ends, np.int64).tobytes(),
                   press.compress(np.concatenate(parts).tobytes())]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(
                row, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)],
                names=["shard", "size", "doc_ids", "at", "data"])

        for batch in batches:
            own = column(batch, "doc_id").fill_null(_NULL).to_numpy(zero_copy_only=False)
            for texts in chunks(column(batch, "text"), limit):
                ids.append(own[texts.first:texts.first + len(texts.at) - 1])
                parts.append(texts.data)
                ends += (texts.at[1:] + size).tolist()
                size += len(texts.data)
                if size >= limit:
                    yield flush()
                    ids, ends, parts, size, number = [], [0], [], 0, number + 1
        if ids:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SHARDS)


def _unpack(row: dict) -> Shard:
    return Shard(np.frombuffer(row["doc_ids"], np.int64), np.frombuffer(row["at"], np.int64),
                 np.frombuffer(zstandard.ZstdDecompressor().decompress(row["data"]), np.uint8))


class Anchors(NamedTuple):
    at: np.ndarray       # place in the shard
    seed: np.ndarray     # hash of the SEED bytes
    first: np.ndarray    # windows that selected it: starts first..last
    last: np.ndarray
    row: np.ndarray


def anchors(shard: Shard) -> Anchors:
    data, at = shard.data, shard.at
    none = np.zeros(0, np.int64)
    if len(data) < SPAN:
        return Anchors(none, none.view(np.uint64), none, none, none)
    seed = rolling_hashes(data, SEED)
    least = seed & ~_POSITION
    least |= _POSITION - np.arange(len(seed), dtype=np.uint64)           # equal hashes: the last
    width, have = LEFT + 1, 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:], out=least[:-have])
        have *= 2
    if have < width:
        least = np.minimum(least[:have - width], least[width - have:], out=least[:have - width])
    inside = np.zeros(len(least), bool)                                  # windows within a document
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        inside[a:max(a, b - SPAN + 1)] = True
    start = np.flatnonzero(inside)
    if not len(start):
        return Anchors(none, none.view(np.uint64), none, none, none)
    chosen = (_POSITION - (least[start] & _POSITION)).astype(np.int64)
    new = np.flatnonzero(np.diff(chosen, prepend=-1))
    end = np.append(new[1:], len(chosen)) - 1
    own = chosen[new]
    return Anchors(own, seed[own], start[new], start[end], np.searchsorted(at, own, side="right") - 1)


class Seeds(NamedTuple):
    seed: np.ndarray     # distinct, ordered by range, then entry
    range: np.ndarray
    entry: np.ndarray
    of: np.ndarray       # place of each anchor's seed


def seeds(found: Anchors, ranges: int) -> Seeds:
    seed, of = np.unique(found.seed, return_inverse=True)
    part = (seed % np.uint64(ranges)).astype(np.int64)
    entry = (seed // np.uint64(ranges)) & np.uint64((1 << 40) - 1)
    order = np.lexsort((entry, part))
    where = np.empty(len(order), np.int64)
    where[order] = np.arange(len(order))
    return Seeds(seed[order], part[order], entry[order], where[of] if len(of) else of)


def _by_range(part: np.ndarray) -> Iterator[tuple[int, slice]]:
    edge = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        yield int(part[a]), slice(a, b)


def _send_seeds(table: DataFrame, ranges: int) -> DataFrame:
    """(range, shard, entries of 5 bytes, documents a seed as a byte)"""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = anchors(_unpack(row))
                own = seeds(found, ranges)
                pairs = np.unique(own.of * (1 << 32) + found.row)
                docs = np.minimum(255, np.bincount(pairs >> 32, minlength=len(own.seed))).astype(np.uint8)
                entry = own.entry.view(np.uint8).reshape(-1, 8)[:, :5]
                out = [(r, row["shard"], entry[s].tobytes(), docs[s].tobytes()) for r, s in _by_range(own.range)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (
                        pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["range", "shard", "entries", "docs"])

    return table.select("shard", "doc_ids", "at", "data").mapInArrow(run, "range int, shard long, entries binary, docs binary")


def _repeated(sent: DataFrame, hot: int) -> DataFrame:
    """(shard, kind 0, range, blob): for each seed sent 0, 1 (in several documents) or 2 (hot)."""
    def run(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, 5) for x in table.column("entries")]
        docs = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("docs")])
        wide = np.zeros((len(docs), 8), np.uint8)
        wide[:, :5] = np.concatenate(parts)
        _, of = np.unique(wide.view(np.uint64).ravel(), return_inverse=True)
        total = np.bincount(of, weights=docs)
        flag = np.where(total > hot, 2, np.where(total > 1, 1, 0)).astype(np.uint8)[of]
        ends = np.cumsum([len(p) for p in parts])
        blobs = [flag[e - len(p):e].tobytes() for e, p in zip(ends.tolist(), parts, strict=True)]
        n = len(parts)
        return pa.table({"shard": table.column("shard"), "kind": pa.array([0] * n, pa.int32()),
                         "range": table.column("range"), "blob": pa.array(blobs, pa.binary())})

    return sent.groupBy("range").applyInArrow(run, "shard long, kind int, range int, blob binary")


class Contexts(NamedTuple):
    """Distinct contexts of a shard's repeated, not hot anchors, ordered by range, suffix, left side."""
    range: np.ndarray
    right: np.ndarray    # SPAN bytes from the anchor on, zeros behind a document's end
    left: np.ndarray     # LEFT bytes before it, last first
    sizes: np.ndarray    # true lengths of right and left
    least: np.ndarray    # least doc_id
    of: np.ndarray       # place of each anchor's context
    anchor: np.ndarray   # these anchors


def contexts(shard: Shard, found: Anchors, own: Seeds, flags: np.ndarray) -> Contexts:
    pick = np.flatnonzero(flags[own.of] == 1)
    at, row = found.at[pick], found.row[pick]
    padded = np.concatenate([np.zeros(LEFT, np.uint8), shard.data, np.zeros(SPAN, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, LEFT + SPAN)[at]
    record = np.empty((len(pick), 4 + SPAN + LEFT + 2), np.uint8)
    record[:, :4] = own.range[own.of[pick]].astype(">u4").view(np.uint8).reshape(-1, 4)
    record[:, 4:4 + SPAN] = view[:, LEFT:]
    record[:, 4 + SPAN:-2] = view[:, LEFT - 1::-1] if LEFT else 0
    right = np.minimum(SPAN, shard.at[row + 1] - at)
    left = np.minimum(LEFT, at - shard.at[row])
    for k in np.flatnonzero(right < SPAN):
        record[k, 4 + right[k]:4 + SPAN] = 0
    for k in np.flatnonzero(left < LEFT):
        record[k, 4 + SPAN + left[k]:-2] = 0
    record[:, -2], record[:, -1] = right, left
    distinct, first, of = np.unique(record.view(f"V{record.shape[1]}").ravel(), return_index=True, return_inverse=True)
    kept = record[first]
    least = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(least, of, shard.doc_ids[row])
    return Contexts(kept[:, :4].copy().view(">u4").ravel().astype(np.int64), kept[:, 4:4 + SPAN], kept[:, 4 + SPAN:-2],
                    kept[:, -2:], least, of, pick)


def front_code(right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the prefixes shared with the row before, and the bytes after them."""
    shared = np.zeros(len(right), np.uint8)
    same = right[1:] == right[:-1]
    shared[1:] = np.where(same.all(axis=1), right.shape[1], same.argmin(axis=1))
    return shared, right[np.arange(right.shape[1])[None, :] >= shared[:, None]]


def front_decode(shared: np.ndarray, rest: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(shared), width), np.uint8)
    fresh = np.arange(width)[None, :] >= shared[:, None]
    out[fresh] = rest
    source = np.maximum.accumulate(np.where(fresh, np.arange(len(shared))[:, None], 0), axis=0)
    return np.take_along_axis(out, source, axis=0)


def loser_tree(runs: list[tuple[list[int], list[int]]], width: int = SPAN) -> tuple[list[int], list[int]]:
    """Merge sorted runs of (keys as big-endian numbers of ``width`` bytes, shared prefix with the
    entry before in the run) -> for each output the run it came from, and the length of the
    prefix it shares with the output before.

    Every waiting entry knows its shared prefix with the last output. The longer one is the
    smaller entry, unseen; only equal lengths need a look at what follows."""
    k = 1
    while k < len(runs):
        k *= 2
    bits = 8 * width
    total = sum(len(keys) for keys, _ in runs)
    keys, know, following = [None] * k, [-1] * k, [1] * k     # known prefix -1: the run is over
    for i, (own, _) in enumerate(runs):
        if own:
            keys[i], know[i] = own[0], 0
    lost = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        x, y = know[a], know[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        if x < 0:
            return a, b
        difference = keys[a] ^ keys[b]
        if not difference:
            know[b] = width
            return a, b
        prefix = (bits - difference.bit_length()) >> 3
        if keys[a] < keys[b]:
            know[b] = prefix
            return a, b
        know[a] = prefix
        return b, a

    level = list(range(k))
    width_of = k
    while width_of > 1:
        half = width_of // 2
        winners = []
        for j in range(half):
            win, lose = play(level[2 * j], level[2 * j + 1])
            lost[half + j] = lose
            winners.append(win)
        level, width_of = winners, half
    win = level[0]
    order, shared = [0] * total, [0] * total
    for n in range(total):
        order[n], shared[n] = win, know[win]
        own, own_shared = runs[win]
        place = following[win]
        if place < len(own):
            keys[win], know[win], following[win] = own[place], own_shared[place], place + 1
        else:
            know[win] = -1
        node = (win + k) >> 1
        while node:
            other = lost[node]
            x, y = know[win], know[other]
            if x < y:
                lost[node], win = win, other
            elif x == y and x >= 0:
                difference = keys[win] ^ keys[other]
                if not difference:
                    know[other] = width
                else:
                    prefix = (bits - difference.bit_length()) >> 3
                    if keys[win] < keys[other]:
                        know[other] = prefix
                    else:
                        know[win] = prefix
                        lost[node], win = win, other
            node >>= 1
    return order, shared


def repeated_windows(shared: np.ndarray, left: np.ndarray, sizes: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Of contexts in the order of their suffixes: bit o is set if the window that begins o bytes
    before the anchor also starts in a document with a smaller doc_id."""
    bits = np.zeros(len(least), np.uint64)
    hashed = np.zeros(len(least), np.uint64)          # of the o bytes before the anchor
    for o in range(LEFT + 1):
        if o:
            hashed = mix(hashed * np.uint64(0x9E3779B97F4A7C15) + left[:, o - 1].astype(np.uint64) + np.uint64(1))
        there = np.flatnonzero((sizes[:, 1] >= o) & (sizes[:, 0] >= SPAN - o))
        if len(there) < 2:
            continue
        group = np.cumsum(shared < SPAN - o).astype(np.uint64)
        key = mix(hashed[there] + group[there] * np.uint64(0xD6E8FEB86659FD93))
        order = np.argsort(key, kind="stable")
        edge = np.flatnonzero(np.diff(key[order], prepend=~key[order[:1]]))
        low = np.minimum.reduceat(least[there][order], edge)
        low = np.repeat(low, np.diff(np.append(edge, len(order))))
        hit = there[order[low < least[there][order]]]
        bits[hit] |= np.uint64(1) << np.uint64(o)
    return bits


def _flags(row: dict) -> np.ndarray:
    blobs = sorted((b["range"], b["blob"]) for b in row["back"] if b["kind"] == 0)
    return np.concatenate([np.frombuffer(b, np.uint8) for _, b in blobs]) if blobs else np.zeros(0, np.uint8)


def _send_runs(table: DataFrame, ranges: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for row in batch.to_pylist():
                shard = _unpack(row)
                found = anchors(shard)
                ctx = contexts(shard, found, seeds(found, ranges), _flags(row))
                out = []
                for r, s in _by_range(ctx.range):
                    shared, rest = front_code(ctx.right[s])
                    out.append((r, row["shard"], s.stop - s.start, press.compress(
                        shared.tobytes() + ctx.sizes[s].tobytes() + ctx.left[s].tobytes() + rest.tobytes()), press.compress(ctx.least[s].tobytes())))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (
                        pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)],
                        names=["range", "shard", "n", "run", "least"])

    return table.mapInArrow(run, "range int, shard long, n long, run binary, least binary")


def _merge(sent: DataFrame) -> DataFrame:
    """(shard, kind 1, range, blob): of each run the contexts with a repeated window, and its bits."""
    def run(table: pa.Table) -> pa.Table:
        press = zstandard.ZstdDecompressor()
        rights, lefts, sizes, least, runs = [], [], [], [], []
        for row in table.select(["n", "run", "least"]).to_pylist():
            n, raw = row["n"], np.frombuffer(press.decompress(row["run"]), np.uint8)
            shared, size, left, rest = np.split(raw, np.cumsum([n, 2 * n, LEFT * n]))
            right = front_decode(shared, rest, SPAN)
            keys = [int.from_bytes(right[k].tobytes(), "big") for k in range(n)]
            runs.append((keys, shared.tolist()))
            lefts.append(left.reshape(n, LEFT))
            sizes.append(size.reshape(n, 2))
            least.append(np.frombuffer(press.decompress(row["least"]), np.int64))
        order, shared = loser_tree(runs)
        many = np.array([len(x) for x in least])
        base = np.cumsum(many) - many
        order = np.array(order, np.int64)
        by_run = np.argsort(order, kind="stable")       # outputs of a run keep their order
        source = np.empty(len(order), np.int64)
        source[by_run] = np.arange(len(order))          # concatenated place of each output
        bits = np.zeros(len(order), np.uint64)
        bits[source] = repeated_windows(np.array(shared), np.concatenate(lefts)[source],
                                        np.concatenate(sizes)[source], np.concatenate(least)[source])
        blobs = []
        for a, n in zip(base.tolist(), many.tolist(), strict=True):
            hit = np.flatnonzero(bits[a:a + n])
            blobs.append(hit.astype(np.int32).tobytes() + bits[a:a + n][hit].tobytes())
        return pa.table({"shard": table.column("shard"), "kind": pa.array([1] * len(blobs), pa.int32()),
                         "range": table.column("range"), "blob": pa.array(blobs, pa.binary())})

    return sent.groupBy("range").applyInArrow(run, "shard long, kind int, range int, blob binary")


def _hot_windows(shard: Shard, found: Anchors, own: Seeds, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, hash and row of the windows that selected a hot anchor."""
    pick = np.flatnonzero(flags[own.of] == 2)
    many = found.last[pick] - found.first[pick] + 1
    start = np.repeat(found.first[pick] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    return start, span_hashes(shard.data, start, start + SPAN), np.repeat(found.row[pick], many)


def _hot(table: DataFrame, ranges: int) -> DataFrame:
    """(shard, kind 2, range 0, blob): hashes of hot windows that start in an earlier document than
    the first of the shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = _unpack(row)
                found = anchors(shard)
                _, window, of = _hot_windows(shard, found, seeds(found, ranges), _flags(row))
                distinct, inverse = np.unique(window, return_inverse=True)
                least = np.full(len(distinct), np.iinfo(np.int64).max)
                np.minimum.at(least, inverse, shard.doc_ids[of])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(distinct), row["shard"])), pa.array(distinct.view(np.int64)),
                                                  pa.array(least)], names=["shard", "window", "least"])

    sent = table.mapInArrow(run, "shard long, window long, least long")
    first = sent.groupBy("window").agg(F.min("least").alias("first"), F.max("least").alias("last")).where("first < last").select("window", "first")
    late = sent.join(first, "window").where("least > first")
    return late.groupBy("shard").agg(F.collect_list("window").alias("windows")).select(
        "shard", F.lit(2).alias("kind"), F.lit(0).alias("range"), F.array_join(F.transform(
            F.array_sort("windows"), lambda w: F.lpad(F.hex(w), 16, "0")), "").cast("binary").alias("blob"))


def spans(shard: Shard, ranges: int, row: dict) -> np.ndarray:
    """Which bytes of the shard go."""
    found = anchors(shard)
    own = seeds(found, ranges)
    flags = _flags(row)
    cover = np.zeros(len(shard.data) + 1, np.int64)
    ctx = contexts(shard, found, own, flags)
    bits = np.zeros(len(ctx.least), np.uint64)
    base = dict(_by_range(ctx.range))
    for back in row["back"]:
        if back["kind"] == 1 and back["blob"]:
            n = len(back["blob"]) // 12
            bits[base[back["range"]].start + np.frombuffer(back["blob"][:4 * n], np.int32)] = np.frombuffer(back["blob"][4 * n:], np.uint64)
    at, of = found.at[ctx.anchor], found.row[ctx.anchor]
    start, end = shard.at[of], shard.at[of + 1]
    # a context seen in an earlier document of the shard: all its windows are repeated
    late = shard.doc_ids[of] > ctx.least[ctx.of]
    low, high = np.maximum(start, at - LEFT)[late], np.minimum(at, end - SPAN)[late]
    ok = high >= low
    np.add.at(cover, low[ok], 1)
    np.add.at(cover, high[ok] + SPAN, -1)
    mask = bits[ctx.of]
    for o in range(LEFT + 1):
        hit = at[(mask >> np.uint64(o)) & np.uint64(1) == 1] - o
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + SPAN, -1)
    if (flags == 2).any():
        begin, window, rows = _hot_windows(shard, found, own, flags)
        distinct, inverse = np.unique(window, return_inverse=True)
        least = np.full(len(distinct), np.iinfo(np.int64).max)
        np.minimum.at(least, inverse, shard.doc_ids[rows])
        told = [b["blob"] for b in row["back"] if b["kind"] == 2]
        earlier = np.isin(distinct, np.frombuffer(bytes.fromhex(told[0].decode()), ">u8").astype(np.uint64) if told else [])
        hit = begin[earlier[inverse] | (shard.doc_ids[rows] > least[inverse])]
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + SPAN, -1)
    return np.cumsum(cover[:-1]) > 0


def _finish(table: DataFrame, ranges: int) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                        ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = _unpack(row)
                gone = spans(shard, ranges, row)
                out = []
                for doc_id, a, b in zip(shard.doc_ids.tolist(), shard.at[:-1].tolist(), shard.at[1:].tolist(), strict=True):
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone[a:b].view(np.int8), [0]])))
                    kept = shard.data[a:b][~gone[a:b]].tobytes()
                    out.append((None if doc_id == _NULL else doc_id, b - a, b - a - len(kept), len(edge) // 2,
                                hashlib.sha256(kept).hexdigest(), edge.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema, strict=True)], schema=schema)

    return table.mapInArrow(run, _RESULT)


def dedup(docs: DataFrame, shard_bytes: int = SHARD_BYTES, range_bytes: int = RANGE_BYTES, hot: int = HOT) -> DataFrame:
    """docs(doc_id, text) -> _RESULT; spans: from, to, from, to ... of the removed bytes."""
    spark = docs.sparkSession
    table = freeze(shards(docs, shard_bytes))
    total = table.agg(F.sum("size")).first()[0] or 0
    ranges = int(total // range_bytes) + 1
    flags = freeze(_repeated(_send_seeds(table, ranges), hot))
    is_hot = F.instr(F.hex("blob"), "02") > 0
    gather = lambda back: back.groupBy("shard").agg(F.collect_list(F.struct("kind", "range", "blob")).alias("back"))
    known = lambda back: table.join(gather(back).withColumnRenamed("shard", "to"), F.col("shard") == F.col("to"), "left").select(
        "shard", "doc_ids", "at", "data", F.coalesce("back", F.array().cast("array<struct<kind:int,range:int,blob:binary>>")).alias("back"))
    back = flags.unionByName(_merge(_send_runs(known(flags), ranges)))
    if not flags.where(is_hot).isEmpty():
        back = back.unionByName(_hot(known(flags), ranges))
    return _finish(known(freeze(back)), ranges)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(read_table(spark, sf_dir, "documents")).drop("spans")
