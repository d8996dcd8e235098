"""Numpy over the byte buffers of Arrow string columns: no Python string per word."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; a longer single document is taken alone.
CHUNK_BYTES = 3 << 20
_BASE = 0x9E3779B97F4A7C15          # odd, so it has an inverse mod 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)

#: A-Z to a-z, all other bytes as they are
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing; each byte of a
#: character beyond ASCII belongs to a word, so bytes give the same words as characters
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
#: bytes of words [^\x20\x09-\x0D]+
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[32] = False
NON_SPACE[9:14] = False


class Texts(NamedTuple):
    """Rows ``first``..``first + len(at) - 1`` of a batch; row i is data[at[i]:at[i + 1]]."""
    first: int
    data: np.ndarray
    at: np.ndarray


class Words(NamedTuple):
    start: np.ndarray   # first byte, in the chunk
    end: np.ndarray     # after the last byte
    row_at: np.ndarray  # words of row i are row_at[i]:row_at[i + 1]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Texts]:
    """The rows in pieces of at most ``limit`` bytes (or one row); null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    i, n = 0, len(texts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
        yield Texts(i, raw[at[i]:at[j]], at[i:j + 1] - at[i])
        i = j


def words(texts: Texts, kind: np.ndarray) -> Words:
    """Maximal runs of bytes of ``kind``; none crosses a row."""
    mask = kind[texts.data]
    n = len(mask)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(len(texts.at), np.int64))
    starts = mask.copy()
    starts[1:] &= ~mask[:-1]
    ends = mask.copy()
    ends[:-1] &= ~mask[1:]
    edge = texts.at[:-1][texts.at[:-1] < n]      # a row's first byte starts a word
    starts[edge] = mask[edge]
    edge = texts.at[1:][texts.at[1:] > 0] - 1
    ends[edge] = mask[edge]
    start = np.flatnonzero(starts)
    return Words(start, np.flatnonzero(ends) + 1, np.searchsorted(start, texts.at))


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    while len(_POWERS[0]) < n:
        m = len(_POWERS[0])
        for k, base in enumerate((_BASE, _INVERSE)):
            _POWERS[k] = np.concatenate([_POWERS[k], _POWERS[k] * np.uint64(pow(base, m, 1 << 64))])
    if len(_POWERS[0]) > 8 * CHUNK_BYTES and n <= 4 * CHUNK_BYTES:   # after one huge row
        _POWERS[:] = [p[:4 * CHUNK_BYTES] for p in _POWERS]
    return _POWERS


def rolling_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """``span_hashes`` of all spans of ``size`` bytes, in little memory."""
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.add(data, np.uint64(1), out=sums[1:])
    sums[1:] *= power[:len(data)]
    np.cumsum(sums, out=sums)
    out = sums[size:] - sums[:-size]
    del sums
    out *= inverse[:len(out)]
    out += np.uint64(size)
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        out ^= out >> np.uint64(33)
        out *= np.uint64(factor)
    out ^= out >> np.uint64(33)
    return out


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of ``data``, equal for equal bytes: differences of prefix
    sums of byte * base**position, moved to position 0 by the inverse power."""
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def word_hashes(texts: Texts, kind: np.ndarray) -> tuple[Words, np.ndarray]:
    found = words(texts, kind)
    return found, span_hashes(LOWER[texts.data], found.start, found.end)
