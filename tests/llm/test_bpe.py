"""Byte-level BPE against tiktoken on whole texts."""

from __future__ import annotations

import hashlib

import corpus_helpers as H
import numpy as np
import pytest
import regex
from mercato.llm import bpe

TEXTS = H.texts() + [
    "x" * 9_000, "ab " * 4_000, "日本語" * 3_000, "   \n\n" * 2_000, "1234567890" * 900, "it's we'll 're'd" * 700, "'s't" * 2_500,
    "a" + "\n" * 3_000 + "b" + " " * 3_000 + "c", " ".join(H.prose(k, 200) for k in range(9)), "\t \t" * 3_000, "é́" * 5_000,
    "<|endoftext|> " * 500, ("word " * 30 + "x" * 700 + "  \n ") * 20]


def plain(text):
    ids = bpe.encoding(bpe.vocabulary_path(), bpe.default_pattern()).encode_ordinary(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("chunk, overlap", [(bpe.CHUNK, bpe.OVERLAP), (300, 40), (64, 16)])
def test_ids_are_those_of_whole_texts(spark, chunk, overlap):
    rows = list(enumerate(TEXTS)) + [(None, H.prose(7, 900)), (None, "x"), (3, "y y y"), (3, "y y y")]
    docs = H.documents(spark, rows)
    out = bpe.digests(bpe.encode(docs, chunk=chunk, overlap=overlap))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    got = sorted((tuple(r) for r in out.collect()), key=str)
    assert got == sorted(((i, *plain(t)) for i, t in rows), key=str)


def test_the_given_file_is_read_as_the_library_reads_it(spark):
    """Each pre-token by itself gives the ids of the text."""
    enc, text = bpe.encoding(bpe.vocabulary_path(), bpe.default_pattern()), " ".join(t or "" for t in TEXTS)
    one = [i for m in regex.finditer(bpe.default_pattern(), text) for i in enc._encode_single_piece(m.group())]
    assert one == enc.encode_ordinary(text)


def test_decoding_keeps_columns_and_empty_tables(spark):
    enc = bpe.encode(H.documents(spark, [(1, "é a"), (2, None)]))
    back = {r["doc_id"]: bytes(r["bytes"]) for r in bpe.decode(enc).collect()}
    assert back == {1: "é a".encode(), 2: b""}
    none = bpe.encode(H.documents(spark, []).limit(0))
    assert none.count() == 0 and bpe.digests(none).count() == 0


def test_a_long_text_is_dealt_out(spark):
    """Chunks are rows of their own, none longer than a chunk and its overlap."""
    docs = H.documents(spark, [(1, H.prose(5, 60_000))])
    cut = bpe.read_chunks(docs, 1_000, 100)
    rows = cut.selectExpr("k", "length(text) n", "start").orderBy("k").collect()
    assert len(rows) > 200 and max(r["n"] for r in rows) <= 1_100 and [r["start"] for r in rows] == [1_000 * r["k"] for r in rows]
    assert np.diff([r["k"] for r in rows]).tolist() == [1] * (len(rows) - 1)
