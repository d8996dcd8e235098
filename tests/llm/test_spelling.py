"""Spelling variants against comparing all words in plain Python."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import corpus_helpers as H
import pytest
from mercato.llm import spelling

FIELDS = ["word", "form", "root", "n", "n_near", "form_n"]


def brute_words(rows, length=7, count=2):
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(H.DOWN)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= length and n >= count}


def apart(a, b):
    """Exactly one insertion, deletion or replacement."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute(words):
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and apart(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w] or "", root(w), n, len(near[w]), words[form[w]] if form[w] else -1) for w, n in words.items())


def collected(df):
    assert df.columns == FIELDS
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], -1 if r["form_n"] is None else r["form_n"]) for r in df.collect())


def edited(rng, w, letters):
    k, x = rng.randrange(len(w) + 1), rng.choice(letters)
    return rng.choice([w[:k] + x + w[k:], w[:k] + w[k + 1:], w[:k] + x + w[k + 1:]])


@pytest.mark.parametrize("letters, size", [("ab", 9), ("abcdéÿz", 8), ("a", 12)])
def test_words_near_each_other(spark, letters, size):
    rng = random.Random(len(letters))
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(7, size + 4))) for _ in range(150)}
    for w in list(words):
        for _ in range(2):
            words.add(edited(rng, w, letters))
    counted = {w: rng.choice([2, 3, 20, 25, 200, 250, 3000]) for w in words if len(w) >= 7}
    df = spark.createDataFrame(list(counted.items()), "word string, n long").repartition(3)
    assert collected(spelling.variants(df)) == brute(counted)


def test_edges_of_words_and_long_labels(spark):
    """Edits at both ends, doubled letters, prefixes of each other, long shared stretches."""
    p, q = "begin" * 8, "end" * 700
    words = ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "baaaaaaa", "aaaaaaab", "aaabaaa", "abababab", "babababa", "ababababa", "bababab",
             *[p + x + q + y for x in ("", "a", "b") for y in ("", "y", "z")], "x" * 3000, "x" * 2999, "x" * 1500 + "y" + "x" * 1499]
    counted = {w: 2 * 11 ** (k % 4) for k, w in enumerate(words)}
    assert collected(spelling.variants(spark.createDataFrame(list(counted.items()), "word string, n long"))) == brute(counted)


def test_whole_documents(spark):
    rng = random.Random(7)
    base = ["Straßenbahn", "straszenbahn", "général", "generals", "multiply×ing", "NAÏVETÉS", "internationally", "internationaly", "spelling"]
    rows = [(rng.choice([None, k, k]), " ".join(rng.choice(base) for _ in range(40)) + rng.choice([" x1y", "", "\n", "-"]) + "Großer" * 3) for k in range(60)]
    rows += [(1, None), (2, ""), (3, "short"), (4, "z" * 50_000), (4, "z" * 50_000), (5, "z" * 50_000), *[(k, t) for k, t in enumerate(H.texts())]]
    words = brute_words(rows)
    got = {r["word"]: r["n"] for r in spelling.counted_words(H.documents(spark, rows)).collect()}
    assert got == words
    # a letter taken out of some of the words of 31: variants of the whole ones
    assert any(n >= 10 * words.get(w, 10**9) for n in words.values() for w in words)
    assert collected(spelling.variants(spelling.counted_words(H.documents(spark, rows)))) == brute(words)


def test_edges_are_few_and_combined(spark):
    """A node has one row whatever the number of words through it."""
    words = spark.createDataFrame([(f"{'same' * 3}{chr(97 + k % 26)}{chr(97 + k // 26)}", 5) for k in range(26 * 26)], "word string, n long")
    table = spelling.edge_table(spelling.own_paths(words))
    rows = {r["node"]: len(r["edges"]) for r in table.collect()}
    assert max(rows.values()) == 26
    # leaves of both sides, the shared stretch and what follows it; reversed words part above their halves
    assert len(rows) == 2 * 26 * 26 + 1 + 26
    assert spelling.neighbours(words).count() == 26 * 26 * 50


def test_empty(spark):
    assert collected(spelling.variants(spelling.counted_words(H.documents(spark, []).limit(0)))) == []
    assert collected(spelling.variants(spark.createDataFrame([("onlyone", 2)], "word string, n long"))) == [("onlyone", "", "onlyone", 2, 0, -1)]
