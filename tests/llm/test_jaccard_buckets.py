"""The Jaccard join's buckets: links past a batch's first one, chains of candidates that don't link, other layouts."""

from __future__ import annotations

import random

import corpus_helpers as H
import pytest
from mercato.llm import jaccard
from mercato.llm.common import freeze
from mercato.llm.graph import components
from pyspark.sql import functions as F
from test_text_operators import brute_components, rows_of


def drifting(seed: int, groups: int = 12, steps: int = 7, words: int = 60):
    """Texts that drift away from the first of their group: each links with the next, few with the first."""
    rng, rows = random.Random(seed), []
    for g in range(groups):
        w = [f"w{g}_{k}" for k in range(words)]
        for _ in range(steps):
            rows.append(" ".join(w))
            k = rng.randrange(words - 1)
            w[k:k + 1] = [f"z{rng.randrange(10 ** 9)}"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("parts, tile", [(1, jaccard.TILE), (3, 120), (9, 120)])
def test_links_past_the_first_of_a_batch(spark, parts, tile):
    rows = drifting(parts)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows_of(jaccard.join(docs, tile=tile)))
    assert got == sorted(brute_components(rows).elements())


def test_candidates_that_do_not_link_are_not_closed(spark):
    """Texts in a row, each sharing a third of its words with the next: candidates of each other at most, no
    link, and no tile that holds more than one bucket's classes."""
    words = [f"v{k}" for k in range(40 * 40 + 80)]
    rows = [(k, " ".join(words[40 * k:40 * k + 60])) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r["component_id"] for r in rows_of(jaccard.join(docs, 3, 60))} == set(range(40))
    plain = docs.select("doc_id", F.xxhash64("text").alias("body"), "text")
    full = freeze(jaccard.describe(plain, 3, 60)).where("n > 0")
    rows_sent = full.select(F.col("set_id").alias("a"), "n", F.explode("sent").alias("sign"))
    buckets = rows_sent.groupBy("sign").agg(F.count("*").alias("k"))
    most = buckets.agg(F.max("k")).first()[0]
    classes = full.groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"))
    none = components(spark.createDataFrame([], "a long, b long"))
    opened = jaccard._opened(full, rows_sent.select("sign", "a"), classes, none)
    tiles = jaccard._outside_tiles(opened, 60, jaccard.TILE).groupBy("tile").agg(F.count_distinct("set_id").alias("k"))
    assert (tiles.agg(F.max("k")).first()[0] or 0) <= most


def test_a_group_of_near_copies_sends_a_row_a_batch(spark):
    rng = random.Random(4)
    base = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(200):
        w = list(base)
        w[rng.randrange(300)] = f"x{k}"
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    full = jaccard.describe(docs.select("doc_id", F.xxhash64("text").alias("body"), "text"))
    per = full.select(F.explode("sent").alias("sign"), "set_id").groupBy("sign").agg(F.count("*").alias("k"))
    assert per.agg(F.max("k")).first()[0] <= 4
    assert {r["component_id"] for r in rows_of(jaccard.join(docs))} == {0}
    assert {r["component_id"] for r in rows_of(jaccard.join(H.documents(spark, [(None, "a b c d"), (7, "a b c d"), (3, None)])))} == {7, 3}
