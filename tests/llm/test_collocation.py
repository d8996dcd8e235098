"""Collocations against counting in plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import corpus_helpers as H
import duckdb
import pytest
from mercato.llm import collocation
from pyspark.sql import functions as F

FIELDS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, least=10, top=2000):
    count, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(H.DOWN)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    count[lang, *w[i:i + k]] += 1
    out = defaultdict(list)
    for (lang, *p), a in count.items():
        if len(p) < 2 or a < least:
            continue
        if len(p) == 2 and any(n >= least and len(q) == 3 and q_lang == lang and list(p) in (q[:2], q[1:]) and 100 * n >= 50 * a
                               for (q_lang, *q), n in count.items()):
            continue
        cuts = [(10**6 * a * a // (count[lang, *p[:k]] * count[lang, *p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(p).encode(), count[lang, *p[:k]], count[lang, *p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, total[lang], -s)
                  for lang, own in out.items() for i, (s, a, p, l, r) in enumerate(sorted(own)[:top]))


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["Über", "new", "york", "city", "of", "the", "a", "b", "naïve", "x\x0cy", "日本", "end.", "10,000", "is", " ", "it's", "ring"]
    passage = "one long passage that comes again and again without any mark in it for some twenty words or so"
    rows = []
    for i in range(60):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))]
        text = " ".join(w) + rng.choice(["", ". ", "\n", "\t"]) + passage * (i % 4 == 0) + " , " + "ha " * rng.choice([0, 1, 2, 40]) + "; uno dos tres" * (i % 3)
        rows.append((rng.choice(["en", "fr", None, "und"]), text))
    return rows + [("en", None), ("en", ""), ("de", "only one text"), (None, " ... "), ("fr", "YORK york " * 2000)]


def frame(spark, rows):
    data = [(k // 2 if k % 7 else None, t, lang, "s", 1, "w", 3) for k, (lang, t) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n long, phrase string, a int").repartition(3)


@pytest.mark.parametrize("seed", [1, 2])
def test_rows_are_those_of_plain_counting(spark, seed, monkeypatch):
    monkeypatch.setattr(collocation, "PATH_EDGES", 5)
    rows = corpus(seed)
    out = collocation.collocations(frame(spark, rows))
    assert out.columns == FIELDS
    assert sorted(tuple(r) for r in out.collect()) == brute(rows)


def test_only_the_first_rows_of_a_language(spark):
    rows = corpus(3)
    got = sorted(tuple(r) for r in collocation.collocations(frame(spark, rows), top=4).collect())
    assert got == brute(rows, top=4)


def test_sql_agrees(spark):
    rows = [(a, b.replace("\x0c", " ") if b else b) for a, b in corpus(4)]
    con = duckdb.connect()
    con.sql("create table documents (doc_id bigint, text varchar, lang varchar)")
    con.executemany("insert into documents values (?, ?, ?)", [(k, t, lang) for k, (lang, t) in enumerate(rows)])
    want = sorted(con.sql(collocation.SQL).select(*FIELDS).fetchall())
    assert want == brute(rows)


def test_flows_are_counts(spark):
    """Nodes and words of the graph occur as often as the texts say, and edges too."""
    rows = corpus(5)
    texts = frame(spark, rows).withColumn("lang", F.coalesce("lang", F.lit("und")))
    found = collocation.frequent(collocation.windows(texts), 1).collect()
    windows = collocation.windows(texts).collect()
    assert sum(r["n"] for r in found if r["b"] is None) == sum(r["n"] for r in windows)
    nodes = {(r["a"], r["b"]): r["n"] for r in found if r["b"] is not None and r["c"] is None}
    assert sum(nodes.values()) == sum(r["n"] for r in windows if r["b"])


def test_paths_cover_each_edge_once(spark):
    chain = [(k, k + 1, k + 2, 20) for k in range(1, 41)]                       # one path of 40
    ring = [(101, 102, 103, 11), (102, 103, 101, 11), (103, 101, 102, 11), (7_000, 7_000, 7_000, 12)]
    fork = [(201, 202, 203, 30), (202, 203, 204, 10), (202, 203, 205, 20)]
    edges = spark.createDataFrame(chain + ring + fork, "a long, b long, c long, n long")
    rows = collocation.compact(edges).collect()
    again = sorted((*r["hashes"][k:k + 3], w) for r in rows for k, w in enumerate(r["weights"]))
    assert again == sorted(chain + ring + fork)
    assert max(len(r["weights"]) for r in rows) == 40
    assert sorted(len(r["weights"]) for r in rows) == [1] * 7 + [40]
    best = {(r["a"], r["b"]): r["longer"] for r in collocation.heaviest(collocation.compact(edges)).collect()}
    assert best[202, 203] == 30 and best[203, 205] == 20 and best[5, 6] == 20 and best[7_000, 7_000] == 12


def test_empty_and_rare(spark):
    none = frame(spark, [("en", "a b c")]).limit(0)
    assert collocation.collocations(none).collect() == []
    assert collocation.collocations(frame(spark, [("en", "a b c. d e"), (None, None)])).collect() == []
