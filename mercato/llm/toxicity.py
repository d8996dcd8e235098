"""Toxicity: a convolutional text classifier, trained in numpy.

A word's embedding is the sum of rows of a hashed table: one for the word, one for its first
bytes of each of ``STEM_BYTES``, so that forms of a stem share what was learned. Filters of several
widths slide over the words; each takes its maximum over the whole text, and a logistic
layer weighs the maxima. As filters are linear before the maximum, prediction looks up
each word's share in every filter position in a table made once from the model
(``BUCKETS`` x 6 filters' rows) and adds neighbours: no cut-off of long texts.

Learning: all distinct texts of each label in the learning fold (of equal ones that of the least
doc_id), whole, by iterative parameter mixing: ``rows`` texts a learner, at most ``LEARNERS``,
each a task that reads its share of the rows and makes steps of AdaGrad from the same model. After a
round the learners' changes are averaged, a number's weight being the squares of its gradients, so a
word that one learner met keeps what it learned. The first rounds are short, that the learners stay
together; a round reads other rows than the one before, all rounds read all. Few rows are read
repeatedly, until a learner has made ``steps``. Rows of a label weigh less the more it has.
A fifth of the texts, by hash, sets a threshold a language instead: the one of the highest F1, from
the counts of all its texts by logit (in ``GRID`` parts of a unit); where a label has no text in that
fifth or in the rest, all texts do both. The language is the one that a text's letters tell
(``language_id``, from the letter trigrams of all these texts); the column lang is read for
learning only. A language with fewer than ``LEAST`` rows of a label in that fifth takes the common threshold.

Defined cases: empty or null text scores as the logistic layer's value without words;
labels that are null or whose doc_id is null don't count, of several for a document the
largest; no labels, or one kind only, give the constant score 0.0 or 1.0. Repeated rows
are scored each by itself. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.llm import language_id
from mercato.llm.common import free_names, freeze, give_back_memory, held_out, prepare_workers, read_table
from mercato.llm.textbytes import ALNUM, Texts, chunks, column, span_hashes, word_hashes, LOWER
from mercato.session import scratch_path

BUCKETS = 1 << 15
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8          # of each width
STEM_BYTES = (4, 5)
#: a learner's texts, and those it works on at once: so many, of so many characters
BLOCK_ROWS = 8192
BLOCK_CHARS = 16 << 20
LEARNERS = 64
#: of 16 shares of the rows, those of each round
ROUNDS = ((0, 1), (1, 2), (2, 4), (4, 8), (8, 16))
PARTS = 16           # of the model, averaged apart
STEPS = 900          # of a learner, at least
BATCH = 32
PIECE = 1 << 14      # words of a text looked at at once while learning
GRID = 256
FAR = 64.0           # logits beyond count as this
LEAST = 15
#: text scored at once: a word takes some 500 bytes meanwhile
SCORE_BYTES = 1 << 20
SEED = 20


class Model(NamedTuple):
    shares: np.ndarray | None     # BUCKETS x (sum of widths * FILTERS): a word's part in each filter position
    floor: np.ndarray             # bias of each filter
    weight: np.ndarray            # of the maxima
    bias: float
    cut: dict[str, float]         # threshold of the logit by language, "" for the others
    languages: language_id.Model
    constant: float = 0.0


def word_buckets(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word and its stems (a column each), and the rows' places among the words."""
    found, hashes = word_hashes(texts, ALNUM)
    lowered, mask, out = LOWER[texts.data], np.uint64(BUCKETS - 1), [hashes]
    for k, size in enumerate(STEM_BYTES, 1):
        out.append(span_hashes(lowered, found.start, np.minimum(found.end, found.start + size)) >> np.uint64(16 * k))
    return np.stack([(h & mask).astype(np.int32) for h in out], axis=1), found.row_at


def _maxima(shares: list[np.ndarray], at: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """shares: of each width, (words, width, FILTERS). -> the filters' maxima for each row;
    words beyond a row's end add nothing (a text shorter than the filter is padded)."""
    rows = len(at) - 1
    out, sums = [], []
    ends = np.repeat(at[1:], np.diff(at))
    place = np.arange(len(ends))
    for part in shares:
        total = part[:, 0].copy()
        for k in range(1, part.shape[1]):
            ok = place[:-k] + k < ends[:-k] if len(place) > k else np.zeros(0, bool)
            total[:len(ok)] += part[k:, k] * ok[:, None] if len(ok) else 0
        top = np.zeros((rows, part.shape[2]), np.float32)
        full = np.flatnonzero(np.diff(at))
        if len(full):
            top[full] = np.maximum.reduceat(total, at[:-1][full], axis=0)
        out.append(top)
        sums.append(total)
    return np.concatenate(out, axis=1), sums


def _parts(table: np.ndarray) -> list[np.ndarray]:
    out, k = [], 0
    for w in WIDTHS:
        out.append(table[:, k:k + w * FILTERS].reshape(len(table), w, FILTERS))
        k += w * FILTERS
    return out


def logits(texts: Texts, model: Model) -> np.ndarray:
    buckets, at = word_buckets(texts)
    table = model.shares[buckets[:, 0]]
    for k in range(1, buckets.shape[1]):
        table += model.shares[buckets[:, k]]
    top, _ = _maxima(_parts(table), at)
    return np.maximum(0, top + model.floor) @ model.weight + model.bias


N_FILTERS = len(WIDTHS) * FILTERS
_WIDTH = np.repeat(WIDTHS, FILTERS)
_KERNELS = N_FILTERS * max(WIDTHS) * DIM


class _State:
    """What is learned, and of each number the sum of its squared gradients, as two flat arrays."""

    def __init__(self, value: np.ndarray, seen: np.ndarray):
        self.value, self.seen = value.copy(), seen.copy()
        a, b = BUCKETS * DIM, BUCKETS * DIM + _KERNELS
        self.embed, self.embed_seen = self.value[:a].reshape(BUCKETS, DIM), self.seen[:a].reshape(BUCKETS, DIM)
        self.rest, self.rest_seen = self.value[a:], self.seen[a:]
        self.kernels = self.value[a:b].reshape(N_FILTERS, max(WIDTHS), DIM)      # 0 beyond a filter's width
        self.floor, self.weight, self.bias = np.split(self.value[b:], [N_FILTERS, 2 * N_FILTERS])


def _start() -> _State:
    rng = np.random.default_rng(SEED)
    kernels = rng.normal(0, 1, (N_FILTERS, max(WIDTHS), DIM)) * (_WIDTH * DIM)[:, None, None] ** -0.5
    kernels *= (np.arange(max(WIDTHS)) < _WIDTH[:, None])[:, :, None]
    value = np.concatenate([rng.normal(0, 0.1, BUCKETS * DIM), kernels.ravel(), np.zeros(N_FILTERS),
                            rng.normal(0.2, 0.3, N_FILTERS), np.zeros(1)]).astype(np.float32)
    return _State(value, np.full_like(value, 1e-6))


def _peaks(doc: np.ndarray, s: _State) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc: a text's buckets, a row a word -> of each filter its maximum, the buckets of the words
    it lies on, and which of these are words of the text and in the filter's width."""
    most = max(WIDTHS)
    if not len(doc):
        return np.zeros(N_FILTERS, np.float32), np.zeros((N_FILTERS, most, doc.shape[1]), doc.dtype), np.zeros((N_FILTERS, most), bool)
    top, at, flat = np.full(N_FILTERS, -np.inf, np.float32), np.zeros(N_FILTERS, np.int64), s.kernels.reshape(-1, DIM)
    for first in range(0, len(doc), PIECE):
        part = doc[first:first + PIECE + most - 1]
        x = s.embed[part[:, 0]]
        for k in range(1, part.shape[1]):
            x += s.embed[part[:, k]]
        shares = (flat @ x.T).reshape(N_FILTERS, most, len(part))
        total = shares[:, 0]
        for j in range(1, most):
            total[:, :-j] += shares[:, j, j:]
        best = total[:, :PIECE].argmax(axis=1)
        peak = total[np.arange(N_FILTERS), best]
        better = peak > top
        top[better], at[better] = peak[better], first + best[better]
    place = at[:, None] + np.arange(most)
    return top, doc[np.minimum(place, len(doc) - 1)], (place < len(doc)) & (np.arange(most) < _WIDTH[:, None])


def _step(s: _State, docs: list[np.ndarray], y: np.ndarray, share: np.ndarray) -> None:
    """One step of AdaGrad; ``share``: how much a row of each label weighs."""
    top, spots, inside = (np.stack(part) for part in zip(*[_peaks(d, s) for d in docs], strict=True))
    on = np.maximum(0, top + s.floor)
    logit = on @ s.weight + s.bias[0]
    error = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) * share[y] / BATCH).astype(np.float32)
    d_top = np.outer(error, s.weight) * (on > 0)
    x = s.embed[spots].sum(axis=3) * inside[..., None]
    live = inside & (d_top != 0)[:, :, None]
    rows, grad = spots[live], (d_top[:, :, None, None] * s.kernels)[live]
    rest = np.concatenate([np.einsum("rf,rfjd->fjd", d_top, x).ravel(), d_top.sum(axis=0), on.T @ error,
                           error.sum(keepdims=True)])
    if len(rows):
        flat = rows.ravel()
        order = np.argsort(flat, kind="stable")
        touched, first = np.unique(flat[order], return_index=True)
        total = np.add.reduceat(grad[order // rows.shape[1]], first, axis=0)
        s.embed_seen[touched] += total * total
        s.embed[touched] -= 0.1 * total / np.sqrt(s.embed_seen[touched])
    s.rest_seen += rest * rest
    s.rest -= 0.02 * rest / np.sqrt(s.rest_seen)


def _learn(blocks: Iterator[tuple[list[np.ndarray], np.ndarray]], s: _State, passes: int, share: np.ndarray) -> None:
    rng = np.random.default_rng(SEED)
    for docs, y in blocks:
        for _ in range(passes):
            order = rng.permutation(len(docs))
            for k in range(0, len(order), BATCH):
                some = order[k:k + BATCH]
                _step(s, [docs[i] for i in some], y[some], share)


def _blocks(batches: Iterator[pa.RecordBatch], rows: int, chars: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """batches(text, label) -> buckets and labels of at most ``rows`` texts with ``chars`` bytes, or of one."""
    docs, y, size = [], [], 0
    for batch in batches:
        labels = column(batch, "label").to_pylist()
        for texts in chunks(column(batch, "text"), SCORE_BYTES):
            buckets, at = word_buckets(texts)
            for k in range(len(at) - 1):
                n = int(texts.at[k + 1] - texts.at[k])
                if docs and (len(docs) >= rows or size + n > chars):
                    yield docs, np.array(y)
                    docs, y, size = [], [], 0
                docs.append(buckets[at[k]:at[k + 1]].copy())
                y.append(int(labels[texts.first + k] == 1))
                size += n
    if docs:
        yield docs, np.array(y)


def _mixed(value: np.ndarray, seen: np.ndarray, values: np.ndarray, seens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The learners' changes (a row each) averaged, weighted by their squared gradients."""
    gain = seens - seen
    total = gain.sum(axis=0)
    safe = np.where(total > 0, total, 1)
    return (value + (gain * (values - value)).sum(axis=0) / safe).astype(np.float32), (
        seen + (gain * gain).sum(axis=0) / safe).astype(np.float32)


def _round(found: DataFrame, s: _State, passes: int, share: np.ndarray, rows: int, chars: int) -> _State:
    """found(text, label): a partition a learner -> the mixed state of all."""
    shared = found.sparkSession.sparkContext.broadcast((s.value, s.seen))
    edges = np.linspace(0, len(s.value), PARTS + 1).astype(int)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _State(*shared.value)
        _learn(_blocks(batches, rows, chars), own, passes, share)
        for k in range(PARTS):
            cut = slice(edges[k], edges[k + 1])
            yield pa.RecordBatch.from_pylist([{
                "part": k, "learner": TaskContext.get().partitionId(), "value": own.value[cut].tobytes(),
                "seen": own.seen[cut].tobytes()}], schema=PART)
        give_back_memory()

    def mix(table: pa.Table) -> pa.Table:
        table = table.sort_by("learner")
        k = table.column("part")[0].as_py()
        cut = slice(edges[k], edges[k + 1])
        value, seen = (a[cut] for a in shared.value)
        learned = [np.stack([np.frombuffer(b.as_py(), np.float32) for b in table.column(c)]) for c in ("value", "seen")]
        value, seen = _mixed(value, seen, *learned)
        return pa.Table.from_pylist([{"part": k, "learner": 0, "value": value.tobytes(), "seen": seen.tobytes()}], schema=PART)

    schema = "part int, learner int, value binary, seen binary"
    parts = sorted(found.select("text", "label").mapInArrow(run, schema).groupBy("part").applyInArrow(mix, schema).collect(),
                   key=lambda r: r["part"])      # the model: 2 x 1 MB
    shared.unpersist()
    return _State(*(np.concatenate([np.frombuffer(r[c], np.float32) for r in parts]) for c in ("value", "seen")))


PART = pa.schema([("part", pa.int32()), ("learner", pa.int32()), ("value", pa.binary()), ("seen", pa.binary())])


def _best_cut(bins: np.ndarray, n: np.ndarray, hits: np.ndarray) -> float:
    """The threshold of the highest F1, in the middle between the bins of logits around it; bins: their
    numbers, n: texts, hits: those of label 1."""
    order = np.argsort(-bins)
    bins, n, hits = bins[order], n[order].cumsum(), hits[order].cumsum()
    best = int((2 * hits / (n + hits[-1])).argmax())
    below = bins[best + 1] + 1 if best + 1 < len(bins) else bins[best] - 2 * GRID
    return float(bins[best] + below) / 2 / GRID


def _logit_counts(found: DataFrame, model: Model) -> list:
    """found(text, label) -> (lang, bin, n, hits) of each told language and bin of logits."""
    shared = found.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = np.array(column(batch, "label").to_pylist(), np.int64)
            for texts in chunks(column(batch, "text"), SCORE_BYTES):
                langs, _ = language_id.predict(texts, shared.value.languages)
                bins = np.floor(np.clip(logits(texts, shared.value), -FAR, FAR) * GRID).astype(np.int64)
                hit = (label[texts.first:texts.first + len(langs)] == 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(bins), pa.array(hit)], names=["lang", "bin", "hit"])
        give_back_memory()

    counts = (found.select("text", "label").mapInArrow(run, "lang string, bin long, hit long").groupBy("lang", "bin")
              .agg(F.count("*").alias("n"), F.sum("hit").alias("hits")).collect())    # at most 2 * FAR * GRID + 1 a language
    shared.unpersist()
    return counts


def _cuts(counts: list) -> dict[str, float]:
    """The common threshold as "", and those of the languages with ``LEAST`` rows of each label."""
    def cut(own: list) -> float:
        by: dict[int, np.ndarray] = {}
        for r in own:
            by[r["bin"]] = by.get(r["bin"], 0) + np.array([r["n"], r["hits"]])
        return _best_cut(np.array(list(by)), *np.array(list(by.values())).T)

    out = {"": cut(counts)}
    for lang in sorted({r["lang"] for r in counts}):
        own = [r for r in counts if r["lang"] == lang]
        hits = sum(r["hits"] for r in own)
        if min(hits, sum(r["n"] for r in own) - hits) >= LEAST:
            out[lang] = cut(own)
    return out


def scores(texts: Texts, model: Model) -> np.ndarray:
    if model.shares is None:
        return np.full(len(texts.at) - 1, model.constant)
    langs, _ = language_id.predict(texts, model.languages)
    shift = np.array([model.cut.get(lang, model.cut[""]) for lang in langs])
    return 1 / (1 + np.exp(-np.clip(logits(texts, model) - shift, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, rows: int = BLOCK_ROWS, chars: int = BLOCK_CHARS,
        steps: int = STEPS) -> Model:
    """docs(doc_id, text, lang), labels(doc_id, toxic): all rows given are learned from."""
    spark = docs.sparkSession
    prepare_workers(spark)
    kinds = (labels.where("doc_id is not null and toxic is not null").groupBy("doc_id")
             .agg(F.max("toxic").alias("label")))
    texts = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("h"), "text", "lang")
    chosen = freeze(texts.select("doc_id", "h").join(kinds, "doc_id").groupBy("label", "h").agg(F.min("doc_id").alias("doc_id")))
    spare = F.pmod("h", F.lit(5)) == 4
    counts = {(r["label"], r["spare"]): r["n"] for r in
              chosen.groupBy("label", spare.alias("spare")).agg(F.count("*").alias("n")).collect()}
    known = sorted({label for label, _ in counts})
    if len(known) < 2:
        return Model(None, np.zeros(0), np.zeros(0), 0.0, {}, language_id.from_counts({}), float(known[0]) if known else 0.0)
    path = scratch_path(spark, "labelled")
    texts.join(chosen, ["doc_id", "h"]).select("h", "label", "text", "lang").sortWithinPartitions("h", "label").write.parquet(path)
    found = spark.read.parquet(path)
    apart = all((label, part) in counts for label in known for part in (True, False))
    learned = {k: sum(n for (label, part), n in counts.items() if (label == 1) == bool(k) and not (apart and part)) for k in (0, 1)}
    n = sum(learned.values())
    share = np.array([n / (2 * max(1, learned[k])) for k in (0, 1)], np.float32)
    learners = min(LEARNERS, -(-n // rows), max(1, found.rdd.getNumPartitions()))
    passes = max(1, -(-steps * learners // -(-n // BATCH)))
    train = found.where(~spare) if apart else found
    state, turn = _start(), F.floor(F.pmod("h", F.lit(80)) / 5)
    for lo, hi in ROUNDS if learners > 1 else ((0, 16),):
        state = _round(train.where((turn >= lo) & (turn < hi)).coalesce(learners), state, passes, share, rows, chars)
    shares = np.concatenate([state.embed @ state.kernels[k * FILTERS:(k + 1) * FILTERS, j].T
                             for k, w in enumerate(WIDTHS) for j in range(w)], axis=1)
    model = Model(shares, state.floor, state.weight, float(state.bias[0]), {}, language_id.count(found))
    model = model._replace(cut=_cuts(_logit_counts(found.where(spare) if apart else found, model)))
    # the labelled texts are learned: an empty table takes their place, as the cleaner leaves written files
    spark.createDataFrame([], found.schema).write.mode("overwrite").parquet(path)
    give_back_memory()
    return model


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with the column ``name`` (with an underscore behind it if it is taken)."""
    name, = free_names(docs.columns, name)
    spark = docs.sparkSession
    prepare_workers(spark)
    shared = spark.sparkContext.broadcast(model)     # BUCKETS x 48 numbers and a language model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [scores(texts, shared.value) for texts in chunks(column(batch, "text"), SCORE_BYTES)]
            new = pa.array(np.concatenate(parts) if parts else [], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, new], names=[*batch.schema.names, name])
        give_back_memory()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def learning_fold(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out(F.col("doc_id")))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the documents scored ``threshold`` or more."""
    name, = free_names(docs.columns, "score")
    model = fit(learning_fold(docs), learning_fold(labels))
    return score(docs, model, name).where(F.col(name) < threshold).drop(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = fit(learning_fold(docs), learning_fold(labels))
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
