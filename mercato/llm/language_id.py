"""Language identification by hierarchical discrimination.

A text's features are the frequencies of its hashed letter trigrams (bytes; digits and
punctuation count as spaces). One linear support vector machine a family, one against
the rest, picks the language family; within it one machine a pair of languages votes,
margins breaking ties. Machines are linear in the frequencies, so predicting is one
table look-up and sum a byte, a batch at a time, with a broadcast model of
``BUCKETS`` x (number of machines) weights.

Learning reads text and non-null lang of the rows of the learning fold, and of those a
bounded sample: ``ROWS_PER_LANG`` distinct texts a language of at most ``FIT_CHARS``
characters, the first by hash, and the shortest longer ones of a language with fewer. Squared hinge loss, full-batch accelerated
gradient descent, in numpy.

Defined cases: a null text or one without letters is ``und`` with score 0; with one
learned language that is predicted, with none all is ``und``; a family that the table
below doesn't name has its language alone. lang, source and doc_id are no inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.llm.common import held_out, learning_texts, prepare_workers, read_table
from mercato.llm.textbytes import LOWER, Texts, chunks, column

BUCKETS = 1 << 12
ROWS_PER_LANG = 500
FIT_CHARS = 12_000
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is"),
    "romance": ("fr", "es", "it", "pt", "ca", "ro", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "cjk": ("zh", "ja", "ko"),
}
UNKNOWN = "und"

_FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[65:91] = _LETTER[128:] = True
_ASCII_LETTER = _LETTER & (np.arange(256) < 128)
_CLASS = np.where(_LETTER, LOWER, 32).astype(np.uint32)


class Model(NamedTuple):
    langs: list[str]
    families: list[str]
    pairs: list[tuple[int, int]]      # languages of one family, by place in langs
    weights: np.ndarray               # BUCKETS x (families + pairs)
    bias: np.ndarray


def trigrams(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all trigrams, and the rows' places among them (row i: at[i]:at[i + 1])."""
    c = _CLASS[texts.data]
    if len(c) < 3:
        return np.zeros(0, np.int64), np.zeros(len(texts.at), np.int64)
    key = (c[:-2] << np.uint32(16)) | (c[1:-1] << np.uint32(8)) | c[2:]
    bucket = ((key * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64)
    keep = np.ones(len(key), bool)
    for back in (1, 2):                # none crosses rows
        edge = texts.at[1:-1] - back
        keep[edge[(edge >= 0) & (edge < len(key))]] = False
    keep &= (key != 0x202020)
    places = np.concatenate([[0], np.cumsum(keep)])
    return bucket[keep], places[np.minimum(texts.at, len(key))]


def _has_ascii_letter(texts: Texts) -> np.ndarray:
    """One value a row."""
    upto = np.concatenate([[0], np.cumsum(_ASCII_LETTER[texts.data], dtype=np.uint32)])
    return upto[texts.at[1:]] > upto[texts.at[:-1]]


def _has_letter(texts: Texts, row: int) -> bool:
    part = texts.data[texts.at[row]:texts.at[row + 1]]
    if not _LETTER[part].any():
        return False
    return any(ch.isalpha() for ch in part.tobytes().decode("utf-8", "replace"))


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values[at[i]:at[i + 1]], empty ranges 0."""
    out = np.zeros((len(at) - 1, *values.shape[1:]), np.float64)
    full = np.flatnonzero(at[1:] > at[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, at[:-1][full], axis=0)
    return out


def frequencies(texts: Texts) -> np.ndarray:
    bucket, at = trigrams(texts)
    rows = np.repeat(np.arange(len(at) - 1), np.diff(at))
    counts = np.bincount(rows * BUCKETS + bucket, minlength=(len(at) - 1) * BUCKETS).reshape(-1, BUCKETS)
    return (counts / np.maximum(1, np.diff(at))[:, None]).astype(np.float32)


def linear_svm(x: np.ndarray, y: np.ndarray, decay: float = 1e-3, steps: int = 80) -> tuple[np.ndarray, float]:
    """y in -1, 1; the classes weigh the same. Squared hinge, accelerated gradient descent."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    look_w, look_b, momentum = w, b, 1.0
    rate = 1 / (2 * (float((weight * (x * x).sum(axis=1)).sum()) + 1) + decay)
    for _ in range(steps):
        gap = np.maximum(0, 1 - y * (x @ look_w + look_b)) * weight * y
        new_w = look_w - rate * (decay * look_w - 2 * (x.T @ gap))
        new_b = look_b + rate * 2 * float(gap.sum())
        following = (1 + np.sqrt(1 + 4 * momentum ** 2)) / 2
        look_w = new_w + np.float32((momentum - 1) / following) * (new_w - w)
        look_b = new_b + (momentum - 1) / following * (new_b - b)
        w, b, momentum = new_w, new_b, following
    return w, b


def train(texts: list[str], langs: list[str]) -> Model:
    names = sorted(set(langs))
    families = sorted({_FAMILY_OF.get(n, n) for n in names})
    place = np.array([names.index(lang) for lang in langs], np.int64)
    family = np.array([families.index(_FAMILY_OF.get(n, n)) for n in names], np.int64)
    x = [frequencies(t) for t in chunks(pa.array(texts, pa.string()))] or [np.zeros((0, BUCKETS), np.float32)]
    x = np.concatenate(x)
    scale = 1 / (x.std(axis=0) + 1e-4) / np.sqrt(BUCKETS / 16) if len(x) else np.ones(BUCKETS)
    x *= scale.astype(np.float32)
    pairs = [(i, j) for i, j in combinations(range(len(names)), 2) if family[i] == family[j]]
    machines = []
    if len(families) == 2:             # one machine, from both sides
        w, b = linear_svm(x, np.where(family[place] == 0, 1, -1))
        machines += [(w, b), (-w, -b)]
    elif len(families) > 2:
        machines += [linear_svm(x, np.where(family[place] == f, 1, -1)) for f in range(len(families))]
    else:
        machines += [(np.zeros(BUCKETS), 0.0) for _ in families]
    for i, j in pairs:
        own = (place == i) | (place == j)
        machines.append(linear_svm(x[own], np.where(place[own] == i, 1, -1)))
    weights = np.stack([w * scale for w, _ in machines], axis=1) if machines else np.zeros((BUCKETS, 0))
    return Model(names, families, pairs, weights.astype(np.float32), np.array([b for _, b in machines]))


def from_counts(counts: dict[str, np.ndarray]) -> Model:
    """A model from how often each trigram (of ``BUCKETS``) is in all texts of each language: a machine weighs a trigram
    by the logarithm of how much likelier it is in its family than in the others, or in one language than in another."""
    names = sorted(counts)
    families = sorted({_FAMILY_OF.get(n, n) for n in names})
    family = np.array([families.index(_FAMILY_OF.get(n, n)) for n in names], np.int64)
    often = np.array([0.99 * counts[n] / counts[n].sum() + 0.01 / BUCKETS for n in names]).reshape(len(names), BUCKETS)
    pairs = [(i, j) for i, j in combinations(range(len(names)), 2) if family[i] == family[j]]
    weights = [np.log(often[family == f].mean(axis=0) / often[family != f].mean(axis=0)) if len(families) > 1 else np.zeros(BUCKETS)
               for f in range(len(families))]
    weights += [np.log(often[i] / often[j]) for i, j in pairs]
    weights = np.stack(weights, axis=1) if weights else np.zeros((BUCKETS, 0))
    return Model(names, families, pairs, weights.astype(np.float32), np.zeros(weights.shape[1]))


def count(docs: DataFrame) -> Model:
    """docs(text, lang): ``from_counts`` of all rows whose lang isn't null; each text weighs the same (a milliard,
    in whole numbers, that their sum has no order)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = column(batch, "lang").to_pylist()
            for texts in chunks(column(batch, "text")):
                bucket, at = trigrams(texts)
                own = np.array(langs[texts.first:texts.first + len(at) - 1], object)
                many = np.diff(at)
                weight = np.repeat(10 ** 9 // np.maximum(1, many), many)
                for lang in set(own.tolist()):
                    of = np.repeat(own == lang, many)
                    seen[lang] = seen.get(lang, 0) + np.bincount(bucket[of], weight[of], BUCKETS).astype(np.int64)
        for lang, counts in seen.items():
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)),
                                              pa.array(counts[some])], names=["lang", "bucket", "n"])

    prepare_workers(docs.sparkSession)
    known = docs.where("lang is not null and text is not null").select("text", "lang")
    out: dict[str, np.ndarray] = {}
    for r in (known.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket")
              .agg(F.sum("n").alias("n")).collect()):           # at most BUCKETS a language
        out.setdefault(r["lang"], np.zeros(BUCKETS))[r["bucket"]] = r["n"]
    return from_counts(out)


def predict(texts: Texts, model: Model) -> tuple[list[str], np.ndarray]:
    """lang and score of each row."""
    rows = len(texts.at) - 1
    if not model.langs:
        return [UNKNOWN] * rows, np.zeros(rows)
    bucket, at = trigrams(texts)
    many = np.maximum(1, np.diff(at))
    margins = np.stack([sums(model.weights[:, k][bucket], at) / many for k in range(model.weights.shape[1])], axis=1) + model.bias
    squash = lambda m: 1 / (1 + np.exp(-2 * np.clip(m, -20, 20)))
    n_families = len(model.families)
    family = margins[:, :n_families].argmax(axis=1)
    score = squash(margins[np.arange(rows), family]) if n_families > 1 else np.ones(rows)
    member = np.array([model.families.index(_FAMILY_OF.get(n, n)) for n in model.langs])
    votes = np.zeros((rows, len(model.langs)))
    worst = np.full((rows, len(model.langs)), 20.0)
    for k, (i, j) in enumerate(model.pairs, n_families):
        m = margins[:, k]
        votes[:, i] += (m >= 0) + 1e-3 * np.tanh(m)
        votes[:, j] += (m < 0) - 1e-3 * np.tanh(m)
        worst[:, i], worst[:, j] = np.minimum(worst[:, i], m), np.minimum(worst[:, j], -m)
    votes[member[None, :] != family[:, None]] = -1e9
    best = votes.argmax(axis=1)
    score = score * squash(worst[np.arange(rows), best])
    langs = [model.langs[k] for k in best]
    for r in np.flatnonzero(~_has_ascii_letter(texts)).tolist():
        if not _has_letter(texts, r):
            langs[r], score[r] = UNKNOWN, 0.0
    return langs, score


def fit(docs: DataFrame, rows: int = ROWS_PER_LANG, chars: int = FIT_CHARS) -> Model:
    """docs(text, lang, ...) of the learning fold."""
    known = docs.where("lang is not null and text is not null").select(F.col("lang").alias("label"), "text", "lang")
    each = known.select("label", F.xxhash64("text").alias("h"), F.length("text").alias("n"))
    sample = learning_texts(each, known.select("text", "lang"), rows, chars)
    return train([r["text"] for r in sample], [r["label"] for r in sample])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, held_out, lang_pred, score."""
    spark = docs.sparkSession
    prepare_workers(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for texts in chunks(column(batch, "text")):
                lang, score = predict(texts, shared.value)
                langs += lang
                scores += score.tolist()
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), column(batch, "held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
            .mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return identify(docs, fit(docs.where(~held_out(F.col("doc_id")))))
