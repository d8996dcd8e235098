"""Small fixtures and brute-force versions."""

from __future__ import annotations

import random
import re

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, score double, held_out boolean, "
          "N long, body string, `range` int, length long, spans string, _nos string, tile string")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DOWN = str.maketrans(UPPER, LOWER)


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    words = ["the", "river", "stone", "Of", "and", "über", "naïve", "x1", "mill", "ran", "to", "sea", "old", "gate", "été"]
    return " ".join(rng.choice(words) + (rng.choice([",", ".", ""]) if rng.random() < .2 else "") + str(rng.randrange(40))
                    if rng.random() < .5 else rng.choice(words) for _ in range(n))


def texts() -> list[str | None]:
    """Nulls, empties, copies, near copies, shared lines, long and odd texts."""
    base, shared = prose(1, 300), "\n".join(prose(90 + k, 12) for k in range(3))
    words = base.split(" ")
    near = [" ".join(words[:k * 20] + ["changed"] + words[k * 20 + 1:]) for k in range(4)]
    out = [None, "", "   ", "\n\n", "a", "one two", base, base, base, *near,
           prose(2, 80) + "\n" + shared + "\n" + prose(3, 60), shared + "\n" + prose(4, 10), prose(5, 40) + "\n\n" + shared,
           "same line\n" * 10, prose(6, 4000), "été über 日本 語\x00 tab\tend", "x" * 3000, "a  b   c <|endoftext|> d", "short line\nanother",
           "\n".join([prose(92, 12), "odd", prose(91, 12)]), "😀 smile " * 30, base.upper()]
    return out + [prose(100 + k, 30 + 7 * k) for k in range(12)]


def documents(spark, rows=None):
    """With clashing extra columns, a null id and repeated rows."""
    rows = rows if rows is not None else list(enumerate(texts())) + [(None, prose(7, 50)), (6, texts()[6]), (3, prose(8, 30))]
    data = [(i, t, "en", "s", len(t) if t is not None else None, .5, True, 1, "b", 1, 1, "s", "n", "t") for i, t in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def unique_documents(spark):
    return documents(spark, [(3 * i + 1, t) for i, t in enumerate(texts())])


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(DOWN))


def shingles(text: str | None) -> frozenset:
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(DOWN))
    return frozenset(tuple(w[k:k + 3]) for k in range(len(w) - 2)) if len(w) > 2 else frozenset([tuple(w)] if w else [])
