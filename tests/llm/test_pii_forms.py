"""Forms of personal data that patterns must find whole, and texts that must not end the application."""

from __future__ import annotations

import corpus_helpers as H
import pytest
from mercato.llm import pii
from pyspark.sql import functions as F

IBANS = ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "FR1420041010050500013M02606",
         "FR14 2004 1010 0505 0001 3M02 606", "ES91 2100 0418 4502 0005 1332", "NL91 ABNA 0417 1643 00", "BE68539007547034", "CH9300762011623852957"]


def test_account_numbers_go_as_a_whole(spark):
    rows = [(k, f"to {x} by noon") for k, x in enumerate(IBANS)] + [(50, "to DE89 3704 0044 0532 0130 00 IS fine"), (51, "XX12 no number")]
    got = {r["doc_id"]: r["text"] for r in pii.replace_pii(H.documents(spark, rows)).collect()}
    for k, x in enumerate(IBANS):
        new = got[k][len("to "):-len(" by noon")]
        assert got[k].startswith("to ") and got[k].endswith(" by noon")
        assert len(new) == len(x) and new != x and [c == " " for c in new] == [c == " " for c in x]
        assert x.replace(" ", "")[4:] not in new.replace(" ", "")
    assert got[50].endswith(" IS fine") and "0130 00" not in got[50] and got[51] == "XX12 no number"


@pytest.mark.parametrize("text", ["a@" + "b." * 100_000 + "c", "a." * 100_000 + "@b.c", "1 " * 100_000, "1-" * 100_000, "+1 2" + " 3" * 100_000, "a:" * 100_000, "DE89" + " 3704" * 100_000,
                                  "Dr. " + "Anna-" * 100_000, "token=" + "-" * 100_000, "1." * 100_000, "::" * 50_000])
def test_long_runs_end(spark, text):
    """10**5 parts of whatever a pattern repeats: no stack runs over."""
    n = spark.createDataFrame([(text,)], "text string").select(F.size(F.regexp_extract_all("text", F.lit(pii.PATTERN), 0)).alias("n")).first()["n"]
    assert n >= 0


def test_text_of_many_entities(spark):
    """Parts and surrogates are walked once: 3,000 phone numbers in one text."""
    text = "; ".join(f"call 555-{200 + k // 10000:03d}-{k:04d} now" for k in range(3_000))
    docs = spark.createDataFrame([(1, text), (2, "no entity"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.replace_pii(docs, report=True).collect()}
    assert got[1]["n_entities"] == 3_000 and got[1]["kinds"] == "phone"
    parts = got[1]["text"].split("; ")
    assert len(parts) == 3_000 == len(set(parts)) and all(p.startswith("call ") and p.endswith(" now") for p in parts)
    assert not set(parts) & set(text.split("; "))
    assert (got[2]["text"], got[3]["text"]) == ("no entity", None)
