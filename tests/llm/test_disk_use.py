"""What the pipeline's stages leave on disk while they run."""

from __future__ import annotations

import glob
import re
import time

import corpus_helpers as H
from mercato.llm import jaccard, toxicity
from mercato.llm.graph import components
from mercato.session import checkpoint_dir


def test_labelled_texts_do_not_stay(spark):
    where = f"{checkpoint_dir(spark).removeprefix('file://')}/mercato-labelled-*"
    before = set(glob.glob(where))
    rows = [(k, H.prose(k, 60) + (" vile filth" if k % 3 == 0 else "")) for k in range(60)]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(60)], "doc_id long, toxic int")
    toxicity.fit(H.documents(spark, rows), labels)
    left = set(glob.glob(where)) - before
    assert left and all(spark.read.parquet(path).count() == 0 for path in left)


def test_files_of_past_rounds_go(spark):
    def shuffles() -> set[int]:
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return set(map(int, re.findall(r"/shuffle_(\d+)_", files)))

    before = shuffles()
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)], "a long, b long")
    assert {r["root"] for r in components(edges).collect()} == {0}
    made = max(shuffles()) - max(before, default=-1)
    for _ in range(50):        # files go a little later than what they belong to
        left = len(shuffles() - before)
        if 2 * left < made:
            break
        time.sleep(0.1)
    assert 2 * left < made


def test_keep_one_deals_texts_out_once(spark):
    docs = H.documents(spark)
    kept = jaccard.keep_one(docs)
    plan = kept._sc._jvm.PythonSQLUtils.explainString(kept._jdf.queryExecution(), "formatted")
    dealt = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]\nArguments: hashpartitioning", plan)
    assert dealt and sum("text#" in columns or "first#" in columns for columns in dealt) == 1
    assert kept.columns == docs.columns
