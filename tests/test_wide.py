"""The wide file as arrays: melt, row statistics, top series, cells priced before they are rows."""

from __future__ import annotations

import re

import numpy as np
import pytest
from mercato.operators.melt import melt_priced, melt_wide, row_stats
from mercato.plans import etl
from pyspark.sql import functions as F
from pyspark.sql import types as T


def wide_frame(spark, rows, n_days):
    ids = ["id", "item_id", "dept_id", "cat_id", "store_id", "state_id"]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ids] + [T.StructField(f"d_{i + 1}", T.IntegerType()) for i in range(n_days)])
    return spark.createDataFrame([(f"{item}_{store}", item, "D1", "FOODS", store, "CA", *cells) for item, store, cells in rows], schema)


def test_melt_keeps_fills_or_drops(spark):
    wide = wide_frame(spark, [("A", "S1", [1, None, 0, 4]), ("B", "S1", [None] * 4)], 4)
    got = lambda **k: sorted(tuple(r) for r in melt_wide(wide, ["id"], **k).collect())
    assert got() == [("A_S1", "d_1", 1), ("A_S1", "d_2", 0), ("A_S1", "d_3", 0), ("A_S1", "d_4", 4), *[("B_S1", f"d_{k}", 0) for k in range(1, 5)]]
    assert got(sold=True) == got(sold=True, method="unpivot") == [("A_S1", "d_1", 1), ("A_S1", "d_4", 4)]
    kept = melt_wide(wide, ["id"], fill=None)
    assert kept.where("units_sold is null").count() == 5 and kept.count() == 8
    assert melt_wide(wide.limit(0), ["id"]).count() == 0


def test_row_statistics(spark):
    wide = wide_frame(spark, [("A", "S1", [1, None, -3]), ("B", "S1", [None] * 3), ("C", "S1", [2_000_000_000] * 3)], 3)
    got = {r["id"]: (r.mn, r.tot, r.nulls) for r in row_stats(wide, "id", ["d_1", "d_2", "d_3"]).collect()}
    assert got == {"A_S1": (-3, -2, 1), "B_S1": (None, 0, 3), "C_S1": (2_000_000_000, 6_000_000_000, 0)}


def test_top_series_of_the_full_width(spark):
    rng, n = np.random.default_rng(2), 1_913
    rows = [(f"I{k}", "S1", [int(x) if x else None for x in rng.integers(0, 9, n)]) for k in range(30)]
    rows += [("Z", "S1", rows[0][2]), ("N", "S1", [None] * n)]                           # a tie, and nothing sold
    wide = wide_frame(spark, rows, n)
    total = {f"{i}_{s}": sum(x or 0 for x in cells) for i, s, cells in rows}
    want = sorted(total, key=lambda k: (-total[k], k))[:5]
    assert [r["id"] for r in etl.top_k_ids(wide, 5).collect()] == want or {r["id"] for r in etl.top_k_ids(wide, 5).collect()} == set(want)


def test_cells_are_priced_before_they_are_rows(spark):
    wide = wide_frame(spark, [("A", "S1", [1, None, 2, 3]), ("A", "S2", [5, 5, 5, 5]), ("B", "S1", [7, 0, 0, 1]), ("A", "S1", [10, 0, 0, 0])], 4)
    prices = spark.createDataFrame([("S1", "A", 1, "1.50"), ("S1", "A", 2, "0.99"), ("S2", "A", 2, "2.00"), ("S1", "B", 1, None), ("S9", "Q", 1, "1.00"),
                                    ("S1", "B", 9, "4.00")], "store_id string, item_id string, wm_yr_wk int, p string").select(
        "store_id", "item_id", "wm_yr_wk", F.col("p").cast("decimal(10,2)").alias("sell_price"))
    weeks = {"d_1": 1, "d_2": 1, "d_3": 2, "d_4": None}
    rows = melt_priced(wide, prices, ["store_id", "item_id"], ["id"], weeks)
    got = sorted(tuple(r) for r in rows.collect())
    assert got == sorted([("A_S1", 0, 1, 150), ("A_S1", 1, 0, 0), ("A_S1", 2, 2, 198), ("A_S1", 3, 3, 0),
                          ("A_S1", 0, 10, 1500), ("A_S1", 1, 0, 0), ("A_S1", 2, 0, 0), ("A_S1", 3, 0, 0),
                          ("A_S2", 0, 5, 0), ("A_S2", 1, 5, 0), ("A_S2", 2, 5, 1000), ("A_S2", 3, 5, 0),
                          ("B_S1", 0, 7, 0), ("B_S1", 1, 0, 0), ("B_S1", 2, 0, 0), ("B_S1", 3, 1, 0)])
    assert melt_priced(wide.limit(0), prices, ["store_id", "item_id"], ["id"], weeks).count() == 0
    assert melt_priced(wide, prices.limit(0), ["store_id", "item_id"], ["id"], weeks).agg(F.sum("cents")).first()[0] == 0


def test_no_cell_is_shuffled(spark, tmpdir_path):
    """Above the melt stands the exchange of the partial sums and no other; below, wide rows and prices."""
    from test_timeseries_etl import _write_inputs
    from mercato.sources.m5 import load_raw
    _write_inputs(tmpdir_path)
    wide, cal, prices = load_raw(spark, tmpdir_path)
    out = etl.enriched_daily(wide, cal, prices)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    full = out._jdf.queryExecution().executedPlan().toString()
    assert full.count("Exchange hashpartitioning") == 3
    above = full[:full.index("FlatMapCoGroupsInArrow")]
    assert above.count("Exchange hashpartitioning") == 1 and "HashAggregate" in above and "Generate" in above
    assert len(re.findall("SortMergeJoin|ShuffledHashJoin", plan)) == 0
    # the same sums as cell by cell
    long = etl.enrich(melt_wide(wide, ["id", "item_id", "dept_id", "cat_id", "store_id", "state_id"]), etl.calendar_clean(cal),
                      prices.withColumnRenamed("item_id", "product_id"))
    one = sorted(map(str, etl.aggregate_daily(long).select(*etl.AGG_KEYS, "total_units", F.col("total_revenue").cast("double")).collect()))
    assert one == sorted(map(str, out.select(*etl.AGG_KEYS, "total_units", F.col("total_revenue").cast("double")).collect()))
