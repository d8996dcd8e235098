"""Queries on the stored star give what they give on the raw tables."""

from __future__ import annotations

import os

import pytest

from mercato.plans.registry import star_queries
from mercato.sources.fixture import materialize_star, star_from_testdata

SF = "/root/testdata/sf0.001"
NAMES = ("kpi01_totals", "kpi04_weekly_sales", "kpi06_top_revenue", "kpi27_cumulative_revenue", "inv_abc_summary",
         "bonus2_demand_spikes", "etl_daily_aggregated", "eda_store_perf")


@pytest.fixture(scope="module")
def stars(spark, tmp_path_factory):
    raw = star_from_testdata(spark, SF)
    return raw, materialize_star(raw, str(tmp_path_factory.mktemp("star")), with_wide=False)


def test_fact_is_stored_with_its_price(stars):
    _, stored = stars
    assert {"sell_price", "wm_yr_wk"} <= set(stored.sales.columns)
    plan = star_queries()["kpi08_category_revenue"](stored)._jdf.queryExecution().toString()
    assert "fact_prices" not in plan


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(stars, name):
    raw, stored = (star_queries()[name](s) for s in stars)
    assert raw.columns == stored.columns
    assert sorted(map(repr, raw.collect())) == sorted(map(repr, stored.collect()))


def test_star_sorts_no_lineitem(spark, tmp_path):
    """Parts and suppliers too many to be broadcast are hashed: lineitem isn't sorted for them."""
    tables = {"lineitem": ([(1, 7, 2.0, 10.0, "2020-01-01"), (2, 8, 3.0, 9.5, "2020-01-02"), (1, 7, 1.0, 5.0, "2020-01-01"), (None, 7, 1.0, 5.0, "2020-01-01")],
                           "l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_shipdate string"),
              "part": ([(1, "Brand#11", "TIN"), (2, "Brand#12", "TIN"), (2, "Brand#12", "TIN")], "p_partkey long, p_brand string, p_type string"),
              "supplier": ([(7, 0), (8, 1)], "s_suppkey long, s_nationkey long"),
              "nation": ([(0, "PERU", 1), (1, "CHINA", 2)], "n_nationkey long, n_name string, n_regionkey long")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sales = star_from_testdata(spark, str(tmp_path)).sales
        got = sorted((str(r["date"]), r["product_id"], r["store_id"], r["units_sold"]) for r in sales.collect())
        plan = sales._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert got == [("2020-01-01", "Brand#11_TIN", "PERU", 3), ("2020-01-02", "Brand#12_TIN", "CHINA", 6)]
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
