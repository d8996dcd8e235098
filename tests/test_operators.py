"""Hand-made cases: ties, nulls, rounding, n = 1, edge values."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from helpers import make_star
from mercato.functions.rounding import pd_round, sql_round
from mercato.operators.dense import dense_mean, dense_rows, dense_std, series_moments
from mercato.operators.histogram import histogram
from mercato.operators.melt import melt_wide, pivot_long
from mercato.operators.prefix_sum import prefix_sum
from mercato.operators.pricing import with_price
from mercato.plans import etl, inventory, kpi


def test_melt_keeps_nulls_then_fills_and_pivot_roundtrip(spark):
    wide = spark.createDataFrame(
        [("A", 1, None, 3, 0, 5), ("B", 0, 0, 0, 0, 0), ("C", 2, 2, 2, 2, 2)],
        "id string, d_1 int, d_2 int, d_3 int, d_4 int, d_5 int")
    raw = melt_wide(wide, ["id"], fill=None)
    assert raw.count() == 15
    assert raw.where(F.col("units_sold").isNull()).count() == 1
    filled = melt_wide(wide, ["id"])
    assert filled.where(F.col("units_sold").isNull()).count() == 0
    row = filled.where((F.col("id") == "A") & (F.col("d") == "d_2")).collect()[0]
    assert row.units_sold == 0
    back = pivot_long(raw, ["id"], "d", "units_sold", [f"d_{i}" for i in range(1, 6)])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, wide.collect()))


def test_price_missing_week(spark):
    # 7 days, price only for the first week (days 2024-01-06 is a Saturday)
    sales = [(f"2024-01-{i:02d}", "P1", "S1", 1) for i in range(6, 13)] + [("2024-01-13", "P1", "S1", 2)]
    star = make_star(spark, sales, "2024-01-06", "2024-01-13",
                     prices=[("S1", "P1", "2024-01-06", 2.50)])
    left = with_price(star.sales, star.calendar, star.prices, "left")
    assert left.count() == 8
    assert left.where(F.col("sell_price").isNull()).count() == 1
    inner = with_price(star.sales, star.calendar, star.prices, "inner")
    assert inner.count() == 7
    # ETL semantics: unpriced revenue counts 0
    da = etl.daily_aggregated(star).where(F.col("date") == "2024-01-13").collect()[0]
    assert float(da.total_revenue) == 0.0 and da.total_units == 2


def test_null_event_group_kept(spark):
    rows = [("2024-01-06", None, 1), ("2024-01-06", "Christmas", 2), ("2024-01-06", None, 3)]
    df = spark.createDataFrame(rows, "date string, event_name_1 string, units_sold int")
    for c in etl.AGG_KEYS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(1))
    got = {r.event_name_1: r.total_units for r in etl.aggregate_daily(df.withColumn("revenue", F.lit(0))).collect()}
    assert got == {None: 4, "Christmas": 2}


def test_zero_rows_are_no_sales(spark):
    """A dense fact: one sale, two rows with 0 units."""
    sales = [("2024-01-06", "P1", "S1", 4), ("2024-01-07", "P1", "S1", 0), ("2024-01-08", "P2", "S1", 0)]
    prices = [("S1", p, "2024-01-06", 2.0) for p in ("P1", "P2")]
    star = make_star(spark, sales, "2024-01-06", "2024-01-12", prices=prices,
                     products=[("P1", "D", "FOODS"), ("P2", "D", "HOBBIES")])
    assert kpi.kpi01_totals(star).collect()[0].total_transactions == 1
    assert kpi.kpi27_cumulative_revenue(star).count() == 1
    assert kpi.kpi28_category_pairs(star).count() == 0
    zero = {r.product_id: r.zero_sale_days for r in kpi.kpi29_zero_sales(star).collect()}
    assert zero == {"P1": 6, "P2": 7}


def test_no_division_by_zero(spark):
    """A year without sales between two others; a state that only sells on SNAP days."""
    from mercato.plans import eda
    sales = [("2022-01-02", "P1", "S1", 1), ("2024-01-02", "P1", "S1", 2)]
    star = make_star(spark, sales, "2022-01-01", "2024-01-03", prices=[("S1", "P1", "2022-01-02", 1.0)])
    yoy = {r.year: r for r in eda.eda_yoy(star).collect()}
    assert yoy[2023].yoy_units_growth == -100 and yoy[2024].yoy_units_growth is None
    lift = eda.eda_snap_lift(star).collect()[0]
    assert lift.non_snap_day == 0 and lift.lift_pct is None
    nothing = make_star(spark, [("2024-01-02", "P1", "S1", 0)], "2024-01-01", "2024-01-03")
    assert kpi.kpi08_category_revenue(nothing).count() == 0
    assert {r.rev_pct for r in inventory.inv_abc_summary(nothing).collect()} == {None}


def test_weekdays_keep_their_places(spark):
    from mercato.plans import eda
    star = make_star(spark, [("2024-01-06", "P1", "S1", 7)], "2024-01-06", "2024-01-08")
    got = {r.weekday: (r.day_order, r.mean_units) for r in eda.eda_weekday_mean(star).collect()}
    assert len(got) == 7 and got["Saturday"] == (6, 7.0) and got["Tuesday"] == (2, None) and got["Monday"] == (1, 0.0)


def test_null_keys_are_no_duplicates(spark):
    from mercato.plans.audit import audit_constraints, duplicate_keys
    df = spark.createDataFrame([(None, 1), ("a", 1), ("b", 1), ("b", 1)], "k string, v int")
    assert df.select(duplicate_keys(df, ["k"]).alias("n")).first().n == 1
    star = make_star(spark, [("2024-01-06", "P1", "S1", 1)], "2024-01-06", "2024-01-06")
    star.sales = star.sales.unionByName(spark.createDataFrame(
        [(None, "P1", "S1", 1), (None, "P2", "S1", 1)], star.sales.schema))
    got = {r.constraint_name: r.violations for r in audit_constraints(star).collect()}
    assert got["pk_fact_sales"] == 0 and got["nn_fact_sales"] == 2
    assert got["fk_sales_calendar"] == 0 and got["fk_sales_product"] == 1


@pytest.mark.parametrize("q", [0.0, 0.3, 0.95, 1.0])
def test_quantile_by_counts(spark, q):
    from mercato.operators.histogram import quantile
    rng = np.random.default_rng(int(q * 100))
    rows = [(k, int(v)) for k in ("a", "b", "c") for v in rng.integers(0, 30, rng.integers(1, 90))]
    got = {r.k: r.c for r in quantile(spark.createDataFrame(rows, "k string, v int"), "v", q, ["k"], "c").collect()}
    for k in got:
        assert got[k] == pytest.approx(np.quantile([v for n, v in rows if n == k], q))


def test_row_order_of_ordered_queries(spark):
    from mercato.plans.ordering import ORDER, ordered
    from mercato.plans.registry import star_queries
    assert set(ORDER) <= set(star_queries()) and len(ORDER) == 30
    df = spark.createDataFrame([("a", 2.0), ("b", None), ("c", 5.0), ("d", 2.0)], "cat_id string, total_revenue double")
    assert [r.cat_id for r in ordered("kpi08_category_revenue", df).collect()] == ["b", "c", "a", "d"]
    up = df.select(F.col("total_revenue").alias("year"), F.col("cat_id").alias("month"))
    assert [r.month for r in ordered("kpi02_monthly_revenue", up).collect()] == ["a", "d", "c", "b"]
    sales = [(f"2024-0{m}-0{k + 2}", f"P{k}", f"S{k % 2}", k + m) for m in (1, 2, 3) for k in range(5)]
    prices = [(f"S{k % 2}", f"P{k}", f"2024-0{m}-0{k + 2}", 1.0 + k) for m in (1, 2, 3) for k in range(5)]
    star = make_star(spark, sales, "2024-01-01", "2024-03-20", prices=list(dict.fromkeys(prices)))
    for name in ("kpi10_monthly_category", "kpi11_store_revenue", "kpi13_store_ranking", "kpi14_weekday", "kpi25_demand_cv",
                 "kpi27_cumulative_revenue", "bonus1_top5_per_store", "kpi22_reorder_alerts"):
        rows = [tuple(r) for r in star_queries()[name](star).collect()]
        again = [tuple(r) for r in ordered(name, spark.createDataFrame(rows, star_queries()[name](star).schema)).collect()]
        assert rows == again, name


def test_abc_tie_at_cut_is_deterministic(spark):
    # revenues 40, 25, 25, 10 (total 100): cumulative 40, 65, 90, 100; P2 and
    # P3 tie, the tie key puts P2 first; P3 crosses 70 % and lands in B.
    sales = [("2024-01-06", p, "S1", u) for p, u in [("P1", 40), ("P2", 25), ("P3", 25), ("P4", 10)]]
    prices = [("S1", p, "2024-01-06", 1.0) for p in ("P1", "P2", "P3", "P4")]
    star = make_star(spark, sales, "2024-01-06", "2024-01-06", prices=prices)
    for _ in range(2):
        a = {r.product_id: r.abc_class for r in inventory.abc_classification(star).collect()}
        assert a == {"P1": "A", "P2": "A", "P3": "B", "P4": "C"}


def test_one_day_series(spark):
    star = make_star(spark, [("2024-01-06", "P1", "S1", 5)], "2024-01-06", "2024-01-06",
                     prices=[("S1", "P1", "2024-01-06", 2.0)])
    r = inventory.inventory_recommendations(star).collect()[0]
    assert r.demand_std == 0.0 and r.safety_stock == 0
    cv = kpi.kpi25_demand_cv(star).collect()[0]
    assert cv.variability_class == "LOW VARIABILITY"


def test_rounding_rules(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-2.5,)], "x double")
    got = df.select(pd_round(F.col("x")).alias("e"), sql_round(F.col("x")).alias("u")).collect()
    assert [r.e for r in got] == [0.0, 2.0, 2.0, -2.0]
    assert [r.u for r in got] == [1.0, 2.0, 3.0, -3.0]


def test_zero_stock_zero_demand(spark):
    # a series whose only sale is long before the stock window: stock 0
    sales = [("2024-01-06", "P1", "S1", 1)]
    star = make_star(spark, sales + [("2024-03-01", "P2", "S1", 1)], "2024-01-06", "2024-03-01",
                     prices=[("S1", "P1", "2024-01-06", 1.0)])
    risk = {r.product_id: r for r in inventory.stockout_risk(star).collect()}
    p1 = risk["P1"]
    assert p1.current_stock_proxy == 0
    assert p1.risk_score == pytest.approx(p1.forecast_demand_7d / 0.1)
    assert 0 <= p1.days_to_stockout <= 999


def test_days_to_stockout_clipped(spark):
    rows = spark.createDataFrame([("P", "S", "C", 1.0, 1e-6, 5000, 1.0)],
                                 "product_id string, store_id string, cat_id string, avg_price double,"
                                 " avg_daily_demand double, current_stock_proxy bigint, forecast_7d double")
    r = inventory.stockout_risk(None, rows).collect()[0]
    assert r.days_to_stockout == 999


def test_mape_skips_zero_actuals(spark):
    from mercato.plans.forecasting import metrics
    df = spark.createDataFrame([("s", 0.0, 1.0), ("s", 10.0, 8.0), ("s", 0.0, 2.0), ("s", 5.0, 5.0)],
                               "k string, actual double, predicted double")
    m = metrics(df, ["k"]).collect()[0]
    assert m.mae == pytest.approx(round((1 + 2 + 2 + 0) / 4, 1))
    assert m.rmse == pytest.approx(round(math.sqrt((1 + 4 + 4 + 0) / 4), 1))
    assert m.mape == pytest.approx(round((0.2 + 0.0) / 2 * 100, 2))


def test_audit_counts_one_violation_each(spark):
    from mercato.plans.audit import audit_constraints
    sales = [("2024-01-06", "P1", "S1", 1), ("2024-01-06", "P1", "S1", 2),  # duplicate key
             ("2024-01-07", "P2", "S1", -3),                                  # negative units
             ("2024-01-07", "P1", "S9", 1)]                                   # orphan store
    star = make_star(spark, sales, "2024-01-06", "2024-01-07",
                     prices=[("S1", "P1", "2024-01-06", 0.0), ("S1", "P2", "2024-01-06", 1.0)],
                     products=[("P1", "D", "FOODS"), ("P2", "D", "FOODS")], stores=[("S1", "CA")])
    got = {r.constraint_name: r.violations for r in audit_constraints(star).collect()}
    assert got["pk_fact_sales"] == 1
    assert got["chk_units_non_negative"] == 1
    assert got["fk_sales_store"] == 1
    assert got["chk_price_positive"] == 1
    assert got["fk_sales_product"] == 0


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_prefix_sum_matches_single_partition_window(spark, parts):
    rng = np.random.default_rng(parts)
    rows = [(f"k{i:04d}", int(v)) for i, v in enumerate(rng.integers(0, 50, 500))]
    df = spark.createDataFrame(rows, "k string, v bigint")
    order = [F.desc("v"), F.asc("k")]
    got = {r.k: r.cum for r in prefix_sum(df, "v", order, "cum", num_partitions=parts).collect()}
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    want = {r.k: r.cum for r in df.withColumn("cum", F.sum("v").over(w)).collect()}
    assert got == want


def test_dense_moments_match_explicit_dense_rows(spark):
    sales = [("2024-01-06", "P1", "S1", 3), ("2024-01-09", "P1", "S1", 5),
             ("2024-01-07", "P2", "S1", 1)]
    star = make_star(spark, sales, "2024-01-06", "2024-01-12")
    m = series_moments(star.sales, star.n_days()).select(
        "product_id", dense_mean().alias("mean"), dense_std().alias("std"))
    got = {r.product_id: (r.mean, r.std) for r in m.collect()}
    dense = dense_rows(star.sales, star.series(), star.first_day(), star.last_day())
    assert dense.count() == 14
    want = {r.product_id: (r.mean, r.std) for r in dense.groupBy("product_id").agg(
        F.avg("units_sold").alias("mean"), F.stddev_samp("units_sold").alias("std")).collect()}
    for k in want:
        assert got[k][0] == pytest.approx(want[k][0]) and got[k][1] == pytest.approx(want[k][1])


def test_histogram_matches_numpy(spark):
    vals = [1, 2, 2, 3, 7, 7, 10, 50, 51, 100]
    df = spark.createDataFrame([(v,) for v in vals], "x bigint")
    h = histogram(df, "x", 10).orderBy("bin").collect()
    counts, edges = np.histogram(vals, bins=10)
    assert [r["count"] for r in h] == counts.tolist()
    assert [r.bin_start for r in h] == pytest.approx(edges[:-1].tolist())


def test_category_pairs_from_sets(spark):
    sales = [("2024-01-06", "P1", "S1", 1), ("2024-01-06", "P2", "S1", 1), ("2024-01-06", "P3", "S1", 1),
             ("2024-01-07", "P1", "S1", 1), ("2024-01-07", "P2", "S1", 1)]
    star = make_star(spark, sales, "2024-01-06", "2024-01-07",
                     products=[("P1", "D1", "FOODS"), ("P2", "D2", "HOBBIES"), ("P3", "D3", "HOUSEHOLD")])
    got = {(r.category_1, r.category_2): r.co_occurrence_days for r in kpi.kpi28_category_pairs(star).collect()}
    assert got == {("FOODS", "HOBBIES"): 2, ("FOODS", "HOUSEHOLD"): 1, ("HOBBIES", "HOUSEHOLD"): 1}
