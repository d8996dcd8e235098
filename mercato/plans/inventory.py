"""Inventory optimisation: ABC, demand statistics, safety stock, reorder
point, EOQ, stock proxy, stockout risk, financial impact.

All series (item x store) of the dense fact are processed -- the per-series
statistics come from one aggregation of the sparse fact (``dense``
moments), so nothing is expanded to one row per day. Formulas use numpy's
half-to-even rounding (``pd_round``) where the notebook rounds in pandas and
SQL half-up (``F.round``) where the SQL layer rounds.
"""

from __future__ import annotations

from decimal import Decimal
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercato.functions.rounding import pd_round, ratio
from mercato.operators.dense import dense_mean, dense_rows, dense_std, series_moments
from mercato.operators.histogram import histogram
from mercato.operators.prefix_sum import prefix_sum
from mercato.operators.pricing import week_days, with_price
from mercato.sources.fixture import Star

# Policy parameters (fixed values of the inventory model).
LEAD_TIME_DAYS = 7
SERVICE_LEVEL = 0.95
ORDER_COST = 50.0
HOLDING_RATE = 0.25
GROSS_MARGIN = 0.30
STOCK_WINDOW_DAYS = 14
ABC_A, ABC_B = 0.70, 0.90
RISK_HIGH, RISK_MEDIUM = 1.5, 0.8
Z_SCORE = NormalDist().inv_cdf(SERVICE_LEVEL)  # 1.6448536269514722

SERIES = ["product_id", "store_id"]


def _cat(df: DataFrame, star: Star) -> DataFrame:
    return df.join(star.product.select("product_id", "cat_id"), "product_id")


def _money(amount: Column | str) -> Column:
    """A sum of amounts in cents, the same in any order of the rows: DECIMAL is summed, cast last."""
    return F.sum((F.col(amount) if isinstance(amount, str) else amount).cast("decimal(28,2)")).cast("double")


# ----------------------------------------------------------------- ABC

def series_revenue(star: Star) -> DataFrame:
    """Per series: total units and revenue, unpriced days counted as 0."""
    s = with_price(star.sales, star.calendar, star.prices, "left")
    sums = s.groupBy("product_id", "store_id").agg(
        F.sum("units_sold").cast("bigint").alias("total_units"), F.sum("revenue").alias("revenue"))
    if star.series_ids is not None:
        sums = star.series_ids.join(sums, ["product_id", "store_id"], "left")
    return _cat(sums, star).select(
        "product_id", "store_id", "cat_id", F.coalesce("total_units", F.lit(0)).cast("bigint").alias("total_units"),
        F.coalesce("revenue", F.lit(0)).alias("revenue"))


def abc_classification(star: Star, a: float = ABC_A, b: float = ABC_B) -> DataFrame:
    rev = series_revenue(star)
    order = [F.desc("revenue"), F.asc("product_id"), F.asc("store_id")]
    cum = prefix_sum(rev, "revenue", order, out="cum", total="all")
    total = F.col("all")
    # exact decimal comparison of the running total with the class cut-offs
    cls = (F.when(F.col("cum") <= total * F.lit(Decimal(str(a))), "A")
           .when(F.col("cum") <= total * F.lit(Decimal(str(b))), "B").otherwise("C"))
    return cum.select(
        "product_id", "store_id", "cat_id", "total_units",
        F.col("revenue").cast("double").alias("total_revenue"),
        ratio(F.col("revenue"), total).alias("revenue_pct"),
        ratio(F.col("cum"), total).alias("cumulative_pct"),
        cls.alias("abc_class"))


def abc_summary(abc: DataFrame) -> DataFrame:
    g = abc.groupBy("abc_class").agg(F.count(F.lit(1)).alias("num_skus"),
                                     _money("total_revenue").alias("total_revenue"))
    allw = Window.partitionBy()  # at most three classes
    return g.select(
        "abc_class", "num_skus", F.round("total_revenue", 2).alias("total_revenue"),
        pd_round(F.col("num_skus") / F.sum("num_skus").over(allw) * 100, 1).alias("sku_pct"),
        pd_round(ratio(F.col("total_revenue"), F.sum("total_revenue").over(allw)) * 100, 1).alias("rev_pct"))


# ------------------------------------------------------- demand statistics

def demand_stats(star: Star) -> DataFrame:
    """mean/std of daily units over every day, mean price over priced days
    (NULL -> 1.0), total units; std of a one-day series -> 0."""
    m = series_moments(star.sales, star.n_days(), series=star.series_ids)
    # each price row covers every calendar day of its week for that series
    pdays = (star.prices.join(F.broadcast(week_days(star.calendar)), "wm_yr_wk")
             .groupBy(*SERIES).agg(F.sum(F.col("sell_price") * F.col("week_days")).alias("pd"),
                                   F.sum("week_days").alias("nd")))
    return _cat(m, star).join(pdays, SERIES, "left").select(
        *SERIES, "cat_id",
        dense_mean().alias("avg_daily_demand"),
        F.coalesce(dense_std(), F.lit(0.0)).alias("demand_std"),
        F.coalesce(ratio(F.col("pd"), F.col("nd")), F.lit(1.0)).alias("avg_price"),
        F.col("sx").alias("total_units"))


def stock_proxy(star: Star, days: int = STOCK_WINDOW_DAYS) -> DataFrame:
    cutoff = F.date_sub(star.last_day(), days)
    return (star.sales.where(F.col("date") >= cutoff).groupBy(*SERIES)
            .agg(F.sum("units_sold").cast("bigint").alias("current_stock_proxy")))


def _policy(stats: DataFrame) -> DataFrame:
    avg, std, price = F.col("avg_daily_demand"), F.col("demand_std"), F.col("avg_price")
    safety = pd_round(F.greatest(F.lit(Z_SCORE) * std * F.sqrt(F.lit(float(LEAD_TIME_DAYS))),
                                 F.lit(0.0))).cast("bigint")
    holding = price * HOLDING_RATE
    holding = F.when(holding == 0, F.lit(0.01)).otherwise(holding)
    eoq = pd_round(F.sqrt(F.lit(2.0) * (avg * 365) * ORDER_COST / holding)).cast("bigint")
    return (stats.withColumn("safety_stock", safety)
            .withColumn("reorder_point",
                        pd_round(avg * LEAD_TIME_DAYS + F.col("safety_stock")).cast("bigint"))
            .withColumn("eoq", eoq))


def policy_table(star: Star) -> DataFrame:
    """Demand statistics, policy and stock proxy of every series."""
    stats = _policy(demand_stats(star))
    stock = stock_proxy(star)
    out = stats.join(stock, SERIES, "left").withColumn(
        "current_stock_proxy", F.coalesce("current_stock_proxy", F.lit(0)).cast("bigint"))
    avg = F.col("avg_daily_demand")
    return out.select(
        *SERIES, "cat_id", "avg_daily_demand", "demand_std", "avg_price", "total_units",
        "safety_stock", "reorder_point", "eoq",
        pd_round(avg * 7, 1).alias("forecast_7d"),
        pd_round(avg * 30, 1).alias("forecast_30d"),
        F.lit(LEAD_TIME_DAYS).alias("lead_time_days"),
        "current_stock_proxy",
        F.when(F.col("current_stock_proxy") < F.col("reorder_point"), F.col("eoq"))
        .otherwise(F.lit(0)).cast("bigint").alias("recommended_order_qty"))


def inventory_recommendations(star: Star) -> DataFrame:
    """The recommendations table; float statistics reported to 8 decimals."""
    r = policy_table(star)
    return r.withColumn("demand_std", F.round("demand_std", 8)).withColumn(
        "avg_price", F.round("avg_price", 8))


def stockout_risk(star: Star, recs: DataFrame | None = None, keep=()) -> DataFrame:
    r = recs if recs is not None else policy_table(star)
    stock = F.col("current_stock_proxy")
    fc7 = F.col("forecast_7d")
    score = fc7 / F.when(stock == 0, F.lit(0.1)).otherwise(stock.cast("double"))
    avg = F.col("avg_daily_demand")
    days = pd_round(stock / F.when(avg == 0, F.lit(0.01)).otherwise(avg)).cast("bigint")
    return r.select(
        *SERIES, "cat_id", "avg_price", "avg_daily_demand", "current_stock_proxy",
        fc7.alias("forecast_demand_7d"), score.alias("risk_score"),
        F.when(score >= RISK_HIGH, "HIGH").when(score >= RISK_MEDIUM, "MEDIUM")
        .otherwise("LOW").alias("risk_level"),
        F.least(F.greatest(days, F.lit(0)), F.lit(999)).alias("days_to_stockout"), *keep)


RISK_COLUMNS = ["product_id", "store_id", "cat_id", "current_stock_proxy", "forecast_demand_7d",
                "risk_score", "risk_level", "days_to_stockout"]


def _impact_columns():
    """Per series: 30-day holding cost of overstock and lost profit of
    understock against the 7-day forecast, each rounded to cents."""
    stock = F.col("current_stock_proxy").cast("double")
    fc7, price = F.col("forecast_demand_7d"), F.col("avg_price")
    over = F.greatest(stock - fc7, F.lit(0.0))
    under = F.greatest(fc7 - stock, F.lit(0.0))
    holding = pd_round(over * price * HOLDING_RATE / 12, 2)
    lost_rev = pd_round(under * price, 2)
    return holding, pd_round(lost_rev * GROSS_MARGIN, 2)


def _impact_by_category(risk: DataFrame) -> DataFrame:
    holding, lost_profit = _impact_columns()
    return risk.groupBy("cat_id").agg(
        _money(holding).alias("hc"), _money(lost_profit).alias("lp"),
        F.count_if(F.col("risk_level") == "HIGH").alias("high_risk"))


def financial_impact(risk: DataFrame) -> DataFrame:
    g = _impact_by_category(risk)
    return g.select("cat_id", pd_round(F.col("hc"), 2).alias("holding_cost"),
                    pd_round(F.col("lp"), 2).alias("lost_profit"), "high_risk",
                    pd_round(F.col("hc") + F.col("lp"), 2).alias("total_impact"))


# --------------------------------------------------------- named queries

def inv_abc(star: Star) -> DataFrame:
    return abc_classification(star)


def inv_abc_summary(star: Star) -> DataFrame:
    return abc_summary(abc_classification(star))


def inv_recommendations(star: Star) -> DataFrame:
    return inventory_recommendations(star)


def inv_stockout_risk(star: Star) -> DataFrame:
    return stockout_risk(star).select(*RISK_COLUMNS)


def inv_top_risk(star: Star, k: int = 10) -> DataFrame:
    r = stockout_risk(star).where(F.col("risk_level") == "HIGH")
    return (r.orderBy(F.desc("risk_score"), "product_id", "store_id").limit(k)
            .select("product_id", "store_id", "cat_id", "current_stock_proxy", "forecast_demand_7d",
                    pd_round(F.col("risk_score"), 2).alias("risk_score"), "days_to_stockout"))


def inv_financial_impact(star: Star) -> DataFrame:
    return financial_impact(stockout_risk(star))


def inv_metric_histogram(star: Star, bins: int = 30, quantile: float = 0.95) -> DataFrame:
    """30-bin histograms of safety stock, reorder point and EOQ per category,
    each below its metric's p95: the recommendations are computed once and
    unpivoted to (metric, category, value)."""
    recs = policy_table(star)
    metrics = ["safety_stock", "reorder_point", "eoq"]
    long = recs.select("cat_id", *metrics).unpivot(["cat_id"], metrics, "metric", "value")
    return histogram(long, "value", bins, keys=["metric", "cat_id"], below_quantile=quantile,
                     quantile_keys=["metric"])


def inv_executive_summary(star: Star) -> DataFrame:
    """Class counts, HIGH-risk count, reorder-now count and total monthly
    impact: one aggregate over the ABC rows and one over the risk rows."""
    abc = abc_classification(star).agg(
        F.count_if(F.col("abc_class") == "A").alias("class_a_skus"),
        F.count_if(F.col("abc_class") == "B").alias("class_b_skus"),
        F.count_if(F.col("abc_class") == "C").alias("class_c_skus"))
    risk = stockout_risk(star, policy_table(star), keep=("recommended_order_qty",))
    hc, lp = _impact_columns()
    r = risk.agg(F.struct(
        F.count_if(F.col("risk_level") == "HIGH").alias("high"),
        F.count_if(F.col("recommended_order_qty") > 0).alias("reorder"),
        _money(hc + lp).alias("impact")).alias("r")).scalar()
    return abc.select("class_a_skus", "class_b_skus", "class_c_skus",
                      r.getField("high").alias("high_risk_skus"),
                      r.getField("reorder").alias("reorder_now_skus"),
                      pd_round(r.getField("impact"), 2).alias("total_monthly_impact"))


# ------------------------------------------------ KPIs on inventory tables

def kpi21_rolling_demand(star: Star, n_products: int = 10) -> DataFrame:
    abc = abc_classification(star)
    # the SQL's LIMIT 10 has no order: defined as the 10 largest class-A rows
    top = (abc.where(F.col("abc_class") == "A")
           .orderBy(F.desc("total_revenue"), "product_id", "store_id").limit(n_products)
           .select("product_id").distinct())
    series = star.series().join(top, "product_id", "left_semi")
    dense = dense_rows(star.sales, series, star.first_day(), star.last_day())
    # window partitions are single series: bounded by the number of days
    w = Window.partitionBy("product_id", "store_id").orderBy("date")
    return dense.select(
        "product_id", "store_id", "date", "units_sold",
        F.round(F.avg("units_sold").over(w.rowsBetween(-6, 0)), 2).alias("rolling_7d_avg_demand"),
        F.round(F.avg("units_sold").over(w.rowsBetween(-29, 0)), 2).alias("rolling_30d_avg_demand"))


def kpi22_reorder_alerts(star: Star) -> DataFrame:
    ir = inventory_recommendations(star)
    stock = F.col("current_stock_proxy")
    return ir.where(stock < F.col("reorder_point")).select(
        "product_id", "store_id", "cat_id", "reorder_point", "current_stock_proxy", "forecast_30d",
        F.when(stock <= 0, "CRITICAL — STOCKOUT").when(stock < F.col("reorder_point"), "ORDER NOW")
        .otherwise("OK").alias("alert_status"))


def kpi23_abc_summary(star: Star) -> DataFrame:
    abc = abc_classification(star)
    g = abc.groupBy("abc_class").agg(
        F.count(F.lit(1)).alias("num_skus"), _money("total_revenue").alias("rev"),
        F.avg("revenue_pct").alias("avg_pct"))
    return g.select(
        "abc_class", "num_skus",
        F.round(F.col("num_skus") / F.sum("num_skus").over(Window.partitionBy()) * 100, 2)
        .alias("pct_of_total_skus"),
        F.round("rev", 2).alias("total_revenue"),
        F.round(F.col("avg_pct") * 100, 2).alias("avg_revenue_share_pct"))


def kpi24_risk_by_store_cat(star: Star) -> DataFrame:
    r = stockout_risk(star)
    lvl = F.col("risk_level")
    return r.groupBy("store_id", "cat_id").agg(
        F.count_if(lvl == "HIGH").alias("high_risk_skus"),
        F.count_if(lvl == "MEDIUM").alias("medium_risk_skus"),
        F.count_if(lvl == "LOW").alias("low_risk_skus"),
        F.count(F.lit(1)).alias("total_skus"))


def kpi30_financial_summary(star: Star) -> DataFrame:
    j = stockout_risk(star, keep=("eoq",))
    return j.groupBy("cat_id").agg(
        F.sum(F.col("eoq") * F.lit(0.25)).cast("double").alias("estimated_annual_holding_cost_usd"),
        F.round(F.avg("days_to_stockout"), 1).alias("avg_days_to_stockout"),
        F.count_if(F.col("risk_level") == "HIGH").alias("high_risk_sku_count"))
