"""Price lookup by the retail week of a sale (the correlated-subquery join).

The relational form joins ``fact_prices`` on
``wm_yr_wk = (SELECT wm_yr_wk FROM dim_calendar WHERE date = fs.date)``.
Spark rejects correlated subqueries in a join condition, and the rewrite is
also the better plan: attach the week key from the calendar (one row per
day, so its size is bounded by the date span and a broadcast is safe), then
equi-join the prices on (store, product, week).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRICE_KEYS = ["store_id", "product_id", "wm_yr_wk"]


def with_week(sales: DataFrame, calendar: DataFrame) -> DataFrame:
    if "wm_yr_wk" in sales.columns:
        return sales
    return sales.join(F.broadcast(calendar.select("date", "wm_yr_wk")), "date")


def with_price(sales: DataFrame, calendar: DataFrame, prices: DataFrame,
               how: str = "inner") -> DataFrame:
    """Add ``sell_price`` (DECIMAL(10,2)) and ``revenue = units * price``.

    ``how='left'`` keeps unpriced rows with NULL price/revenue (the view
    semantics); ``how='inner'`` drops them (the KPI semantics). A stored fact
    carries its price (``sources.fixture.materialize_star``) and isn't joined again."""
    s = with_week(sales, calendar)
    if "sell_price" in s.columns:
        out = s if how == "left" else s.where(F.col("sell_price").isNotNull())
        return out.withColumn("revenue", F.col("units_sold") * F.col("sell_price"))
    out = s.join(prices.select(*PRICE_KEYS, "sell_price"), PRICE_KEYS, how)
    return out.withColumn("revenue", F.col("units_sold") * F.col("sell_price"))


def week_days(calendar: DataFrame) -> DataFrame:
    """Number of calendar days per retail week (<= 7 rows per week)."""
    return calendar.groupBy("wm_yr_wk").agg(F.count(F.lit(1)).alias("week_days"))
