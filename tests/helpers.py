"""Builders for tiny hand-made star schemas."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from mercato.functions.calendar import wm_yr_wk
from mercato.sources.fixture import Star, calendar_from_bounds


def d(s: str) -> dt.date:
    return dt.date.fromisoformat(s)


def make_star(spark, sales, start, end, prices=None, products=None, stores=None) -> Star:
    """sales: (date, product_id, store_id, units); prices: (store_id,
    product_id, any date of the week, price); products: (product_id,
    dept_id, cat_id); stores: (store_id, state_id)."""
    s = spark.createDataFrame([(d(a), b, c, int(u)) for a, b, c, u in sales],
                              "date date, product_id string, store_id string, units_sold int")
    cal = calendar_from_bounds(spark.createDataFrame([(d(start), d(end))], "start date, end date"))
    if products is None:
        products = sorted({(r[1], "DEPT_1", "FOODS") for r in sales})
    prod = spark.createDataFrame(products, "product_id string, dept_id string, cat_id string").select(
        "product_id", F.col("product_id").alias("item_id"), "dept_id", "cat_id")
    if stores is None:
        stores = sorted({(r[2], "CA") for r in sales})
    st = spark.createDataFrame(stores, "store_id string, state_id string")
    if prices is None:
        prices = []
    p = spark.createDataFrame([(a, b, d(c), Decimal(str(v))) for a, b, c, v in prices],
                              "store_id string, product_id string, day date, sell_price decimal(10,2)")
    p = p.select("store_id", "product_id", wm_yr_wk(F.col("day")).alias("wm_yr_wk"), "sell_price")
    return Star(calendar=cal, product=prod, store=st, sales=s, prices=p)
