"""Data-quality audit of the three M5-shaped inputs (wide sales, calendar,
prices) and the star's declarative constraints.

Everything is computed (the reference prints a hard-coded ``CLEAN``). The
wide table is audited with a row-wise numpy reduction over Arrow batches
(2,000-column row expressions outgrow generated code; melting first would
multiply the rows by the number of days).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.functions.calendar import STATES
from mercato.functions.rounding import ratio
from mercato.operators.histogram import histogram
from mercato.operators.melt import day_columns, row_stats
from mercato.sources.fixture import Star
from mercato.sources.wide import series_ids, wide_sales

CATEGORIES = ["FOODS", "HOBBIES", "HOUSEHOLD"]
PRICE_KEYS = ["store_id", "product_id", "wm_yr_wk"]


def _count():
    return F.count(F.lit(1))


# ---------------------------------------------------------------- DQ1-DQ8

def duplicate_keys(df: DataFrame, keys: list[str]) -> Column:
    """Rows beyond the first of each key, as a scalar. A NULL is a value like any other here, so
    rows without a key count as duplicates of each other only."""
    return F.coalesce(df.groupBy(*keys).agg(_count().alias("n")).agg(F.sum(F.col("n") - 1)).scalar(), F.lit(0)).cast("bigint")


def audit_tables(wide: DataFrame, calendar: DataFrame, prices: DataFrame) -> DataFrame:
    """One row per input: shape, nulls, negatives, duplicate keys, zero
    prices, always-zero series, date coverage, status."""
    per_series = wide_row_stats(wide)
    # one pass over the wide rows: shape, NULLs, negatives, duplicates
    wide_row = per_series.agg(
        _count().alias("n_rows"),
        F.sum("nulls").cast("bigint").alias("null_values"),
        F.count_if(F.col("mn") < 0).cast("bigint").alias("negative_values"),
        F.count_if(F.col("tot") == 0).cast("bigint").alias("always_zero_series")).select(
        F.lit("sales_wide").alias("table_name"), F.col("n_rows").cast("bigint"),
        F.lit(len(wide.columns)).cast("bigint").alias("n_columns"),
        "null_values", "negative_values",
        duplicate_keys(per_series, ["id"]).alias("duplicate_keys"),
        F.lit(None).cast("bigint").alias("zero_prices"), "always_zero_series",
        F.round(ratio(F.col("always_zero_series"), F.col("n_rows")) * 100, 2).alias("always_zero_pct"),
        F.lit(None).cast("bigint").alias("unique_stores"), F.lit(None).cast("bigint").alias("unique_items"),
        F.lit(None).cast("date").alias("first_date"), F.lit(None).cast("date").alias("last_date"))

    cal_nulls = sum((F.col(c).isNull().cast("bigint") for c in calendar.columns), F.lit(0))
    cal_row = calendar.agg(
        _count().alias("n_rows"), F.sum(cal_nulls).alias("null_values"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date")).select(
        F.lit("calendar").alias("table_name"), F.col("n_rows").cast("bigint"),
        F.lit(len(calendar.columns)).cast("bigint").alias("n_columns"),
        F.col("null_values").cast("bigint"), F.lit(None).cast("bigint").alias("negative_values"),
        duplicate_keys(calendar, ["date"]).alias("duplicate_keys"),
        F.lit(None).cast("bigint").alias("zero_prices"), F.lit(None).cast("bigint").alias("always_zero_series"),
        F.lit(None).cast("double").alias("always_zero_pct"), F.lit(None).cast("bigint").alias("unique_stores"),
        F.lit(None).cast("bigint").alias("unique_items"), "first_date", "last_date")

    price = F.col("sell_price")
    price_row = prices.agg(
        _count().alias("n_rows"), F.count_if(price.isNull()).alias("null_values"),
        F.count_if(price < 0).alias("negative_values"), F.count_if(price == 0).alias("zero_prices"),
        F.count_distinct("store_id").alias("unique_stores"), F.count_distinct("product_id").alias("unique_items")).select(
        F.lit("sell_prices").alias("table_name"), F.col("n_rows").cast("bigint"),
        F.lit(len(prices.columns)).cast("bigint").alias("n_columns"),
        F.col("null_values").cast("bigint"), F.col("negative_values").cast("bigint"),
        duplicate_keys(prices, PRICE_KEYS).alias("duplicate_keys"),
        F.col("zero_prices").cast("bigint"), F.lit(None).cast("bigint").alias("always_zero_series"),
        F.lit(None).cast("double").alias("always_zero_pct"), "unique_stores", "unique_items",
        F.lit(None).cast("date").alias("first_date"), F.lit(None).cast("date").alias("last_date"))

    out = wide_row.unionByName(cal_row).unionByName(price_row)
    # event columns of the calendar are expected to be NULL on ordinary days
    clean = ((F.coalesce("negative_values", F.lit(0)) == 0) & (F.col("duplicate_keys") == 0)
             & (F.coalesce("zero_prices", F.lit(0)) == 0)
             & ((F.col("table_name") == "calendar") | (F.col("null_values") == 0)))
    return out.withColumn("status", F.when(clean, "CLEAN").otherwise("ISSUES"))


def wide_row_stats(wide: DataFrame) -> DataFrame:
    """Per wide row: min, sum (NULL as 0) and NULL count over the day columns: one output row per
    input row, no melt, no shuffle."""
    return row_stats(wide, "id", day_columns(wide))


def audit_report(star: Star) -> DataFrame:
    return audit_tables(wide_sales(star), star.calendar, star.prices)


def audit_nulls(star: Star) -> DataFrame:
    """DQ8: NULL count per calendar and price column, only columns with NULLs."""
    def per_column(df: DataFrame, name: str) -> DataFrame:
        counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
        return (counts.unpivot([], df.columns, "column_name", "null_count")
                .where(F.col("null_count") > 0)
                .select(F.lit(name).alias("table_name"), "column_name", "null_count"))
    return per_column(star.calendar, "calendar").unionByName(per_column(star.prices, "sell_prices"))


def audit_events(star: Star) -> DataFrame:
    """DQ3: event days per event type and distinct event names."""
    ev = star.calendar.where(F.col("event_name_1").isNotNull())
    return ev.groupBy("event_type_1").agg(_count().alias("event_days"),
                                          F.count_distinct("event_name_1").alias("unique_events"))


# ------------------------------------------------------------------ DQ9

def _counted(df: DataFrame, table: str, rules: dict[str, Column]) -> DataFrame:
    """Rows that break each rule, in one pass over the table."""
    one = df.agg(*[F.count_if(broken).alias(name) for name, broken in rules.items()])
    return (one.unpivot([], list(rules), "constraint_name", "violations")
            .select("constraint_name", F.lit(table).alias("table_name"), F.col("violations").cast("bigint").alias("violations")))


def _unique(df: DataFrame, table: str, name: str, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(_count().alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("v")).select(
        F.lit(name).alias("constraint_name"), F.lit(table).alias("table_name"), F.col("v").cast("bigint").alias("violations"))


def _references(df: DataFrame, table: str, dims: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """Rows without a partner, for all dimensions in one pass. A NULL key refers to nothing and
    breaks NOT NULL only, as a foreign key in SQL."""
    for name, (key, dim) in dims.items():
        df = df.join(dim.select(F.col(key).alias(name)).distinct(), F.col(key) == F.col(name), "left")
    return _counted(df, table, {name: F.col(key).isNotNull() & F.col(name).isNull() for name, (key, _) in dims.items()})


def _any_null(*cols: str) -> Column:
    return F.greatest(*[F.col(c).isNull() for c in cols]) if len(cols) > 1 else F.col(cols[0]).isNull()


def audit_constraints(star: Star) -> DataFrame:
    """Violations per declared constraint (PK, FK, CHECK, NOT NULL) of facts and dimensions."""
    s, p, c, prod, store = star.sales, star.prices, star.calendar, star.product, star.store
    parts = [
        _unique(c, "dim_calendar", "pk_dim_calendar", ["date"]),
        _unique(prod, "dim_product", "pk_dim_product", ["product_id"]),
        _unique(store, "dim_store", "pk_dim_store", ["store_id"]),
        _unique(s, "fact_sales", "pk_fact_sales", ["date", "product_id", "store_id"]),
        _unique(p, "fact_prices", "pk_fact_prices", PRICE_KEYS),
        _references(s, "fact_sales", {"fk_sales_calendar": ("date", c), "fk_sales_product": ("product_id", prod),
                                      "fk_sales_store": ("store_id", store)}),
        _references(p, "fact_prices", {"fk_prices_product": ("product_id", prod), "fk_prices_store": ("store_id", store)}),
        _counted(s, "fact_sales", {"chk_units_non_negative": F.col("units_sold") < 0,
                                   "nn_fact_sales": _any_null("date", "product_id", "store_id", "units_sold")}),
        _counted(p, "fact_prices", {"chk_price_positive": F.col("sell_price") <= 0,
                                    "nn_fact_prices": _any_null(*PRICE_KEYS, "sell_price")}),
        _counted(prod, "dim_product", {"chk_cat_domain": ~F.col("cat_id").isin(CATEGORIES),
                                       "nn_dim_product": _any_null("product_id", "item_id", "dept_id", "cat_id")}),
        _counted(store, "dim_store", {"chk_state_domain": ~F.col("state_id").isin(STATES),
                                      "nn_dim_store": _any_null("store_id", "state_id")}),
        _counted(c, "dim_calendar", {"chk_wday_range": ~F.col("wday").between(1, 7), "nn_dim_calendar": _any_null(
            "date", "d", "wm_yr_wk", "weekday", "wday", "month", "year", "snap_CA", "snap_TX", "snap_WI")}),
    ]
    return reduce(DataFrame.unionByName, parts)


def audit_derived_constraints(star: Star) -> DataFrame:
    """The same for the three tables that the inventory analysis stores."""
    from mercato.plans import inventory
    keys = ["product_id", "store_id"]
    abc, recs, risk = (inventory.abc_classification(star), inventory.inventory_recommendations(star),
                       inventory.stockout_risk(star))
    return reduce(DataFrame.unionByName, [
        _unique(abc, "abc_classification", "pk_abc", keys),
        _unique(recs, "inventory_recommendations", "pk_inv_rec", keys),
        _unique(risk, "stockout_risk", "pk_stockout", keys),
        _counted(abc, "abc_classification", {
            "chk_abc_class": ~F.col("abc_class").isin("A", "B", "C"),
            "nn_abc": _any_null(*keys, "total_units", "total_revenue", "revenue_pct", "cumulative_pct", "abc_class")}),
        _counted(recs, "inventory_recommendations", {"nn_inv_rec": _any_null(*keys)}),
        _counted(risk, "stockout_risk", {"chk_risk_level": ~F.col("risk_level").isin("LOW", "MEDIUM", "HIGH"),
                                         "nn_stockout": _any_null(*keys)})])


# ------------------------------------------------------------- DQ10, AG16

def _series_dims(star: Star) -> DataFrame:
    return (star.series().join(star.product.select("product_id", "item_id", "dept_id", "cat_id"),
                               "product_id").join(star.store, "store_id"))


def audit_cardinality(star: Star) -> DataFrame:
    """Series (wide rows) per category and department."""
    return _series_dims(star).groupBy("cat_id", "dept_id").agg(_count().alias("sku_count"))


def audit_distinct_values(star: Star) -> DataFrame:
    """Distinct values of the low-cardinality attributes (bounded by the
    dimensions), sorted; items are only counted."""
    names = ["cat_id", "dept_id", "store_id", "state_id"]
    one = _series_dims(star).agg(*[F.collect_set(c).alias(c) for c in names], F.count_distinct("item_id").alias("n_items"))
    rows = [F.struct(F.lit(c).alias("attribute"), F.size(c).cast("bigint").alias("n_distinct"),
                     F.array_join(F.sort_array(c), ",").alias("distinct_values")) for c in names]
    rows.append(F.struct(F.lit("item_id").alias("attribute"), F.col("n_items").alias("n_distinct"),
                         F.lit(None).cast("string").alias("distinct_values")))
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def audit_price_summary(star: Star) -> DataFrame:
    """``describe()`` of the numeric price columns: count, mean, std, min,
    quartiles (linear interpolation), max -- one row per statistic."""
    p = star.prices.select(F.col("wm_yr_wk").cast("double").alias("wm_yr_wk"),
                           F.col("sell_price").cast("double").alias("sell_price"))
    cols = ("wm_yr_wk", "sell_price")
    stats = [("count", F.count), ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min),
             ("25%", None), ("50%", None), ("75%", None), ("max", F.max)]
    # one exact percentile aggregate per column for the three quartiles
    quart = p.agg(*[F.percentile(F.col(c), [0.25, 0.5, 0.75]).alias(f"q|{c}") for c in cols],
                  *[fn(F.col(c)).cast("double").alias(f"{i}|{c}") for i, (_, fn) in enumerate(stats)
                    if fn is not None for c in cols])
    one = quart.select("*", *[F.col(f"`q|{c}`")[j].alias(f"{i}|{c}")
                              for j, i in enumerate((4, 5, 6)) for c in cols])
    rows = None
    for i, (name, _) in enumerate(stats):
        r = one.select(F.lit(i).alias("stat_order"), F.lit(name).alias("statistic"),
                       F.round(F.col(f"`{i}|wm_yr_wk`"), 6).alias("wm_yr_wk"),
                       F.round(F.col(f"`{i}|sell_price`"), 6).alias("sell_price"))
        rows = r if rows is None else rows.unionByName(r)
    return rows


def audit_histogram(star: Star, bins: int = 50, quantile: float = 0.99) -> DataFrame:
    """Lifetime units per series: full range and below the p99."""
    totals = series_ids(star.sales.groupBy("product_id", "store_id").agg(
        F.sum("units_sold").cast("bigint").alias("lifetime_units")))
    full = histogram(totals, "lifetime_units", bins).select(F.lit("all").alias("variant"), "*")
    cut = histogram(totals, "lifetime_units", bins, below_quantile=quantile).select(
        F.lit("below_p99").alias("variant"), "*")
    return full.unionByName(cut)
