"""ETL: calendar subset, wide -> long melt, enrichment, daily pre-aggregate,
top-k series sample, and the file-to-file job over M5-style inputs.

The reference loops over 300-row chunks of the wide file, melts each chunk,
joins calendar and prices, and partially aggregates; here that is one lazy
plan (scan -> semi-join -> unpivot -> joins -> aggregate -> write), with
partial/final aggregation and parallelism left to Spark.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.operators.dense import dense_rows, expand_days
from mercato.operators.melt import day_columns, melt_priced, melt_wide, row_stats
from mercato.operators.pricing import with_price
from mercato.sources.fixture import Star
from mercato.sources.wide import ID_COLS, series_ids, wide_sales

CALENDAR_COLS = ["date", "d", "wm_yr_wk", "weekday", "wday", "month", "year",
                 "event_name_1", "event_type_1", "event_name_2", "event_type_2",
                 "snap_CA", "snap_TX", "snap_WI"]
#: fixed values: the column lists of the stored tables
AGG_KEYS = ["date", "cat_id", "dept_id", "store_id", "state_id", "year", "month", "weekday",
            "wday", "event_name_1", "snap_CA", "snap_TX", "snap_WI"]
ENRICH_CAL_COLS = ["d", "wm_yr_wk", *[c for c in AGG_KEYS if c in CALENDAR_COLS]]
SAMPLE_COLS = ["date", "product_id", "item_id", "dept_id", "cat_id", "store_id", "state_id",
               "year", "month", "weekday", "wday", "event_name_1", "snap_CA", "snap_TX",
               "snap_WI", "units_sold", "sell_price"]


# ------------------------------------------------------------ operators

def calendar_clean(calendar: DataFrame) -> DataFrame:
    return calendar.select(*CALENDAR_COLS)


def enrich(long: DataFrame, calendar: DataFrame, prices: DataFrame) -> DataFrame:
    """Long sales (``id`` cols, ``d``, ``units_sold``) + calendar attributes
    (left join on ``d``; the calendar is one row per day, broadcast) +
    weekly price (left join on store, item, week); ``revenue`` counts
    unpriced days as 0."""
    cal = F.broadcast(calendar.select(*ENRICH_CAL_COLS))
    out = long.join(cal, "d", "left")
    p = prices.select("store_id", F.col("product_id").alias("item_id"), "wm_yr_wk", "sell_price")
    out = out.join(p, ["store_id", "item_id", "wm_yr_wk"], "left")
    return out.withColumn("revenue", F.col("units_sold") * F.coalesce("sell_price", F.lit(0)))


def aggregate_daily(enriched: DataFrame) -> DataFrame:
    """Group by date x dept x store with calendar attributes; a NULL event
    name is its own group (Spark's default GROUP BY keeps nulls)."""
    return enriched.groupBy(*AGG_KEYS).agg(
        F.sum("units_sold").cast("bigint").alias("total_units"),
        F.sum("revenue").alias("total_revenue"))


def top_k_ids(wide: DataFrame, k: int = 200) -> DataFrame:
    """Ids of the k series with the largest lifetime units (ties: id)."""
    return (row_stats(wide, "id", day_columns(wide)).select("id", F.col("tot").alias("lifetime_units"))
            .orderBy(F.desc("lifetime_units"), "id").limit(k).select("id"))


def enriched_daily(wide: DataFrame, calendar: DataFrame, prices: DataFrame) -> DataFrame:
    """``daily_aggregated`` from the wide file in one step: wide rows and prices meet by (store, item),
    cells are priced as arrays and first become rows below the partial aggregate. The only exchanges are
    those of the wide rows, the prices and the partial sums; ``enrich`` would send each cell to its price."""
    names = day_columns(wide)
    known = {r["d"]: r["wm_yr_wk"] for r in calendar.select("d", "wm_yr_wk").collect()}      # a row a day
    days = [d for d in names if d in known]
    keep = ["cat_id", "dept_id", "store_id", "state_id"]
    cells = melt_priced(wide, prices, ["store_id", "item_id"], keep, {d: known[d] for d in days})
    place = wide.sparkSession.createDataFrame(list(enumerate(days)), "day_no int, d string")
    cal = F.broadcast(place.join(calendar, "d").select("day_no", *[c for c in AGG_KEYS if c not in keep]))
    sums = cells.groupBy("day_no", *keep).agg(F.sum("units_sold").cast("bigint").alias("total_units"), F.sum("cents").alias("cents"))
    return sums.join(cal, "day_no").select(*AGG_KEYS, "total_units", (F.col("cents").cast("decimal(36,0)") * F.lit(0.01).cast("decimal(3,2)"))
                                           .cast("decimal(38,2)").alias("total_revenue"))


# ------------------------------------------------------- queries on a star

def etl_calendar(star: Star) -> DataFrame:
    return calendar_clean(star.calendar)


def etl_melt(star: Star) -> DataFrame:
    wide = wide_sales(star)
    return melt_wide(wide, ID_COLS)


def daily_aggregated(star: Star) -> DataFrame:
    """``daily_aggregated`` from the sparse fact: sums per (date, dept, store)
    plus a zero-filled spine of every calendar day for each observed
    (cat, dept, store, state) -- identical to aggregating the dense melt."""
    dims_p = star.product.select("product_id", "dept_id", "cat_id")
    combos = (star.series().join(dims_p, "product_id").join(star.store, "store_id")
              .select("cat_id", "dept_id", "store_id", "state_id").distinct())
    grid = expand_days(combos, star.first_day(), star.last_day())
    s = with_price(star.sales, star.calendar, star.prices, "left")
    s = s.join(dims_p, "product_id").withColumn(
        "rev", F.col("units_sold") * F.coalesce("sell_price", F.lit(0)))
    sums = s.groupBy("date", "dept_id", "store_id").agg(
        F.sum("units_sold").cast("bigint").alias("u"), F.sum("rev").alias("r"))
    cal = F.broadcast(star.calendar.select(*[c for c in AGG_KEYS if c not in
                                              ("cat_id", "dept_id", "store_id", "state_id")]))
    out = grid.join(sums, ["date", "dept_id", "store_id"], "left").join(cal, "date")
    return out.select(*AGG_KEYS, F.coalesce("u", F.lit(0)).cast("bigint").alias("total_units"),
                      F.coalesce("r", F.lit(0)).alias("total_revenue"))


def etl_daily_aggregated(star: Star) -> DataFrame:
    d = daily_aggregated(star)
    return d.withColumn("total_revenue", F.col("total_revenue").cast("double"))


def etl_enriched_daily(star: Star) -> DataFrame:
    """The ETL on the wide file: melt, price, aggregate."""
    d = enriched_daily(wide_sales(star), star.calendar, star.prices.withColumnRenamed("product_id", "item_id"))
    return d.withColumn("total_revenue", F.col("total_revenue").cast("double"))


def etl_top200_sample(star: Star, k: int = 200) -> DataFrame:
    totals = series_ids(star.sales.groupBy("product_id", "store_id").agg(
        F.sum("units_sold").cast("bigint").alias("lifetime_units")))
    top = totals.orderBy(F.desc("lifetime_units"), "id").limit(k).select("id", "product_id", "store_id")
    dense = dense_rows(star.sales, top.select("product_id", "store_id"), star.first_day(),
                       star.last_day(), prices=star.prices, calendar=star.calendar)
    cal = F.broadcast(star.calendar.select("date", "year", "month", "weekday", "wday", "event_name_1",
                                           "snap_CA", "snap_TX", "snap_WI"))
    out = (dense.join(cal, "date")
           .join(star.product.select("product_id", "item_id", "dept_id", "cat_id"), "product_id")
           .join(star.store, "store_id"))
    out = series_ids(out).drop("product_id").withColumnRenamed("id", "product_id")
    return out.select(*SAMPLE_COLS)


# ------------------------------------------------ file-to-file ETL job

def run_etl(wide: DataFrame, calendar: DataFrame, prices: DataFrame, out_dir: str,
            k: int = 200) -> dict[str, int]:
    """The load job over M5-style inputs: writes ``calendar_clean``,
    ``daily_aggregated`` (partitioned by year) and ``sales_enriched_sample``
    as parquet under ``out_dir`` and returns the verified row counts.

    ``prices`` uses the M5 column ``item_id``; it is renamed to the star's
    ``product_id`` key here."""
    if "item_id" in prices.columns and "product_id" not in prices.columns:
        prices = prices.withColumnRenamed("item_id", "product_id")
    cal = calendar_clean(calendar)
    cal.write.mode("overwrite").parquet(os.path.join(out_dir, "calendar_clean.parquet"))

    top = top_k_ids(wide, k)
    long = melt_wide(wide, ID_COLS)
    enriched = enrich(long, cal, prices)
    agg = aggregate_daily(enriched)
    agg.write.mode("overwrite").partitionBy("year").parquet(
        os.path.join(out_dir, "daily_aggregated.parquet"))

    # semi-join on the top-k ids *before* the melt of the sample
    sample_long = melt_wide(wide.join(F.broadcast(top), "id", "left_semi"), ID_COLS)
    sample = (enrich(sample_long, cal, prices).withColumnRenamed("id", "product_id")
              .select(*SAMPLE_COLS))
    sample.write.mode("overwrite").parquet(os.path.join(out_dir, "sales_enriched_sample.parquet"))
    return verify_outputs(wide.sparkSession, out_dir)


#: every file that the jobs leave, with its columns
OUTPUTS = {
    "calendar_clean": CALENDAR_COLS,
    "daily_aggregated": [*AGG_KEYS, "total_units", "total_revenue"],
    "sales_enriched_sample": SAMPLE_COLS,
    "abc_classification": ["product_id", "store_id", "total_units_sold", "total_revenue", "revenue_pct",
                           "cumulative_pct", "abc_class", "analysis_date"],
    "inventory_recommendations": ["product_id", "store_id", "avg_daily_demand", "demand_std", "lead_time_days",
                                  "service_level_z", "safety_stock", "reorder_point", "eoq", "forecast_30d",
                                  "current_stock_proxy", "recommended_order_qty", "analysis_date"],
    "stockout_risk": ["product_id", "store_id", "current_stock_proxy", "forecast_demand_7d", "risk_score",
                      "risk_level", "days_to_stockout", "alert_date"],
    "category_forecasts": ["cat_id", "forecast_date", "predicted_demand", "lower_ci", "upper_ci"],
    "store_forecasts": ["store_id", "forecast_date", "predicted_demand", "lower_ci", "upper_ci"],
}


def run_analytics(star: Star, out_dir: str) -> dict[str, int]:
    """The tables that the inventory and forecasting analyses store, under the schema's names;
    recommendations are computed once, for two of them."""
    from mercato.plans import forecasting, inventory
    spark, today = star.sales.sparkSession, F.current_date()
    path = lambda name: os.path.join(out_dir, f"{name}.parquet")

    def write(name: str, df: DataFrame) -> None:
        df.select(*OUTPUTS[name]).write.mode("overwrite").parquet(path(name))

    write("abc_classification", inventory.abc_classification(star)
          .withColumnRenamed("total_units", "total_units_sold").withColumn("analysis_date", today))
    recs = inventory.policy_table(star)
    recs.write.mode("overwrite").parquet(path("_policy"))
    recs = spark.read.parquet(path("_policy"))
    write("inventory_recommendations", recs.withColumn("service_level_z", F.lit(inventory.Z_SCORE))
          .withColumn("analysis_date", today))
    write("stockout_risk", inventory.stockout_risk(star, recs).withColumn("alert_date", today))
    write("category_forecasts", forecasting.fc_category_90d(star))
    write("store_forecasts", forecasting.fc_store_30d(star))
    return verify_outputs(spark, out_dir)


def verify_outputs(spark, out_dir: str) -> dict[str, int]:
    """Read every output back: rows, bytes on disk, columns that are missing or too many (their
    number; 0 is right). A file that isn't there has -1 rows."""
    report = {}
    for name, columns in OUTPUTS.items():
        try:
            df = spark.read.parquet(os.path.join(out_dir, f"{name}.parquet"))
        except AnalysisException:
            report[name] = -1
            continue
        stats = df.select(F.input_file_name().alias("f"), F.col("_metadata.file_size").alias("s")) \
            .distinct().agg(F.sum("s")).collect()[0][0]
        report[name] = df.count()
        report[f"{name}_columns"] = len(df.columns)
        report[f"{name}_unexpected"] = len(set(df.columns) ^ set(columns))
        report[f"{name}_bytes"] = int(stats or 0)
    return report
