"""Adapter: TPC-H-shaped test tables -> M5-shaped retail star schema.

Mapping (all derived by Spark from the given tables, so the work grows with
them):

* product  = ``p_brand || '_' || p_type`` (item_id = product_id),
  dept = brand, category by brand number 1-8 FOODS, 9-16 HOUSEHOLD,
  17-25 HOBBIES.
* store    = the supplier's nation name, state = CA/TX/WI by
  ``n_regionkey % 3``.
* calendar = every day from the first to the last ship date.
* sales    = ``SUM(l_quantity)`` per (ship date, product, store): the
  *sparse* fact (only days with a sale). The reference's fact is *dense*
  (a row with 0 units for every day of every series); the plans reproduce
  dense semantics from the sparse fact plus day counts (see
  ``operators.dense``) and only expand to dense rows where rows are output.
* prices   = weekly average ``SUM(l_extendedprice) / SUM(l_quantity)``
  rounded half-up to cents, as DECIMAL(10,2), per (store, product, week);
  weeks without a sale have no price.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.functions import calendar as cal
from mercato.operators.pricing import with_price
from mercato.sources.testdata import read_table


@dataclass
class Star:
    """The retail star schema (column names follow the relational schema)."""

    calendar: DataFrame  # dim_calendar
    product: DataFrame   # dim_product(product_id, item_id, dept_id, cat_id)
    store: DataFrame     # dim_store(store_id, state_id)
    sales: DataFrame     # fact_sales(date, product_id, store_id, units_sold): sparse or dense
    prices: DataFrame    # fact_prices(store_id, product_id, wm_yr_wk, sell_price)
    wide: DataFrame | None = None  # the wide daily file, when materialised
    series_ids: DataFrame | None = None  # all series, where some have no row in ``sales``
    files: str | None = None  # folder of the wide file with series that never sold (plans.files)

    # -- scalar helpers (uncorrelated scalar subqueries, planned JVM-side) --
    def n_days(self):
        return self.calendar.agg(F.count(F.lit(1))).scalar()

    def first_day(self):
        return self.calendar.agg(F.min("date")).scalar()

    def last_day(self):
        return self.calendar.agg(F.max("date")).scalar()

    def series(self) -> DataFrame:
        """(product_id, store_id) series: the rows of the wide file, those that never
        sold included."""
        if self.series_ids is not None:
            return self.series_ids
        return self.sales.select("product_id", "store_id").distinct()

    def sold(self) -> DataFrame:
        """Rows with a sale; a dense fact also holds a row for each day without."""
        return self.sales.where(F.col("units_sold") > 0)


def calendar_from_bounds(bounds: DataFrame) -> DataFrame:
    """``dim_calendar`` for the day range of a one-row (start, end) frame."""
    days = bounds.select(
        F.col("start").alias("first"),
        F.explode(F.sequence(F.col("start"), F.col("end"))).alias("date"))
    d = F.col("date")
    return days.select(
        d,
        cal.wm_yr_wk(d).alias("wm_yr_wk"),
        F.date_format(d, "EEEE").alias("weekday"),
        cal.m5_wday(d).alias("wday"),
        F.month(d).alias("month"),
        F.year(d).alias("year"),
        F.concat(F.lit("d_"), (F.datediff(d, F.col("first")) + 1).cast("string")).alias("d"),
        cal.event_name(d).alias("event_name_1"),
        cal.event_type(d).alias("event_type_1"),
        F.lit(None).cast("string").alias("event_name_2"),
        F.lit(None).cast("string").alias("event_type_2"),
        cal.snap_flag(d, "CA").alias("snap_CA"),
        cal.snap_flag(d, "TX").alias("snap_TX"),
        cal.snap_flag(d, "WI").alias("snap_WI"),
        cal.m5_wday(d).isin(1, 2).alias("is_weekend"),
        cal.event_name(d).isNotNull().alias("is_event"),
    )


def product_dim(part: DataFrame) -> DataFrame:
    brand_no = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int")
    return (
        part.select(F.concat_ws("_", "p_brand", "p_type").alias("product_id"),
                    F.col("p_brand").alias("dept_id"), brand_no.alias("brand_no"))
        .distinct()
        .select("product_id", F.col("product_id").alias("item_id"), "dept_id",
                F.when(F.col("brand_no") <= 8, "FOODS")
                .when(F.col("brand_no") <= 16, "HOUSEHOLD")
                .otherwise("HOBBIES").alias("cat_id"))
    )


def store_dim(nation: DataFrame) -> DataFrame:
    return nation.select(
        F.col("n_name").alias("store_id"),
        F.element_at(F.array(*[F.lit(s) for s in cal.STATES]),
                     (F.col("n_regionkey") % 3 + 1).cast("int")).alias("state_id"))


def star_from_testdata(spark: SparkSession, sf_dir: str) -> Star:
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    part = read_table(spark, sf_dir, "part").select(
        "p_partkey", F.concat_ws("_", "p_brand", "p_type").alias("product_id"))
    supplier = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    # nation has 25 rows by the TPC-H definition: a bounded broadcast.
    nation = read_table(spark, sf_dir, "nation")
    supp_store = supplier.join(
        F.broadcast(nation.select(F.col("n_nationkey"), F.col("n_name").alias("store_id"))),
        F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "store_id")

    # One pass over lineitem: per (day, product, store) units and cents.
    # part / supplier are joined on their keys, hashed by partition: lineitem isn't
    # sorted (and spilled) for them once they are too large to be broadcast.
    daily = (
        li.join(part.hint("shuffle_hash"), F.col("l_partkey") == F.col("p_partkey"))
        .join(supp_store.hint("shuffle_hash"), F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(F.to_date("l_shipdate").alias("date"), "product_id", "store_id")
        .agg(F.sum("l_quantity").cast("bigint").alias("qty"),
             F.sum(F.round(F.col("l_extendedprice") * 100)).cast("bigint").alias("cents"))
    )
    # sales, prices and the calendar bounds all derive from this aggregate;
    # within one query Spark reuses the identical exchange, across jobs
    # (materialize_star) the cache avoids re-scanning lineitem. A lost
    # cached block is recomputed from lineage.
    daily = daily.persist(StorageLevel.MEMORY_AND_DISK)
    sales = daily.select("date", "product_id", "store_id",
                         F.col("qty").cast("int").alias("units_sold"))

    weekly = (daily.groupBy("store_id", "product_id", cal.wm_yr_wk(F.col("date")).alias("wm_yr_wk"))
              .agg(F.sum("cents").alias("cents"), F.sum("qty").alias("qty")))
    # average price in cents, rounded half up with integer arithmetic
    price_cents = F.expr("(2 * cents + qty) div (2 * qty)")
    prices = weekly.select(
        "store_id", "product_id", "wm_yr_wk",
        (price_cents.cast("decimal(20,0)") * F.lit(0.01).cast("decimal(3,2)"))
        .cast("decimal(10,2)").alias("sell_price"))

    bounds = daily.agg(F.min("date").alias("start"), F.max("date").alias("end"))
    calendar = calendar_from_bounds(bounds)

    return Star(
        calendar=calendar,
        product=product_dim(read_table(spark, sf_dir, "part")),
        store=store_dim(nation),
        sales=sales,
        prices=prices,
    )


def materialize_star(star: Star, path: str, with_wide: bool = True) -> Star:
    """Write the five star tables as parquet under ``path`` (a folder on
    shared storage) and return a Star that reads them back: the ETL step
    that the KPI queries then share, and a lineage cut. ``with_wide`` also
    writes the wide daily file (the raw input of the melt ETL and audit)."""
    import os
    spark = star.sales.sparkSession
    # the fact is stored with its week and price, so that no query joins them again, and in
    # ranges of days: a query over the last weeks skips the other files' row groups
    priced = with_price(star.sales, star.calendar, star.prices, "left").select(
        "date", "product_id", "store_id", "units_sold", "wm_yr_wk", "sell_price")
    tables = {"dim_calendar": star.calendar, "dim_product": star.product, "dim_store": star.store,
              "fact_sales": priced.repartitionByRange("date").sortWithinPartitions("date"),
              "fact_prices": star.prices}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(os.path.join(path, name))
    read = {name: spark.read.parquet(os.path.join(path, name)) for name in tables}
    out = Star(calendar=read["dim_calendar"], product=read["dim_product"], store=read["dim_store"],
               sales=read["fact_sales"], prices=read["fact_prices"])
    if with_wide:
        from mercato.sources.wide import build_wide
        build_wide(out).write.mode("overwrite").parquet(os.path.join(path, "sales_wide"))
        out.wide = spark.read.parquet(os.path.join(path, "sales_wide"))
    return out
