"""The 30 KPI queries and 3 bonus queries of the SQL analytics layer.

Every function takes a :class:`~mercato.sources.fixture.Star` and returns a
lazy DataFrame. Semantics follow the relational definitions over the dense
fact (a row per day and series); see ``operators.dense`` for how dense
aggregates are computed from the sparse fact. Output types: counts and unit
sums BIGINT, money and ratios DOUBLE (rounded as the SQL rounds), dates DATE.
Ordering/limits keep the SQL order keys plus unique tie keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercato.functions import calendar as cal
from mercato.functions.rounding import money, ratio
from mercato.operators.dense import dense_mean, dense_rows, dense_std, expand_days, series_moments
from mercato.operators.pricing import week_days, with_price
from mercato.sources.fixture import Star


def _units_sum(c="units_sold"):
    return F.sum(c).cast("bigint")


def _sold(star: Star, how: str = "inner") -> DataFrame:
    """Sale rows (units > 0) with price."""
    return with_price(star.sold(), star.calendar, star.prices, how)


def _with_dims(df: DataFrame, star: Star, product_cols=("cat_id",), store_cols=()) -> DataFrame:
    if product_cols:
        df = df.join(star.product.select("product_id", *product_cols), "product_id")
    if store_cols:
        df = df.join(star.store.select("store_id", *store_cols), "store_id")
    return df


def _share(col: str, n: int = 2):
    """``ROUND(x / SUM(x) OVER () * 100, n)`` over an already-aggregated
    (bounded) frame."""
    return F.round(ratio(F.col(col), F.sum(F.col(col).cast("double")).over(Window.partitionBy())) * 100, n)


# ---------------------------------------------------------------- core KPIs

def kpi01_totals(star: Star) -> DataFrame:
    s = _sold(star, "left")
    return s.agg(
        F.count(F.lit(1)).alias("total_transactions"),
        _units_sum().alias("total_units_sold"),
        money(F.sum("revenue")).alias("total_revenue"),
        money(F.avg("sell_price")).alias("avg_sell_price"),
        F.min("date").alias("data_start_date"),
        F.max("date").alias("data_end_date"))


def kpi02_monthly_revenue(star: Star) -> DataFrame:
    c = star.calendar
    months = c.groupBy("year", "month").agg(cal.month_label(F.min("date")).alias("month_label"))
    sold = _sold(star, "left").join(F.broadcast(c.select("date", "year", "month")), "date")
    sums = sold.groupBy("year", "month").agg(_units_sum().alias("total_units"),
                                             F.sum("revenue").alias("rev"))
    # dense rows carry the week's price on every day: price-days per month
    wm = c.groupBy("wm_yr_wk", "year", "month").agg(F.count(F.lit(1)).alias("nd"))
    pd_ = (star.prices.join(F.broadcast(wm), "wm_yr_wk")
           .groupBy("year", "month")
           .agg(F.sum(F.col("sell_price") * F.col("nd")).alias("price_days"),
                F.sum("nd").alias("nd")))
    out = months.join(sums, ["year", "month"], "left").join(pd_, ["year", "month"], "left")
    rev = F.when(F.col("nd") > 0, F.coalesce("rev", F.lit(0))).otherwise(F.col("rev"))
    return out.select(
        "year", "month", "month_label",
        F.coalesce("total_units", F.lit(0)).cast("bigint").alias("total_units"),
        money(rev).alias("monthly_revenue"),
        money(F.col("price_days") / F.col("nd")).alias("avg_price"))


def kpi03_yoy_revenue(star: Star) -> DataFrame:
    years = star.calendar.select("year").distinct()
    sold = _sold(star, "left").join(F.broadcast(star.calendar.select("date", "year")), "date")
    yearly = years.join(sold.groupBy("year").agg(F.round(F.sum("revenue"), 2).alias("revenue")),
                        "year", "left")
    w = Window.orderBy("year")  # one row per year: bounded single-partition window
    prev = F.lag("revenue").over(w)
    return yearly.select(
        "year", F.col("revenue").cast("double").alias("revenue"),
        prev.cast("double").alias("prev_year_revenue"),
        F.round(ratio(F.col("revenue") - prev, prev) * 100, 2).alias("yoy_growth_pct"))


def kpi04_weekly_sales(star: Star, days: int = 84) -> DataFrame:
    c = star.calendar
    cutoff = F.date_sub(star.last_day(), days)
    recent = c.where(F.col("date") >= cutoff)
    weeks = recent.groupBy("wm_yr_wk").agg(F.min("date").alias("week_start_date"))
    sold = _sold(star, "left").where(F.col("date") >= cutoff)
    sums = sold.groupBy("wm_yr_wk").agg(_units_sum().alias("units"), F.sum("revenue").alias("rev"))
    priced_weeks = star.prices.select("wm_yr_wk").distinct().withColumn("priced", F.lit(True))
    out = weeks.join(sums, "wm_yr_wk", "left").join(priced_weeks, "wm_yr_wk", "left")
    rev = F.when(F.col("priced"), F.coalesce("rev", F.lit(0))).otherwise(F.col("rev"))
    return out.select("wm_yr_wk", "week_start_date",
                      F.coalesce("units", F.lit(0)).cast("bigint").alias("total_units"),
                      money(rev).alias("weekly_revenue"))


# ------------------------------------------------------------ product KPIs

def kpi05_top_units(star: Star, k: int = 20) -> DataFrame:
    s = _with_dims(_sold(star, "left"), star, ("dept_id", "cat_id"))
    g = s.groupBy("product_id", "dept_id", "cat_id").agg(
        _units_sum().alias("total_units_sold"),
        money(F.sum("revenue")).alias("total_revenue"))
    # the fact has a row for each series, sold or not
    stores = star.series().groupBy("product_id").agg(F.count_distinct("store_id").alias("stores_selling"))
    top = g.orderBy(F.desc("total_units_sold"), "product_id").limit(k)
    return top.join(stores, "product_id").select(*g.columns, "stores_selling")


def kpi06_top_revenue(star: Star, k: int = 20) -> DataFrame:
    s = _with_dims(_sold(star), star, ("cat_id", "dept_id"))
    g = s.groupBy("product_id", "cat_id", "dept_id").agg(
        F.sum("revenue").alias("rev"), _units_sum().alias("total_units"),
        money(F.avg("sell_price")).alias("avg_price"))
    return (g.orderBy(F.desc("rev"), "product_id").limit(k)
            .select("product_id", "cat_id", "dept_id", money(F.col("rev")).alias("total_revenue"),
                    "total_units", "avg_price"))


def kpi07_bottom_revenue(star: Star, k: int = 20) -> DataFrame:
    s = _with_dims(_sold(star), star, ("cat_id",))
    g = s.groupBy("product_id", "cat_id").agg(F.sum("revenue").alias("rev"),
                                             _units_sum().alias("total_units"))
    # COUNT(DISTINCT date) over the dense priced rows = days of the weeks
    # in which the product has a price in any store.
    days = (star.prices.select("product_id", "wm_yr_wk").distinct()
            .join(F.broadcast(week_days(star.calendar)), "wm_yr_wk")
            .groupBy("product_id").agg(F.sum("week_days").cast("bigint").alias("days_with_sales")))
    return (g.where(F.col("total_units") > 0).join(days, "product_id")
            .orderBy(F.asc("rev"), "product_id").limit(k)
            .select("product_id", "cat_id", money(F.col("rev")).alias("total_revenue"),
                    "total_units", "days_with_sales"))


# ----------------------------------------------------------- category KPIs

def kpi08_category_revenue(star: Star) -> DataFrame:
    s = _with_dims(_sold(star), star, ("cat_id",))
    g = s.groupBy("cat_id").agg(_units_sum().alias("total_units"), F.sum("revenue").alias("rev"),
                                F.count_distinct("product_id").alias("unique_products"))
    return g.select("cat_id", "total_units", money(F.col("rev")).alias("total_revenue"),
                    _share("rev").alias("revenue_share_pct"), "unique_products")


def kpi09_department_revenue(star: Star) -> DataFrame:
    s = _with_dims(_sold(star), star, ("cat_id", "dept_id"))
    return s.groupBy("cat_id", "dept_id").agg(_units_sum().alias("total_units"),
                                             money(F.sum("revenue")).alias("total_revenue"))


def _cat_spine_sums(star: Star, grain_cols, grain_exprs) -> DataFrame:
    """Dense (grain x category) unit sums: every category with an observed
    series appears for every calendar period, zero-filled."""
    cats = _with_dims(star.series(), star, ("cat_id",)).select("cat_id").distinct()
    spine = expand_days(cats, star.first_day(), star.last_day()).select(
        "cat_id", *[e.alias(n) for n, e in zip(grain_cols, grain_exprs)]).distinct()
    sold = _with_dims(star.sold(), star, ("cat_id",))
    sums = sold.groupBy("cat_id", *[e.alias(n) for n, e in zip(grain_cols, grain_exprs)]).agg(
        _units_sum().alias("units"))
    keys = ["cat_id", *grain_cols]
    return spine.join(sums, keys, "left").withColumn(
        "units", F.coalesce("units", F.lit(0)).cast("bigint"))


def kpi10_monthly_category(star: Star) -> DataFrame:
    d = F.col("date")
    g = _cat_spine_sums(star, ["year", "month"], [F.year(d), F.month(d)])
    return g.select("year", "month", "cat_id", F.col("units").alias("total_units"))


# --------------------------------------------------------------- store KPIs

def _store_rev(star: Star) -> DataFrame:
    return _with_dims(_sold(star), star, (), ("state_id",))


def kpi11_store_revenue(star: Star) -> DataFrame:
    g = _store_rev(star).groupBy("store_id", "state_id").agg(
        _units_sum().alias("total_units"), F.sum("revenue").alias("rev"),
        F.count_distinct("product_id").alias("active_skus"))
    return g.select("store_id", "state_id", "total_units", money(F.col("rev")).alias("total_revenue"),
                    _share("rev").alias("store_revenue_share_pct"), "active_skus")


def kpi12_state_revenue(star: Star) -> DataFrame:
    return _store_rev(star).groupBy("state_id").agg(
        F.count_distinct("store_id").alias("num_stores"), _units_sum().alias("total_units"),
        money(F.sum("revenue")).alias("total_revenue"))


def kpi13_store_ranking(star: Star) -> DataFrame:
    g = _store_rev(star).groupBy("store_id", "state_id").agg(
        F.round(F.sum("revenue"), 2).alias("total_revenue"))
    return g.select(
        "store_id", "state_id", F.col("total_revenue").cast("double").alias("total_revenue"),
        F.rank().over(Window.orderBy(F.desc("total_revenue"))).alias("revenue_rank"),
        F.rank().over(Window.partitionBy("state_id").orderBy(F.desc("total_revenue")))
        .alias("rank_within_state"))


# --------------------------------------------------------- seasonality KPIs

def _daily_units(star: Star) -> DataFrame:
    """Dense daily totals: every calendar day, zero-filled."""
    sums = star.sales.groupBy("date").agg(_units_sum().alias("daily_units"))
    return star.calendar.join(sums, "date", "left").withColumn(
        "daily_units", F.coalesce("daily_units", F.lit(0)).cast("bigint"))


def kpi14_weekday(star: Star) -> DataFrame:
    c = star.calendar
    # days of the inner price join: days of weeks with any price row
    priced_weeks = star.prices.select("wm_yr_wk").distinct()
    days = c.join(priced_weeks, "wm_yr_wk", "left_semi")
    sums = _sold(star).groupBy("date").agg(_units_sum().alias("u"), F.sum("revenue").alias("r"))
    daily = days.join(sums, "date", "left").select(
        "weekday", "wday", F.coalesce("u", F.lit(0)).alias("daily_units"),
        F.coalesce("r", F.lit(0)).alias("daily_revenue"))
    return daily.groupBy("weekday", "wday").agg(
        F.round(F.avg("daily_units"), 2).alias("avg_daily_units"),
        money(F.avg("daily_revenue")).alias("avg_daily_revenue"))


def kpi15_month_seasonality(star: Star) -> DataFrame:
    monthly = (_daily_units(star).groupBy("year", "month")
               .agg(F.sum("daily_units").alias("monthly_units")))
    # the reference's join to the calendar on month repeats every (year,
    # month) row equally often, so it leaves the average unchanged: dropped.
    return monthly.groupBy("month").agg(
        F.round(F.avg("monthly_units"), 0).alias("avg_monthly_units")).select(
        "month", cal.month_name_padded(F.col("month")).alias("month_name"), "avg_monthly_units")


def kpi16_event_lift(star: Star, grain: str = "row") -> DataFrame:
    """Event-day average of daily totals vs the normal-day average.

    ``grain='row'`` (as written in the SQL): the normal average is over
    dense fact rows (series x day), so it is far below a daily total and
    the lift is inflated. ``grain='day'`` compares like with like: the
    average of daily totals on non-event days."""
    c = star.calendar
    daily = _daily_units(star)
    normal_days = c.where(~F.col("is_event")).select("date")
    normal_units = star.sales.join(F.broadcast(normal_days), "date").agg(
        F.sum("units_sold")).scalar()
    n_normal_days = normal_days.agg(F.count(F.lit(1))).scalar()
    if grain == "day":
        normal = normal_units.cast("double") / n_normal_days.cast("double")
    else:
        # AVG(units_sold) over dense rows of non-event days
        n_series = star.series().agg(F.count(F.lit(1))).scalar()
        normal = normal_units.cast("double") / (n_series * n_normal_days).cast("double")
    ev = daily.where(F.col("event_name_1").isNotNull()).groupBy("event_name_1", "event_type_1").agg(
        F.count_distinct("date").alias("event_days"), F.avg("daily_units").alias("avg_ev"))
    return ev.select(
        F.col("event_name_1").alias("event_name"), F.col("event_type_1").alias("event_type"),
        "event_days", F.round("avg_ev", 0).alias("avg_daily_units_on_event"),
        F.round(normal, 0).alias("avg_daily_units_normal"),
        F.round(ratio(F.col("avg_ev") - normal, normal) * 100, 2).alias("pct_lift_vs_normal"))


def kpi17_snap_foods(star: Star) -> DataFrame:
    foods = _with_dims(star.sales, star, ("cat_id",), ("state_id",)).where(F.col("cat_id") == "FOODS")
    states = (_with_dims(star.series(), star, ("cat_id",), ("state_id",))
              .where(F.col("cat_id") == "FOODS").select("state_id").distinct())
    grid = expand_days(states, star.first_day(), star.last_day())
    sums = foods.groupBy("date", "state_id").agg(_units_sum().alias("u"))
    c = star.calendar.select("date", "snap_CA", "snap_TX", "snap_WI")
    daily = grid.join(sums, ["date", "state_id"], "left").join(F.broadcast(c), "date")
    snap = F.when(F.col("state_id") == "CA", F.col("snap_CA")).when(
        F.col("state_id") == "TX", F.col("snap_TX")).when(F.col("state_id") == "WI", F.col("snap_WI"))
    return (daily.select("state_id", snap.alias("is_snap_day"),
                         F.coalesce("u", F.lit(0)).alias("daily_food_units"))
            .groupBy("state_id", "is_snap_day")
            .agg(F.round(F.avg("daily_food_units"), 2).alias("avg_daily_food_units")))


# --------------------------------------------------------------- price KPIs

def kpi18_price_distribution(star: Star) -> DataFrame:
    p = _with_dims(star.prices, star, ("cat_id",))
    price = F.col("sell_price")
    return p.groupBy("cat_id").agg(
        money(F.min(price)).alias("min_price"), money(F.avg(price)).alias("avg_price"),
        money(F.max(price)).alias("max_price"),
        F.round(F.stddev_samp(price.cast("double")), 2).alias("price_std_dev"),
        F.round(F.percentile(price.cast("double"), 0.5), 4).alias("median_price"))


def kpi19_price_volatility(star: Star, k: int = 20, min_changes: int = 3) -> DataFrame:
    # one row per (series, week): the window partition is bounded by the
    # number of weeks, whatever the data volume.
    w = Window.partitionBy("product_id", "store_id").orderBy("wm_yr_wk")
    p = star.prices.withColumn("prev_price", F.lag("sell_price").over(w))
    changed = (F.col("prev_price").isNotNull() & (F.col("sell_price") != F.col("prev_price")))
    g = p.groupBy("product_id", "store_id").agg(
        F.count_if(changed).alias("num_price_changes"), F.count(F.lit(1)).alias("n"))
    return (g.where(F.col("num_price_changes") > min_changes)
            .select("product_id", "store_id", "num_price_changes",
                    F.round(ratio(F.col("num_price_changes"), F.col("n") - 1) * 100, 2)
                    .alias("pct_weeks_with_price_change"))
            .orderBy(F.desc("num_price_changes"), "product_id", "store_id").limit(k))


def kpi20_price_demand_corr(star: Star) -> DataFrame:
    s = _with_dims(_sold(star), star, ("cat_id",))
    return s.groupBy("cat_id").agg(
        F.round(F.corr(F.col("sell_price").cast("double"), F.col("units_sold").cast("double")), 4)
        .alias("price_demand_correlation"))


# -------------------------------------------------- variability and growth

def kpi25_demand_cv(star: Star) -> DataFrame:
    m = _with_dims(series_moments(star.sales, star.n_days(), series=star.series_ids), star, ("cat_id",))
    mean, std = dense_mean(), dense_std()
    cv = std / F.nullif(mean, F.lit(0.0))
    return (m.where(mean > 0).select(
        "product_id", "store_id", "cat_id",
        F.round(mean, 2).alias("avg_daily_demand"), F.round(std, 2).alias("std_daily_demand"),
        F.round(cv * 100, 2).alias("cv_pct"),
        F.when(cv > 1.0, "HIGH VARIABILITY").when(cv > 0.5, "MEDIUM VARIABILITY")
        .otherwise("LOW VARIABILITY").alias("variability_class")))


def kpi26_mom_category(star: Star) -> DataFrame:
    g = _cat_spine_sums(star, ["month"], [F.trunc(F.col("date"), "month")])
    w = Window.partitionBy("cat_id").orderBy("month")  # bounded: months per category
    prev = F.lag("units").over(w)
    return g.select("cat_id", "month", F.col("units").alias("monthly_units"),
                    prev.alias("prev_month_units"),
                    F.round(ratio(F.col("units") - prev, prev) * 100, 2).alias("mom_growth_pct"))


def kpi27_cumulative_revenue(star: Star) -> DataFrame:
    daily = _sold(star).groupBy("date").agg(F.round(F.sum("revenue"), 2).alias("daily_revenue"))
    # one row per day: a single-partition running window over a bounded frame
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return daily.select("date", F.col("daily_revenue").cast("double").alias("daily_revenue"),
                        F.sum("daily_revenue").over(w).cast("double").alias("cumulative_revenue"))


def kpi28_category_pairs(star: Star) -> DataFrame:
    """Days (date, store) on which both categories sold.

    Instead of a self-join of (date, store, cat) rows, each (date, store)
    is reduced to its sorted category set, the sets are counted (at most
    2^|categories| distinct sets), and pairs are expanded only from the
    distinct sets, weighted by their counts."""
    s = _with_dims(star.sold(), star, ("cat_id",))
    sets = (s.groupBy("date", "store_id").agg(F.sort_array(F.collect_set("cat_id")).alias("cats"))
            .groupBy("cats").agg(F.count(F.lit(1)).alias("days")))
    pairs = sets.select(
        "days",
        F.explode(F.expr(
            "flatten(transform(cats, (a, i) -> transform(slice(cats, i + 2, size(cats)), "
            "b -> named_struct('category_1', a, 'category_2', b))))")).alias("p"))
    return (pairs.groupBy(F.col("p.category_1").alias("category_1"),
                          F.col("p.category_2").alias("category_2"))
            .agg(F.sum("days").cast("bigint").alias("co_occurrence_days")))


def kpi29_zero_sales(star: Star, k: int = 20, threshold: float = 0.3) -> DataFrame:
    m = _with_dims(series_moments(star.sales, star.n_days(), series=star.series_ids), star, ("cat_id",))
    zero = F.col("n") - F.col("nz")
    return (m.where(zero.cast("double") / F.col("n") > threshold)
            .select("product_id", "store_id", "cat_id", zero.alias("zero_sale_days"),
                    F.col("n").alias("total_days"),
                    F.round(zero.cast("double") / F.col("n") * 100, 2).alias("zero_sale_pct"))
            .orderBy(F.desc("zero_sale_pct"), "product_id", "store_id").limit(k))


# ------------------------------------------------------------------ bonus

def bonus1_top5_per_store(star: Star, k: int = 5) -> DataFrame:
    g = _with_dims(star.sales, star, ("cat_id",)).groupBy("store_id", "product_id", "cat_id").agg(
        _units_sum().alias("total_units"))
    # partition = one store's products (bounded by the catalogue); Catalyst
    # inserts a WindowGroupLimit before the shuffle for the rank filter.
    r = F.rank().over(Window.partitionBy("store_id").orderBy(F.desc("total_units")))
    return g.withColumn("rank_in_store", r).where(F.col("rank_in_store") <= k)


def bonus2_demand_spikes(star: Star, k: int = 50, z: float = 3.0) -> DataFrame:
    m = series_moments(star.sales, star.n_days(), series=star.series_ids)
    stats = m.select("product_id", "store_id", dense_mean().alias("mean"), dense_std().alias("std"))
    zs = (F.col("units_sold") - F.col("mean")) / F.nullif(F.col("std"), F.lit(0.0))
    sold = star.sold().join(stats, ["product_id", "store_id"]).select(
        "date", "product_id", "store_id", "units_sold", "mean", zs.alias("z"))
    # zero days qualify only for series whose mean exceeds z standard
    # deviations; expand just those series' days (usually none).
    hot = stats.where(F.col("mean") / F.nullif(F.col("std"), F.lit(0.0)) > z)
    zeros = (dense_rows(star.sales, hot, star.first_day(), star.last_day())
             .where(F.col("units_sold") == 0)
             .join(hot, ["product_id", "store_id"])
             .select("date", "product_id", "store_id", "units_sold", "mean", zs.alias("z")))
    rows = sold.unionByName(zeros).where(F.abs("z") > z)
    # |z| is compared at 1e-9: series with equal (n, sum, sum of squares)
    # tie exactly in real arithmetic and must fall to the tie keys.
    return (rows.orderBy(F.desc(F.round(F.abs("z"), 9)), "date", "product_id", "store_id").limit(k)
            .select("date", "product_id", "store_id", "units_sold",
                    F.round("mean", 2).alias("mean_demand"), F.round("z", 2).alias("z_score")))


def bonus3_store_category_share(star: Star) -> DataFrame:
    s = _with_dims(_sold(star), star, ("cat_id",))
    g = s.groupBy("store_id", "cat_id").agg(F.round(F.sum("revenue"), 2).alias("rev"))
    return g.select("store_id", "cat_id", F.col("rev").cast("double").alias("total_revenue"),
                    _share("rev").alias("pct_of_total_revenue"))


# ------------------------------------------------------------------ views

VIEW_COLUMNS = ["date", "year", "month", "weekday", "is_weekend", "is_event", "event_name_1", "snap_CA", "snap_TX",
                "snap_WI", "product_id", "dept_id", "cat_id", "store_id", "state_id", "units_sold"]


def _view_rows(star: Star, dense: DataFrame) -> DataFrame:
    c = star.calendar.select("date", "year", "month", "weekday", "is_weekend", "is_event",
                             "event_name_1", "snap_CA", "snap_TX", "snap_WI")
    return (dense.join(F.broadcast(c), "date")
            .join(star.product.select("product_id", "dept_id", "cat_id"), "product_id")
            .join(star.store, "store_id"))


def view_daily_sales(star: Star) -> DataFrame:
    """``vw_daily_sales`` over the dense fact (no surrogate id)."""
    dense = dense_rows(star.sales, star.series(), star.first_day(), star.last_day())
    return _view_rows(star, dense).select(*VIEW_COLUMNS)


def view_daily_sales_revenue(star: Star) -> DataFrame:
    """The view + weekly price and revenue (money reported as DOUBLE, exact
    for cents)."""
    dense = dense_rows(star.sales, star.series(), star.first_day(), star.last_day(),
                       prices=star.prices, calendar=star.calendar)
    price = F.col("sell_price")
    return _view_rows(star, dense).select(*VIEW_COLUMNS, price.cast("double").alias("sell_price"),
                                          (F.col("units_sold") * price).cast("double").alias("revenue"))
