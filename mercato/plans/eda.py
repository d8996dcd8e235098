"""Exploratory tables over ``daily_aggregated`` (date x dept x store grain,
zero-filled): trends, shares, store/state totals, seasonality means,
decomposition, event and SNAP effects, year-over-year growth, store x month
matrix. The drawing is not rebuilt; these are the tables behind it.

Means follow the reference: they are over pre-aggregate *rows*
(date x dept x store), not over days, unless stated; only those means need
the zero-filled rows. Sums do not: zero rows add nothing, so the sum-only
tables aggregate the sparse fact directly and take their group sets (every
day, every year, every category-month) from the calendar.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercato.functions import calendar as cal
from mercato.functions.rounding import pd_round, ratio
from mercato.operators.dense import expand_days
from mercato.operators.pricing import with_price
from mercato.operators.timeseries import decompose, regularise
from mercato.sources.fixture import Star

WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def _totals(df: DataFrame, *keys) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum("total_units").cast("bigint").alias("total_units"),
                                 F.sum("total_revenue").alias("total_revenue"))


def _sold(star: Star) -> DataFrame:
    """Sale rows with category, state and revenue (unpriced days count 0)."""
    s = with_price(star.sales, star.calendar, star.prices, "left")
    s = s.join(star.product.select("product_id", "cat_id"), "product_id").join(star.store, "store_id")
    return s.select("date", "cat_id", "store_id", "state_id",
                    F.col("units_sold").alias("total_units"),
                    (F.col("units_sold") * F.coalesce("sell_price", F.lit(0))).alias("total_revenue"))


def _units(star: Star, *keys) -> DataFrame:
    """Units by date (and category): no price, no dimension that isn't asked for."""
    s = star.sales
    if "cat_id" in keys:
        s = s.join(star.product.select("product_id", "cat_id"), "product_id")
    return s.groupBy("date", *keys).agg(F.sum("units_sold").cast("bigint").alias("total_units"))


def _daily_units(star: Star) -> DataFrame:
    """Units for every calendar day (0 on days without sales)."""
    return star.calendar.select("date").join(_units(star), "date", "left").select(
        "date", F.coalesce("total_units", F.lit(0)).cast("bigint").alias("total_units"))


def _daily(star: Star) -> DataFrame:
    """Totals for every calendar day (0 on days without sales)."""
    sums = _totals(_sold(star), "date")
    return star.calendar.select("date").join(sums, "date", "left").select(
        "date", F.coalesce("total_units", F.lit(0)).cast("bigint").alias("total_units"),
        F.coalesce("total_revenue", F.lit(0)).alias("total_revenue"))


def eda_daily(star: Star) -> DataFrame:
    d = _daily(star)
    return d.select("date", "total_units", F.col("total_revenue").cast("double").alias("total_revenue"))


def eda_weekly(star: Star) -> DataFrame:
    """Weeks ending Sunday, labelled by that Sunday."""
    d = _daily_units(star)
    return d.groupBy(cal.week_ending_sunday(F.col("date")).alias("week_end")).agg(
        F.sum("total_units").cast("bigint").alias("total_units"))


def eda_monthly(star: Star) -> DataFrame:
    d = _daily_units(star)
    return d.groupBy(F.last_day("date").alias("month_end")).agg(
        F.sum("total_units").cast("bigint").alias("total_units"))


def eda_peak_day(star: Star) -> DataFrame:
    """Day with the most units (first such day on ties)."""
    d = _daily_units(star)
    return d.orderBy(F.desc("total_units"), "date").limit(1).select("date", "total_units")


def eda_category_share(star: Star) -> DataFrame:
    t = _totals(_sold(star), "cat_id")
    allw = Window.partitionBy()  # one row per category
    rev = F.col("total_revenue").cast("double")
    units = F.col("total_units").cast("double")
    return t.select("cat_id", "total_units", rev.alias("total_revenue"),
                    pd_round(ratio(rev, F.sum(rev).over(allw)) * 100, 1).alias("revenue_share"),
                    pd_round(ratio(units, F.sum(units).over(allw)) * 100, 1).alias("units_share"))


def eda_category_monthly(star: Star) -> DataFrame:
    units = _units(star, "cat_id")
    cats = star.series().join(star.product.select("product_id", "cat_id"), "product_id").select("cat_id").distinct()
    months = expand_days(cats, star.first_day(), star.last_day()).select(
        "cat_id", F.last_day("date").alias("month_end")).distinct()
    sums = units.groupBy("cat_id", F.last_day("date").alias("month_end")).agg(
        F.sum("total_units").cast("bigint").alias("total_units"))
    return months.join(sums, ["cat_id", "month_end"], "left").select(
        "cat_id", "month_end", F.coalesce("total_units", F.lit(0)).cast("bigint").alias("total_units"))


def eda_store_perf(star: Star) -> DataFrame:
    t = _totals(_sold(star), "store_id", "state_id")
    return t.withColumn("total_revenue", F.col("total_revenue").cast("double"))


def eda_state_revenue(star: Star) -> DataFrame:
    t = _totals(_sold(star), "state_id")
    return t.select("state_id", F.col("total_revenue").cast("double").alias("total_revenue"))


def _row_mean(star: Star, group_cols, cal_filter=None, sold_filter=None, combo_filter=None):
    """Mean of ``total_units`` over the rows of the zero-filled
    ``daily_aggregated`` (one row per day x observed dept x store), grouped
    by calendar attributes, without materialising those rows:
    sum of units / (number of dept x store combinations x days in group)."""
    cal_ = star.calendar if cal_filter is None else star.calendar.where(cal_filter)
    days = cal_.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_days"))
    sold = _sold_da(star)
    if sold_filter is not None:
        sold = sold.where(sold_filter)
    sums = (sold.join(F.broadcast(cal_.select("date", *group_cols)), "date")
            .groupBy(*group_cols).agg(F.sum("total_units").alias("_units")))
    combos = _combos(star, combo_filter)
    return (days.join(sums, list(group_cols), "left")
            .select(*group_cols, (F.coalesce("_units", F.lit(0)).cast("double")
                                  / (F.col("_days") * combos).cast("double")).alias("mean_units")))


def _sold_da(star: Star) -> DataFrame:
    s = star.sales.join(star.product.select("product_id", "dept_id", "cat_id"), "product_id")
    return s.join(star.store, "store_id").select(
        "date", "cat_id", "dept_id", "store_id", "state_id", F.col("units_sold").alias("total_units"))


def _combos(star: Star, combo_filter=None):
    """Number of observed (cat, dept, store, state) combinations (scalar)."""
    c = (star.series().join(star.product.select("product_id", "dept_id", "cat_id"), "product_id")
         .join(star.store, "store_id").select("cat_id", "dept_id", "store_id", "state_id").distinct())
    if combo_filter is not None:
        c = c.where(combo_filter)
    return c.agg(F.count(F.lit(1))).scalar()


def eda_weekday_mean(star: Star) -> DataFrame:
    """Mean units per pre-aggregate row by weekday, Monday first."""
    # all seven: a weekday without a calendar day has no mean, but keeps its place
    m = _row_mean(star, ["weekday"])
    week = star.sales.sparkSession.createDataFrame(list(enumerate(WEEKDAYS, 1)), "day_order int, weekday string")
    return F.broadcast(week).join(m, "weekday", "left").select("weekday", "day_order", "mean_units")


def eda_month_mean(star: Star) -> DataFrame:
    m = _row_mean(star, ["month"])
    return m.select("month", cal.month_short_name(F.col("month")).alias("month_name"), "mean_units")


def eda_decomposition(star: Star, period: int = 365) -> DataFrame:
    """Additive decomposition of total daily units (daily frequency,
    gaps forward-filled as in the reference)."""
    d = _daily_units(star).select(F.lit("total").alias("series_id"), "date",
                            F.col("total_units").alias("y"))
    d = regularise(d, ["series_id"], "date", "y", fill="ffill")
    out = decompose(d, ["series_id"], "date", "y", period)
    return out.select("series_id", "date", *[F.round(c, 6).alias(c) for c in
                                             ("observed", "trend", "seasonal", "resid")])


def eda_top_events(star: Star, k: int = 15) -> DataFrame:
    """Top events by units (sum over all rows of event days), with the mean
    units of a non-event row alongside."""
    normal = _row_mean(star, ["is_event"], cal_filter=~F.col("is_event")).agg(
        F.first("mean_units")).scalar()
    ev_days = F.broadcast(star.calendar.where(F.col("event_name_1").isNotNull())
                          .select("date", "event_name_1"))
    ev = (_sold_da(star).join(ev_days, "date").groupBy("event_name_1")
          .agg(F.sum("total_units").cast("bigint").alias("total_units")))
    # an event day without any sale still counts, with 0 units
    names = star.calendar.where(F.col("event_name_1").isNotNull()).select("event_name_1").distinct()
    ev = names.join(ev, "event_name_1", "left").select(
        "event_name_1", F.coalesce("total_units", F.lit(0)).cast("bigint").alias("total_units"))
    return (ev.orderBy(F.desc("total_units"), "event_name_1").limit(k)
            .withColumn("no_event_row_mean", normal))


def eda_snap_lift(star: Star) -> DataFrame:
    """FOODS: mean units per pre-aggregate row on SNAP vs non-SNAP days, by
    state -- (units on flagged days) / (FOODS dept x store combinations of
    the state x flagged days), in one pass over the sales."""
    def by_state(prefix: str):
        arms = None
        for st in cal.STATES:
            cond = F.col("state_id") == st
            val = F.col(f"{prefix}{st}")
            arms = F.when(cond, val) if arms is None else arms.when(cond, val)
        return arms

    c = star.calendar.select("date", *[f"snap_{st}" for st in cal.STATES])
    foods = _sold_da(star).where(F.col("cat_id") == "FOODS").join(F.broadcast(c), "date")
    snap = by_state("snap_")
    sums = foods.groupBy("state_id").agg(
        F.sum(F.when(snap == 1, F.col("total_units"))).alias("u_on"),
        F.sum(F.when(snap == 0, F.col("total_units"))).alias("u_off"))
    combos = (star.series().join(star.product.select("product_id", "dept_id", "cat_id"), "product_id")
              .join(star.store, "store_id").where(F.col("cat_id") == "FOODS")
              .select("dept_id", "store_id", "state_id").distinct()
              .groupBy("state_id").agg(F.count(F.lit(1)).alias("n")))
    days = star.calendar.agg(F.struct(*[
        F.count_if(F.col(f"snap_{st}") == v).alias(f"{k}{st}")
        for st in cal.STATES for v, k in ((1, "on_"), (0, "off_"))]).alias("d")).scalar()
    on_days = None
    off_days = None
    for st in cal.STATES:
        cond = F.col("state_id") == st
        on_days = (F.when(cond, days.getField(f"on_{st}")) if on_days is None
                   else on_days.when(cond, days.getField(f"on_{st}")))
        off_days = (F.when(cond, days.getField(f"off_{st}")) if off_days is None
                    else off_days.when(cond, days.getField(f"off_{st}")))
    g = combos.join(sums, "state_id", "left").select(
        "state_id",
        (F.coalesce("u_on", F.lit(0)).cast("double")
         / F.nullif((F.col("n") * on_days).cast("double"), F.lit(0.0))).alias("snap_day"),
        (F.coalesce("u_off", F.lit(0)).cast("double")
         / F.nullif((F.col("n") * off_days).cast("double"), F.lit(0.0))).alias("non_snap_day"))
    return g.withColumn("lift_pct", ratio(F.col("snap_day") - F.col("non_snap_day"), F.col("non_snap_day")) * 100)


def eda_yoy(star: Star) -> DataFrame:
    t = _totals(_daily(star).withColumn("year", F.year("date")), "year")
    w = Window.orderBy("year")  # one row per year
    u = F.col("total_units").cast("double")
    r = F.col("total_revenue").cast("double")
    return t.select("year", "total_units", r.alias("total_revenue"),
                    (ratio(u - F.lag(u).over(w), F.lag(u).over(w)) * 100).alias("yoy_units_growth"),
                    (ratio(r - F.lag(r).over(w), F.lag(r).over(w)) * 100).alias("yoy_rev_growth"))


def eda_store_month_pivot(star: Star) -> DataFrame:
    """Store x month revenue in $ millions (months Jan..Dec as columns)."""
    s = _sold(star).withColumn("month", F.month("date"))
    p = (s.groupBy("store_id").pivot("month", list(range(1, 13)))
         .agg(F.sum("total_revenue")))
    # a month without sales is a zero-revenue month (every store has a row
    # for every calendar day in the dense data)
    return p.select("store_id", *[F.round(F.coalesce(F.col(str(m)), F.lit(0)).cast("double") / 1e6, 6)
                                  .alias(name) for m, name in zip(range(1, 13), MONTHS)])
