"""Forecasting plans: holiday table, per-series daily demand, grouped model
fit (``applyInPandas``), holdout metrics, seasonal-naive baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.functions.rounding import pd_round
from mercato.operators.dense import expand_days
from mercato.operators.forecast import forecast_group
from mercato.operators.forecast_shared import factor, forecast_all
from mercato.operators.regression import linear_trend
from mercato.sources.fixture import Star

CATEGORY_HORIZON = 90
STORE_HORIZON = 30


def holiday_table(calendar: DataFrame, lower: int = -1, upper: int = 1) -> DataFrame:
    """Event days as (ds, holiday, lower_window, upper_window)."""
    return (calendar.where(F.col("event_name_1").isNotNull())
            .select(F.col("date").alias("ds"), F.col("event_name_1").alias("holiday"),
                    F.lit(lower).alias("lower_window"), F.lit(upper).alias("upper_window")))


def holiday_keys(calendar: DataFrame, lower: int = -1, upper: int = 1) -> DataFrame:
    """Per day, the sorted list of active (holiday, offset) keys. Bounded by
    the number of days (one row per day with an event nearby)."""
    h = holiday_table(calendar, lower, upper)
    ex = h.select("holiday", "ds", F.explode(F.sequence(F.lit(lower), F.lit(upper))).alias("o"))
    return (ex.select(F.date_add("ds", F.col("o")).alias("ds"),
                      F.concat_ws("|", "holiday", F.col("o").cast("string")).alias("k"))
            .groupBy("ds").agg(F.sort_array(F.collect_list("k")).alias("hol")))


def daily_series(star: Star, *keys: str) -> DataFrame:
    """(keys, ds, y): daily units per key for every calendar day, 0-filled. Keys may be
    composite, item x store included."""
    wanted = {"cat_id", "dept_id", "item_id"} & set(keys)

    def with_keys(df: DataFrame) -> DataFrame:
        if wanted:
            df = df.join(star.product.select("product_id", *sorted(wanted)), "product_id")
        return df.join(star.store.select("store_id", "state_id"), "store_id") if "state_id" in keys else df

    sums = with_keys(star.sales).groupBy(*keys, "date").agg(F.sum("units_sold").cast("bigint").alias("y"))
    grid = expand_days(with_keys(star.series()).select(*keys).distinct(), star.first_day(), star.last_day())
    return (grid.join(sums, [*keys, "date"], "left")
            .select(*keys, F.col("date").alias("ds"), F.coalesce("y", F.lit(0)).cast("double").alias("y")))


FORECAST_FIELDS = [T.StructField("forecast_date", T.DateType()),
                   T.StructField("predicted_demand", T.DoubleType()),
                   T.StructField("lower_ci", T.DoubleType()),
                   T.StructField("upper_ci", T.DoubleType()),
                   T.StructField("actual", T.DoubleType())]


def holidays_by_day(calendar: DataFrame) -> dict[int, list[str]]:
    """Active holiday keys by day number; at most three rows an event day, the same for all
    series, so they go to the model once and not with every row."""
    days = holiday_keys(calendar).select(F.unix_date("ds").alias("day"), "hol").collect()
    return {r["day"]: list(r["hol"]) for r in days}


def forecast(star: Star, key: str | list[str], horizon: int, mode: str = "holdout") -> DataFrame:
    keys, holidays = [key] if isinstance(key, str) else list(key), holidays_by_day(star.calendar)
    schema = T.StructType(FORECAST_FIELDS + [T.StructField(k, T.StringType()) for k in keys])

    def fn(pdf):
        return forecast_group(pdf, keys, horizon, holidays, mode=mode)
    return daily_series(star, *keys).groupBy(*keys).applyInPandas(fn, schema)


def components(star: Star, key: str | list[str], horizon: int) -> DataFrame:
    keys, holidays = [key] if isinstance(key, str) else list(key), holidays_by_day(star.calendar)
    schema = T.StructType([*(T.StructField(k, T.StringType()) for k in keys), T.StructField("ds", T.DateType())]
                          + [T.StructField(c, T.DoubleType())
                             for c in ("trend", "weekly", "yearly", "holidays", "yhat")])

    def fn(pdf):
        return forecast_group(pdf, keys, horizon, holidays, output="components")[[f.name for f in schema]]
    return daily_series(star, *keys).groupBy(*keys).applyInPandas(fn, schema)


def metrics(df: DataFrame, keys, actual: str = "actual", pred: str = "predicted") -> DataFrame:
    """MAE and RMSE over all points, MAPE over points with actual > 0;
    rounded 1 / 1 / 2 decimals half-to-even."""
    a, p = F.col(actual).cast("double"), F.col(pred).cast("double")
    e = a - p
    g = df.groupBy(*keys).agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
                              (F.avg(F.when(a > 0, F.abs(e) / a)) * 100).alias("mape"))
    return g.select(*keys, pd_round(F.col("mae"), 1).alias("mae"),
                    pd_round(F.col("rmse"), 1).alias("rmse"), pd_round(F.col("mape"), 2).alias("mape"))


def seasonal_naive(series: DataFrame, key: str, horizon: int, season: int = 7) -> DataFrame:
    """Holdout = last ``horizon`` days; prediction = the last ``season``
    training days repeated. Window partitions are single series."""
    w = Window.partitionBy(key).orderBy("ds")
    s = series.select(key, "ds", "y", (F.row_number().over(w) - 1).alias("pos"),
                      F.count(F.lit(1)).over(Window.partitionBy(key)).alias("n"))
    cut = F.col("n") - horizon
    hold = s.where(F.col("pos") >= cut).withColumn(
        "src", cut - season + (F.col("pos") - cut) % season)
    src = s.select(key, F.col("pos").alias("src"), F.col("y").alias("predicted"))
    return hold.join(src, [key, "src"]).select(key, "ds", F.col("y").alias("actual"), "predicted")


def _level_metrics(df: DataFrame, key: str, level: str) -> DataFrame:
    m = metrics(df, [key])
    acc = pd_round(100 - F.col("mape"), 1) if level == "category" else F.lit(None).cast("double")
    return m.select(F.lit(level).alias("level"), F.col(key).alias("series_id"), "mae", "rmse",
                    "mape", acc.alias("accuracy"))


# ---------------------------------------------------------------- queries

def fc_holidays(star: Star) -> DataFrame:
    return holiday_table(star.calendar)


def fc_metrics(star: Star) -> DataFrame:
    """Holdout metrics of the seasonal-naive baseline (SQL-checkable)."""
    cat = seasonal_naive(daily_series(star, "cat_id"), "cat_id", CATEGORY_HORIZON)
    sto = seasonal_naive(daily_series(star, "store_id"), "store_id", STORE_HORIZON)
    return _level_metrics(cat, "cat_id", "category").unionByName(
        _level_metrics(sto, "store_id", "store"))


def fc_category_90d(star: Star) -> DataFrame:
    return forecast(star, "cat_id", CATEGORY_HORIZON).drop("actual")


def fc_store_30d(star: Star) -> DataFrame:
    return forecast(star, "store_id", STORE_HORIZON).drop("actual")


def fc_components(star: Star) -> DataFrame:
    return components(star, "cat_id", CATEGORY_HORIZON)


def fc_model_metrics(star: Star) -> DataFrame:
    cat = forecast(star, "cat_id", CATEGORY_HORIZON).withColumnRenamed("predicted_demand", "predicted")
    sto = forecast(star, "store_id", STORE_HORIZON).withColumnRenamed("predicted_demand", "predicted")
    return _level_metrics(cat, "cat_id", "category").unionByName(
        _level_metrics(sto, "store_id", "store"))


def fc_dept_store(star: Star) -> DataFrame:
    """Composite keys: the next 30 days of each department in each store."""
    return forecast(star, ["dept_id", "store_id"], STORE_HORIZON, mode="future").drop("actual")


def fc_checks(star: Star) -> DataFrame:
    """What must hold of any fit, per category: rows and dates of the forecast, days of the
    components, their sum against the prediction, the prediction inside its interval."""
    f = forecast(star, "cat_id", CATEGORY_HORIZON).groupBy("cat_id").agg(
        F.count(F.lit(1)).alias("forecast_rows"), F.min("forecast_date").alias("first_day"),
        F.max("forecast_date").alias("last_day"),
        F.count_if((F.col("lower_ci") > F.col("predicted_demand")) | (F.col("upper_ci") < F.col("predicted_demand"))).alias("outside"))
    total = sum((F.col(c) for c in ("weekly", "yearly", "holidays")), F.col("trend"))
    c = components(star, "cat_id", CATEGORY_HORIZON).groupBy("cat_id").agg(
        F.count(F.lit(1)).alias("component_rows"),
        F.count_if(F.abs(total - F.col("yhat")) > 1e-6 * (1 + F.abs("yhat"))).alias("unequal"))
    return f.join(c, "cat_id")


def forecast_shared(star: Star, keys: list[str], horizon: int, mode: str = "future") -> DataFrame:
    """All series of composite keys at once: the shared design factored by the driver, series solved
    in blocks (``operators.forecast_shared``). ``holdout`` predicts the last days, as ``forecast``."""
    first, last = star.calendar.agg(F.unix_date(F.min("date")), F.unix_date(F.max("date"))).first()   # two numbers
    n_train = last - first + 1 - (horizon if mode == "holdout" else 0)
    wanted = {"cat_id", "dept_id", "item_id"} & set(keys)

    def with_keys(df: DataFrame) -> DataFrame:
        if wanted:
            df = df.join(star.product.select("product_id", *sorted(wanted)), "product_id")
        return df.join(star.store.select("store_id", "state_id"), "store_id") if "state_id" in keys else df

    # a series that never sold has a row too, of nothing on the first day
    none = star.series().select("product_id", "store_id", F.date_from_unix_date(F.lit(first)).alias("date"), F.lit(0).alias("units_sold"))
    rows = star.sales.select("product_id", "store_id", "date", "units_sold").unionByName(none)
    solver = factor(first, n_train, horizon, holidays_by_day(star.calendar))
    return forecast_all(with_keys(rows), keys, "date", "units_sold", solver)


def fc_item_store_30d(star: Star) -> DataFrame:
    """The next 30 days of every item in every store."""
    return forecast_shared(star, ["product_id", "store_id"], STORE_HORIZON)


def fc_item_store(star: Star) -> DataFrame:
    """Per series of ``fc_item_store_30d``: its rows, days, and rows whose prediction isn't inside the interval
    or isn't a number; of the same days held out, the actual units they are measured by."""
    f = fc_item_store_30d(star).groupBy("product_id", "store_id").agg(
        F.count(F.lit(1)).alias("forecast_rows"), F.min("forecast_date").alias("first_day"), F.max("forecast_date").alias("last_day"),
        F.count_if(F.isnan("predicted_demand") | (F.col("lower_ci") > F.col("predicted_demand"))
                   | (F.col("upper_ci") < F.col("predicted_demand"))).alias("outside"))
    held = forecast_shared(star, ["product_id", "store_id"], STORE_HORIZON, mode="holdout").select(
        "product_id", "store_id", F.col("forecast_date").alias("date"))
    actual = (held.join(star.sales.select("product_id", "store_id", "date", "units_sold"), ["product_id", "store_id", "date"], "left")
              .groupBy("product_id", "store_id").agg(F.count(F.lit(1)).alias("holdout_days"),
                                                     F.coalesce(F.sum("units_sold"), F.lit(0)).cast("bigint").alias("holdout_units")))
    return f.join(actual, ["product_id", "store_id"])


def fc_linear(star: Star) -> DataFrame:
    """A straight line through the daily units of each category, store and item in a store, and its sum
    over the next 30 days. Trend only, flat prior."""
    t = F.datediff("date", star.first_day())
    sales = star.sold().join(star.product.select("product_id", "cat_id"), "product_id")
    levels = {"category": F.col("cat_id"), "store": F.col("store_id"), "item_store": F.concat_ws("_", "product_id", "store_id")}
    daily = [sales.groupBy(key.alias("series_id"), "date").agg(F.sum("units_sold").cast("bigint").alias("y"))
             .withColumn("level", F.lit(level)) for level, key in levels.items()]
    rows = daily[0].unionByName(daily[1]).unionByName(daily[2]).select("level", "series_id", "y", t.alias("t"))
    out = linear_trend(rows, ["level", "series_id"], F.col("t"), "y", star.n_days(), STORE_HORIZON)
    return out.select("level", "series_id", "n_days", *[F.round(c, 6).alias(c) for c in ("slope", "intercept", "r2", "resid_sd")],
                      F.round("next_total", 6).alias("next_30d"))
