"""Dense-fact semantics without materialising the dense fact.

The reference's ``fact_sales`` holds a row for *every* day of every series
(0 = no sale). Aggregates over it need only the sparse rows plus day counts:
zeros add nothing to sums, and with n = number of days per series,

    mean = sum(x) / n
    var  = (n * sum(x^2) - sum(x)^2) / (n * (n - 1))

so per-series statistics come from one partial/final aggregation of the
sparse fact (map-side combined, no skew-prone collect). Only queries that
*output* dense rows expand them, with a per-key ``sequence`` of days
(a generator, linear in the output; no join of keys against days).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SERIES = ["product_id", "store_id"]


def series_moments(sales: DataFrame, n_days: Column, keys: Sequence[str] = SERIES,
                   series: DataFrame | None = None) -> DataFrame:
    """Per key: n (days), nz (days with a sale), sx = sum(x), sxx = sum(x^2). ``series`` adds
    keys without a row in ``sales``, with zeros."""
    x = F.col("units_sold").cast("bigint")
    out = sales.groupBy(*keys).agg(F.count_if(x > 0).alias("nz"), F.sum(x).alias("sx"),
                                   F.sum(x * x).alias("sxx"))
    if series is not None:
        out = series.select(*keys).join(out, list(keys), "left").fillna(0, ["nz", "sx", "sxx"])
    return out.withColumn("n", n_days.cast("bigint"))


def dense_mean(sx: str = "sx", n: str = "n") -> Column:
    return F.col(sx).cast("double") / F.col(n).cast("double")


def dense_std(sx: str = "sx", sxx: str = "sxx", n: str = "n") -> Column:
    """Sample standard deviation of the dense series; NULL when n < 2.
    The numerator is computed exactly in DECIMAL(38,0)."""
    nn = F.col(n).cast("decimal(38,0)")
    s1 = F.col(sx).cast("decimal(38,0)")
    s2 = F.col(sxx).cast("decimal(38,0)")
    num = (nn * s2 - s1 * s1).cast("double")
    den = (nn * (nn - F.lit(1))).cast("double")
    return F.when(F.col(n) > 1, F.sqrt(F.greatest(num, F.lit(0.0)) / den))


def expand_days(keys: DataFrame, first: Column, last: Column) -> DataFrame:
    """Each key row repeated for every day in [first, last] (column ``date``)."""
    return keys.select("*", F.explode(F.sequence(first, last)).alias("date"))


def dense_rows(sales: DataFrame, series: DataFrame, first: Column, last: Column,
               keys: Sequence[str] = SERIES, prices: DataFrame | None = None,
               calendar: DataFrame | None = None) -> DataFrame:
    """Dense fact rows (date, *keys, units_sold) for the given series; with ``prices`` and
    ``calendar`` also sell_price, null in weeks without one.

    Sales and series are hash-partitioned by the series keys (an explicit
    partition count, so AQE cannot fold the later N-fold expansion into a
    few tasks); the day grid is generated inside those partitions and merged
    with the sales by a union + group-by on (keys, date), which that
    partitioning already satisfies -- the expanded grid is never shuffled
    (a join on (keys, date) would reshuffle it). Prices join the same union, each week's
    row spread over its at most seven days."""
    keys = list(keys)
    spark = sales.sparkSession
    n = max(spark.sparkContext.defaultParallelism,
            int(spark.conf.get("spark.sql.shuffle.partitions")))
    ser = series.select(*keys).repartition(n, *keys)
    sold = (sales.select("date", *keys, "units_sold").repartition(n, *keys)
            .join(ser, keys, "left_semi"))
    grid = ser.select(*keys, F.explode(F.sequence(first, last)).alias("date"),
                      F.lit(0).alias("units_sold"))
    rows = grid.unionByName(sold.select(*keys, "date", "units_sold"))
    units = F.sum("units_sold").cast("int").alias("units_sold")
    if prices is None:
        return rows.groupBy("date", *keys).agg(units)
    days = F.broadcast(calendar.where((F.col("date") >= first) & (F.col("date") <= last)).select("date", "wm_yr_wk"))
    priced = (prices.select(*keys, "wm_yr_wk", "sell_price").repartition(n, *keys)
              .join(ser, keys, "left_semi").join(days, "wm_yr_wk")
              .select(*keys, "date", F.lit(0).alias("units_sold"), "sell_price"))
    no_price = F.lit(None).cast(prices.schema["sell_price"].dataType)
    return (rows.withColumn("sell_price", no_price).unionByName(priced)
            .groupBy("date", *keys).agg(units, F.max("sell_price").alias("sell_price")))
