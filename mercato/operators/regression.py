"""Least squares in the JVM: a straight line for each series, from grouped moments.

A dense daily series has the days 0 .. N-1, so the sums over t need no rows, and a day without a
sale adds nothing to the sums over y: one aggregate over the sparse rows gives

    Sy = sum y, Sty = sum t y, Syy = sum y^2, and N, St, Stt in closed form.

The sums are integers and add up exactly in DECIMAL(38,0), whatever the order of the rows; the
quotients are taken last. One pass, map-side combined, no row a day, no Python.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def linear_trend(df: DataFrame, keys: Sequence[str], t: Column, y: str, n: Column, ahead: int) -> DataFrame:
    """df(keys, ..., y: whole numbers), t: the row's day, 0 to n - 1 -> keys, n_days, slope, intercept,
    r2, resid_sd, next_total: the sum of the line over the ``ahead`` days after the last.

    Rows of one key and day must have been added up. A flat series has r2 = 1, a series of one day
    no slope (null), as PostgreSQL's regression aggregates."""
    whole = "decimal(38,0)"
    big = lambda c: c.cast("decimal(18,0)")
    value = F.col(y)
    sums = df.groupBy(*keys).agg(F.sum(big(value)).cast(whole).alias("_sy"), F.sum(big(t * value)).cast(whole).alias("_sty"),
                                 F.sum(big(value * value)).cast(whole).alias("_syy"))
    days = n.cast("bigint")
    sums = sums.withColumn("n_days", days)
    d = big(F.col("n_days"))
    st = F.expr("cast(n_days as decimal(18,0)) * (n_days - 1) div 2").cast("decimal(18,0)")
    stt = F.expr("(cast(n_days as decimal(18,0)) - 1) * n_days * (2 * n_days - 1) div 6").cast("decimal(18,0)")
    sums = sums.withColumn("_st", st).withColumn("_stt", stt)
    ratio = lambda a, b: F.when(b != 0, a.cast("double") / b.cast("double"))
    sxx = (d * F.col("_stt") - F.col("_st") * F.col("_st")).cast(whole)
    sxy = (d * F.col("_sty") - F.col("_st") * F.col("_sy")).cast(whole)
    syy = (d * F.col("_syy") - F.col("_sy") * F.col("_sy")).cast(whole)
    line = sums.select(*keys, "n_days", "_st", sxx.alias("_sxx"), sxy.alias("_sxy"), syy.alias("_syy"),
                       (F.col("_stt") * F.col("_sy") - F.col("_st") * F.col("_sty")).cast(whole).alias("_top"))
    slope, intercept = ratio(F.col("_sxy"), F.col("_sxx")), ratio(F.col("_top"), F.col("_sxx"))
    r2 = F.when(F.col("_sxx") == 0, None).when(F.col("_syy") == 0, 1.0).otherwise(
        F.pow(F.col("_sxy").cast("double"), 2) / (F.col("_sxx").cast("double") * F.col("_syy").cast("double")))
    n_d = F.col("n_days").cast("double")
    rest = F.greatest(F.lit(0.0), F.col("_syy").cast("double") / n_d * (1 - r2))
    return (line.select(*keys, "n_days", slope.alias("slope"), intercept.alias("intercept"), r2.alias("r2"),
                        F.when(F.col("n_days") > 2, F.sqrt(rest / (n_d - 2))).alias("resid_sd"))
            .withColumn("next_total", ahead * F.col("intercept")
                        + F.col("slope") * (ahead * F.col("n_days") + ahead * (ahead - 1) / 2)))
