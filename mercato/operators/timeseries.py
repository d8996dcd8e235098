"""Time-series operators over long (key, date, value) frames.

* ``regularise``: daily spine per key from its first to its last date, with
  zero fill or forward fill (pandas ``asfreq('D')`` + ``fillna``).
* ``decompose``: additive classical decomposition (moving-average trend,
  per-phase seasonal means centred to zero, residual), any number of
  series in parallel, and series of any length: they are split into ranges
  with carried running sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: days of a range
BLOCK = 8_192


def regularise(df: DataFrame, keys: Sequence[str], date: str, value: str,
               fill: str = "zero") -> DataFrame:
    bounds = df.groupBy(*keys).agg(F.min(date).alias("_lo"), F.max(date).alias("_hi"))
    grid = bounds.select(*keys, F.explode(F.sequence("_lo", "_hi")).alias(date))
    out = grid.join(df.select(*keys, date, value), [*keys, date], "left")
    if fill == "zero":
        return out.withColumn(value, F.coalesce(F.col(value), F.lit(0)))
    if fill == "ffill":
        w = Window.partitionBy(*keys).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
        return out.withColumn(value, F.last(value, ignorenulls=True).over(w))
    raise ValueError(fill)


def running_sums(df: DataFrame, keys: Sequence[str], date: str, value: str, block: int = BLOCK) -> DataFrame:
    """keys, date, y, pos, n_rows, sum_to, count_to: each row's place in its series, the rows of the series,
    and the sum and number of the values up to the row.

    Series are split into ranges of ``block`` days. Their totals, a row a range, are summed along the
    series and carried into each range, where a window over the range's rows goes on. A long series is
    as many tasks' work as it has ranges."""
    keys = list(keys)
    d = df.select(*keys, date, F.col(value).cast("double").alias("y"), F.floor(F.unix_date(date) / block).alias("_range"))
    totals = d.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"), F.sum("y").alias("_s"), F.count("y").alias("_c"))
    along = Window.partitionBy(*keys).orderBy("_range")            # rows: the ranges of one series
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_kr"),
                            *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("_n", "_s", "_c")],
                            F.sum("_n").over(Window.partitionBy(*keys)).alias("n_rows"))
    same = d["_range"] == carried["_kr"]
    for i, k in enumerate(keys):
        same &= d[k].eqNullSafe(carried[f"_k{i}"])
    inside = Window.partitionBy(*keys, "_range").orderBy(date)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    return d.join(carried, same).select(
        *keys, date, "y", (F.col("_n_before") + F.row_number().over(inside) - 1).alias("pos"), "n_rows",
        (F.col("_s_before") + F.sum(F.coalesce("y", F.lit(0.0))).over(upto)).alias("sum_to"),
        (F.col("_c_before") + F.count("y").over(upto)).alias("count_to"))


def centred_average(df: DataFrame, keys: Sequence[str], date: str, value: str, period: int, block: int = BLOCK) -> DataFrame:
    """keys, date, y, pos, n_rows, trend: the centred moving average of ``period`` terms (for an even
    period the 2 x period filter with half weights at both ends), NULL where the window is incomplete.

    A window's sum is the difference of two running sums, so it costs two look-ups and not ``period``
    additions. They stand half a window ahead and behind: each range of rows also gets
    those of its neighbours, and no further."""
    half = period // 2
    rows = running_sums(df, keys, date, value, block)
    at = F.col("pos")
    ranges = F.sequence(F.greatest(F.floor((at - half) / block), F.lit(0)), F.floor((at + half + 1) / block))
    order = Window.partitionBy(*keys, "_at").orderBy("pos")
    first = at == half                                               # nothing before the window

    def over(c: str) -> Column:
        before = F.when(first, F.lit(0)).otherwise(F.lag(c, half + 1).over(order))
        return F.lead(c, half).over(order) - before

    ends = 0.5 * (F.lag("y", half).over(order) + F.lead("y", half).over(order))
    whole = period if period % 2 else period + 1
    total = over("sum_to") if period % 2 else over("sum_to") - ends
    return (rows.withColumn("_at", F.explode(ranges))
            .select(*keys, date, "y", "pos", "n_rows", "_at",
                    F.when((at >= half) & (over("count_to") == whole), total / period).alias("trend"))
            .where(F.floor(at / block) == F.col("_at")).drop("_at"))


def decompose(df: DataFrame, keys: Sequence[str], date: str, value: str,
              period: int = 365, block: int = BLOCK) -> DataFrame:
    """Columns: keys, date, observed, trend, seasonal, resid.

    Trend is ``centred_average``. Seasonal component: mean of the
    detrended values per phase (position mod period, counted from each
    series' first date), minus the mean of those phase means."""
    keys = list(keys)
    # two full cycles, as each phase needs a trend on both sides; checked per series
    rows = centred_average(df, keys, date, value, period, block)
    base = rows.select(
        *keys, F.when(F.col("n_rows") < 2 * period, F.raise_error(F.lit(
            f"decompose: a series has fewer than two periods of {period} rows")).cast(df.schema[date].dataType))
        .otherwise(F.col(date)).alias(date), F.col("y").alias("observed"), (F.col("pos") % period).alias("_phase"), "trend")
    phase = (base.groupBy(*keys, "_phase")
             .agg(F.avg(F.col("observed") - F.col("trend")).alias("_pm")))
    centred = phase.withColumn("_pm", F.col("_pm") - F.avg("_pm").over(Window.partitionBy(*keys)))
    out = base.join(centred, [*keys, "_phase"])
    return out.select(*keys, date, "observed", "trend", F.col("_pm").alias("seasonal"),
                      (F.col("observed") - F.col("trend") - F.col("_pm")).alias("resid"))
