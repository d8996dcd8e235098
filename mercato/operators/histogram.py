"""Equal-width histograms (numpy ``histogram`` semantics) as a Spark job.

Per group: range = [min, max] of the values (optionally only values below a
quantile of the *whole* column), ``bins`` equal bins, the last one closed on
the right, empty bins reported with count 0. A degenerate range (min = max)
becomes [v - 0.5, v + 0.5] as in numpy. Bin numbers for integer inputs are
computed exactly: ``(x - lo) * bins div (hi - lo)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.operators.prefix_sum import prefix_sum


def quantile(df: DataFrame, value: str, q: float, keys: Sequence[str], out: str = "_cap") -> DataFrame:
    """Exact quantile (linear interpolation) per group, without one buffer that holds a
    group's values: values are counted, the counts summed along the sorted values, and the
    two ranks around (n - 1) * q looked up."""
    keys = list(keys)
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = prefix_sum(counted, "_n", [F.col(k) for k in [*keys, value]], out="_upto")
    ends = ranked.groupBy(*keys).agg(F.min(F.col("_upto") - F.col("_n")).alias("_base"), F.max("_upto").alias("_end"))
    at = (F.col("_end") - F.col("_base") - 1) * F.lit(q)
    own, v = F.col("_upto") - F.col("_base"), F.col(value).cast("double")
    around = (ranked.join(ends, keys).groupBy(*keys)
              .agg(F.min(F.when(own > F.floor(at), v)).alias("_low"), F.min(F.when(own > F.ceil(at), v)).alias("_high"),
                   F.max(at - F.floor(at)).alias("_part")))
    return around.select(*keys, (F.col("_low") + F.col("_part") * (F.col("_high") - F.col("_low"))).alias(out))


def histogram(df: DataFrame, value: str, bins: int, keys: Sequence[str] = (),
              below_quantile: float | None = None, integral: bool = True,
              quantile_keys: Sequence[str] = ()) -> DataFrame:
    """``below_quantile`` keeps values under that exact quantile of the column,
    over all rows or per ``quantile_keys`` group."""
    x = F.col(value)
    user_keys = list(keys)
    if not user_keys:  # one global group: a constant key keeps the joins equi-joins
        df = df.withColumn("_all", F.lit(0))
        keys = ["_all"]
    if below_quantile is not None:
        by = list(quantile_keys) or ["_every"]
        df = df if quantile_keys else df.withColumn("_every", F.lit(0))
        df = df.join(quantile(df, value, below_quantile, by), by).where(x < F.col("_cap")).drop("_cap", "_every")
    rng = df.groupBy(*keys).agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    width_zero = F.col("hi") == F.col("lo")
    lo = F.when(width_zero, F.col("lo") - 0.5).otherwise(F.col("lo").cast("double"))
    hi = F.when(width_zero, F.col("hi") + 0.5).otherwise(F.col("hi").cast("double"))
    rng = rng.select(*keys, "lo", "hi", lo.alias("edge_lo"), hi.alias("edge_hi"))

    if integral:
        raw = F.when(F.col("hi") == F.col("lo"), F.lit(bins // 2)).otherwise(
            F.expr(f"(cast({value} as bigint) - lo) * {bins} div (hi - lo)"))
    else:
        raw = F.floor((x - F.col("edge_lo")) * bins / (F.col("edge_hi") - F.col("edge_lo")))
    # one row per group; broadcast only if the runtime size allows it
    counted = df.join(rng, list(keys))
    counts = (counted.select(*keys, F.least(raw.cast("int"), F.lit(bins - 1)).alias("bin"))
              .groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("count")))

    grid = rng.select(*keys, "edge_lo", "edge_hi",
                      F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    step = (F.col("edge_hi") - F.col("edge_lo")) / bins
    return (grid.join(counts, [*keys, "bin"], "left")
            .select(*user_keys, "bin",
                    (F.col("edge_lo") + step * F.col("bin")).alias("bin_start"),
                    (F.col("edge_lo") + step * (F.col("bin") + 1)).alias("bin_end"),
                    F.coalesce("count", F.lit(0)).cast("bigint").alias("count")))
