"""Running (prefix) sum over a global order, without a single-partition window.

``Window.orderBy(...)`` with no partition key moves every row into one task.
That is fine over a bounded frame (days, years, stores) but not over all
item x store series. The scalable form:

1. range-partition by the order key (``repartitionByRange``) and sort within
   partitions, then ``checkpoint()`` (reliable, into the shared
   ``spark.checkpoint.dir``): range partitioning samples the data, so the
   partition ids must be frozen before they are used twice;
2. per-partition totals -> at most ``num_partitions`` rows -> exclusive
   running offsets (a window over that bounded frame), broadcast back;
3. running sum inside each partition + the partition's offset.

The order key must be unique (add tie keys) so the result is deterministic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prefix_sum(df: DataFrame, value: str, order: Sequence[Column], out: str = "cumulative",
               num_partitions: int | None = None, total: str | None = None) -> DataFrame:
    """``df`` with the running sum ``out`` and, if named, the sum of all rows ``total``.
    The input is computed once: range sampling and the sorting pass read its checkpoint."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.checkpoint(eager=True).repartitionByRange(n, *order).sortWithinPartitions(*order)
              .withColumn("_pid", F.spark_partition_id()))
    ranged = ranged.checkpoint(eager=True)

    totals = ranged.groupBy("_pid").agg(F.sum(value).alias("_part_total"))
    # bounded by the partition count: a single-partition window is safe here
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select("_pid", F.coalesce(F.sum("_part_total").over(before), F.lit(0)).alias("_offset"),
                            *([F.sum("_part_total").over(everything).alias(total)] if total else []))

    running = Window.partitionBy("_pid").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (ranged.join(F.broadcast(offsets), "_pid")
            .withColumn(out, F.col("_offset") + F.sum(value).over(running))
            .drop("_pid", "_offset"))
