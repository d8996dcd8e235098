"""Queries on a star that is read from files in the reference's own layout: the wide daily
file with its NULLs and series that never sold, the calendar and the weekly prices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.plans import audit, kpi
from mercato.session import scratch_path
from mercato.sources.fixture import Star
from mercato.sources.m5 import star_from_m5
from mercato.sources.wide import ID_COLS, wide_sales

UNSOLD = "_UNSOLD"


def file_star(star: Star) -> Star:
    """``star`` as the three files, with one item a department that its first store never
    sold, read back as a star. The wide file is written once a star, to the shared folder."""
    spark = star.sales.sparkSession
    if star.files is None:
        star.files = scratch_path(spark, "files")
        _as_files(star).write.parquet(star.files)
    return star_from_m5(spark.read.parquet(star.files), star.calendar, star.prices.withColumnRenamed("product_id", "item_id"))


def _as_files(star: Star) -> DataFrame:
    wide = wide_sales(star)
    first = star.store.agg(F.min(F.struct("store_id", "state_id")).alias("s")).select("s.store_id", "s.state_id")
    never = (star.product.select("dept_id", "cat_id").distinct().crossJoin(F.broadcast(first))   # one row
             .withColumn("item_id", F.concat("dept_id", F.lit(UNSOLD)))
             .withColumn("id", F.concat_ws("_", "item_id", "store_id")).select(*ID_COLS))
    return wide.unionByName(never, allowMissingColumns=True)


def on_files(fn: Callable[[Star], DataFrame]) -> Callable[[Star], DataFrame]:
    def run(star: Star) -> DataFrame:
        return fn(file_star(star))
    return run


QUERIES = {f"m5_{name}": on_files(fn) for name, fn in {
    "kpi01": kpi.kpi01_totals, "kpi08": kpi.kpi08_category_revenue, "kpi25": kpi.kpi25_demand_cv,
    "kpi29": kpi.kpi29_zero_sales, "audit_report": audit.audit_report}.items()}
