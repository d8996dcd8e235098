"""Readers for M5-style CSV inputs: the wide daily-sales file, the
calendar and the weekly sell prices.

Schemas are explicit (no ``inferSchema`` pass over the data): the wide
file's schema is built from its header line -- six string id columns, then
one integer column per ``d_*`` day.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.operators.melt import day_columns, melt_wide
from mercato.sources.fixture import Star

WIDE_ID_COLS = ["id", "item_id", "dept_id", "cat_id", "store_id", "state_id"]

CALENDAR_SCHEMA = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("wm_yr_wk", T.IntegerType()),
    T.StructField("weekday", T.StringType()),
    T.StructField("wday", T.IntegerType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("d", T.StringType()),
    T.StructField("event_name_1", T.StringType()),
    T.StructField("event_type_1", T.StringType()),
    T.StructField("event_name_2", T.StringType()),
    T.StructField("event_type_2", T.StringType()),
    T.StructField("snap_CA", T.IntegerType()),
    T.StructField("snap_TX", T.IntegerType()),
    T.StructField("snap_WI", T.IntegerType()),
])

PRICES_SCHEMA = T.StructType([
    T.StructField("store_id", T.StringType()),
    T.StructField("item_id", T.StringType()),
    T.StructField("wm_yr_wk", T.IntegerType()),
    T.StructField("sell_price", T.DecimalType(10, 2)),
])

INPUT_FILES = {
    "sales": "sales_train_validation.csv",
    "calendar": "calendar.csv",
    "prices": "sell_prices.csv",
}


#: column of the lines that don't fit
BROKEN = "_broken_line"


def missing_inputs(spark: SparkSession, raw_dir: str) -> list[str]:
    """All required inputs that do not exist (checked through the Hadoop
    file system, so shared storage works too)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    missing = []
    for name in INPUT_FILES.values():
        path = jvm.org.apache.hadoop.fs.Path(os.path.join(raw_dir, name))
        if not path.getFileSystem(conf).exists(path):
            missing.append(name)
    return missing


def validate_inputs(spark: SparkSession, raw_dir: str) -> None:
    missing = missing_inputs(spark, raw_dir)
    if missing:
        raise FileNotFoundError(f"missing input files in {raw_dir}: {', '.join(missing)}")


def header_columns(spark: SparkSession, path: str) -> list[str]:
    """Column names of the header line (one small read of the first line)."""
    lines = spark.read.text(path).limit(1).collect()
    return [c.strip().strip('"') for c in lines[0][0].split(",")] if lines else []


def _check_header(path: str, columns: list[str], wanted: list[str]) -> None:
    missing = [c for c in wanted if c not in columns]
    twice = sorted({c for c in columns if columns.count(c) > 1})
    if missing or twice:
        raise ValueError(f"header of {path}: missing {missing}, repeated {twice}")


def wide_schema(spark: SparkSession, path: str) -> T.StructType:
    """Schema from the header line only."""
    cols = header_columns(spark, path)
    _check_header(path, cols, WIDE_ID_COLS)
    return T.StructType([T.StructField(c, T.StringType() if c in WIDE_ID_COLS else T.IntegerType())
                         for c in cols])


def header_schema(spark: SparkSession, path: str, schema: T.StructType) -> T.StructType:
    """``schema``'s columns in the order of the file's header; columns it doesn't know are strings."""
    cols = header_columns(spark, path)
    _check_header(path, cols, schema.names)
    return T.StructType([schema[c] if c in schema.names else T.StructField(c, T.StringType()) for c in cols])


def _read(spark: SparkSession, path: str, schema: T.StructType, names: list[str], broken: bool | None) -> DataFrame:
    """Columns ``names`` of a file: of all rows, a cell that doesn't fit being NULL (``broken`` None), of the
    rows whose cells all fit (False), or the lines of the others as they stand in the file (True)."""
    reader = spark.read.option("header", True).option("enforceSchema", False).option("dateFormat", "yyyy-MM-dd")
    if broken is None:
        return reader.schema(schema).csv(path).select(*names)
    rows = (reader.option("columnPruning", False).option("columnNameOfCorruptRecord", BROKEN)
            .schema(T.StructType([*schema.fields, T.StructField(BROKEN, T.StringType())])).csv(path))
    # always true; Spark parses only the cells that are asked for, and a line is broken by any cell
    parsed = F.length(F.concat_ws("", *[F.col(c).cast("string") for c in schema.names])) >= 0
    if broken:
        return rows.where(F.col(BROKEN).isNotNull() & parsed).select(BROKEN)
    return rows.where(F.col(BROKEN).isNull() & parsed).select(*names)


def read_wide(spark: SparkSession, path: str, broken: bool | None = None) -> DataFrame:
    schema = wide_schema(spark, path)
    return _read(spark, path, schema, schema.names, broken)


def read_calendar(spark: SparkSession, path: str, broken: bool | None = None) -> DataFrame:
    return _read(spark, path, header_schema(spark, path, CALENDAR_SCHEMA), CALENDAR_SCHEMA.names, broken)


def read_prices(spark: SparkSession, path: str, broken: bool | None = None) -> DataFrame:
    return _read(spark, path, header_schema(spark, path, PRICES_SCHEMA), PRICES_SCHEMA.names, broken)


READERS = {"sales": read_wide, "calendar": read_calendar, "prices": read_prices}


def quarantine_broken(spark: SparkSession, raw_dir: str, out_dir: str) -> dict[str, int]:
    """Write the lines that have a cell of another type, or too few or too many cells, to a folder for
    each input, as text; return how many there are of each. ``load_raw(..., whole_rows=True)`` leaves them out."""
    counts = {}
    for name, file in INPUT_FILES.items():
        path = os.path.join(out_dir, name)
        READERS[name](spark, os.path.join(raw_dir, file), broken=True).write.mode("overwrite").text(path)
        counts[name] = spark.read.text(path).count()
    return counts


def load_raw(spark: SparkSession, raw_dir: str, whole_rows: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sales, calendar and prices, read by the names of their headers. A cell that doesn't fit its column is
    NULL, or with ``whole_rows`` its row is left out (see ``quarantine_broken``)."""
    validate_inputs(spark, raw_dir)
    broken = False if whole_rows else None
    return tuple(READERS[name](spark, os.path.join(raw_dir, file), broken) for name, file in INPUT_FILES.items())


def star_from_m5(wide: DataFrame, calendar: DataFrame, prices: DataFrame) -> Star:
    """The star schema of the three input files.

    Series, items and stores come from the rows of the wide file, so a series that never
    sold is one too; the fact keeps the days with a sale (all other days of the file are 0).
    The calendar is cut to the days of the file: it may go on beyond them. NULL cells are 0."""
    days = day_columns(wide)
    last = max(int(d.split("_")[1]) for d in days)
    number = F.substring("d", 3, 10).cast("int")
    cal = calendar.where(number <= last).withColumn("is_weekend", F.col("wday").isin(1, 2)).withColumn(
        "is_event", F.col("event_name_1").isNotNull())
    ids = wide.select(F.col("item_id").alias("product_id"), "item_id", "dept_id", "cat_id", "store_id", "state_id")
    sold = melt_wide(wide, ["item_id", "store_id"], days, sold=True)
    # one row a day of the file
    sales = sold.join(F.broadcast(cal.select("d", "date")), "d").select(
        "date", F.col("item_id").alias("product_id"), "store_id", "units_sold")
    return Star(calendar=cal, product=ids.select("product_id", "item_id", "dept_id", "cat_id").distinct(),
                store=ids.select("store_id", "state_id").distinct(), sales=sales,
                prices=prices.withColumnRenamed("item_id", "product_id") if "item_id" in prices.columns else prices,
                wide=wide, series_ids=ids.select("product_id", "store_id").distinct())
