"""Wide <-> long reshaping for daily-sales files (one column per day).

``melt_wide`` turns the wide file (id columns + one column per day) into
long rows (ids, ``d``, value). It is a per-partition map -- no shuffle --
so it scales with the number of input splits. Two physical forms:

* ``method="arrow"`` (default): the day columns become one array column, so that a
  batch's cells reach Python as one Arrow buffer (``mapInArrow``): ids are repeated and
  day names tiled by ``take``, no pandas, no column by column work.
* ``method="unpivot"``: the built-in ``DataFrame.unpivot`` (an Expand with
  one projection per day column): with ~2,500
  columns the stage runs without whole-stage codegen.

Both keep NULL cells and fill them afterwards when ``fill`` is given (the
reference fills them with 0).

``melt_priced`` also prices the cells while they stand in arrays, so that they never are
shuffled to the prices; ``row_stats`` reduces wide rows without a melt.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: long rows that one yielded frame holds at most (or one wide row's)
SLICE_CELLS = 1_000_000


def day_columns(df: DataFrame, prefix: str = "d_") -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def cells(cols: Sequence[str]) -> Column:
    """The day columns as one array; one expression, parsed in one call and not column by column."""
    return F.expr("cast(array(" + ", ".join("`" + c.replace("`", "``") + "`" for c in cols) + ") as array<int>)")


def _dense(lists: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells of rows x days, NULL as 0, and which are NULL."""
    flat = lists.flatten()
    values = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False)
    gone = flat.is_null().to_numpy(zero_copy_only=False) if flat.null_count else np.zeros(len(flat), bool)
    return values.reshape(-1, width), gone.reshape(-1, width)


def _melt_batches(n_ids: int, cols: list[str], names: list[str], fill: int | None, sold: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        day, width = pa.array(cols), len(cols)
        rows = max(1, SLICE_CELLS // max(1, width))
        for batch in batches:
            for at in range(0, len(batch), rows):
                part = batch.slice(at, rows)
                values = part.column(n_ids).flatten()
                row = np.repeat(np.arange(len(part), dtype=np.int32), width)
                place = np.tile(np.arange(width, dtype=np.int32), len(part))
                if sold:
                    some = np.flatnonzero(pc.fill_null(values, 0).to_numpy(zero_copy_only=False) > 0)
                    values, row, place = values.take(pa.array(some)), row[some], place[some]
                elif fill is not None:
                    values = pc.fill_null(values, fill)
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(row) for k in range(n_ids)), day.take(pa.array(place)), values], names=names)
    return run


def melt_wide(df: DataFrame, id_cols: Sequence[str], value_cols: Sequence[str] | None = None,
              var_name: str = "d", value_name: str = "units_sold",
              fill: int | None = 0, method: str = "arrow", sold: bool = False) -> DataFrame:
    """``sold``: only cells above 0; the others don't leave the task's arrays."""
    cols = list(value_cols) if value_cols is not None else day_columns(df)
    id_cols = list(id_cols)
    if method == "unpivot":
        long = df.unpivot(id_cols, cols, var_name, value_name)
        if sold:
            return long.where(F.col(value_name) > 0)
        if fill is not None:
            long = long.withColumn(value_name, F.coalesce(F.col(value_name), F.lit(fill)))
        return long
    fields = [df.schema[c] for c in id_cols] + [
        T.StructField(var_name, T.StringType(), False),
        T.StructField(value_name, T.IntegerType(), fill is None and not sold)]
    return df.select(*id_cols, cells(cols).alias("_cells")).mapInArrow(
        _melt_batches(len(id_cols), cols, [f.name for f in fields], fill, sold), T.StructType(fields))


def row_stats(df: DataFrame, id_col: str, value_cols: Sequence[str]) -> DataFrame:
    """id, mn, tot, nulls: least value, sum (NULL as 0) and number of NULLs of each wide row."""
    width = len(value_cols)
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("mn", T.LongType()),
                           T.StructField("tot", T.LongType()), T.StructField("nulls", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, gone = _dense(batch.column(1), width)
            least = np.where(gone, np.iinfo(np.int32).max, values).min(axis=1).astype(np.int64)
            nulls = gone.sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(least, mask=nulls == width), pa.array(values.sum(axis=1, dtype=np.int64)),
                                              pa.array(nulls.astype(np.int64))], names=["id", "mn", "tot", "nulls"])

    return df.select(F.col(id_col).alias("id"), cells(value_cols).alias("_cells")).mapInArrow(run, schema)


def melt_priced(wide: DataFrame, prices: DataFrame, keys: Sequence[str], keep: Sequence[str], weeks: dict[str, int | None]) -> DataFrame:
    """Wide rows and weekly prices, co-grouped by ``keys`` (store and item) -> keep, day_no (place
    in ``weeks``), units_sold, cents.

    prices(keys, wm_yr_wk, sell_price: two decimals); ``weeks``: the retail week of each day column, as
    many entries as days. A group is one series' row (or the rows of a repeated key) and its weeks'
    prices. The task multiplies the arrays; a cell becomes a row after that, in the JVM, where it is
    aggregated at once. NULL cells are 0, unpriced units count 0 cents, as does a week without a calendar day."""
    days, keys, keep = list(weeks), list(keys), list(keep)
    week = np.array([-1 if w is None else w for w in weeks.values()], np.int64)
    schema = T.StructType([wide.schema[c] for c in keep] + [T.StructField("_units", T.ArrayType(T.IntegerType())),
                                                           T.StructField("_cents", T.ArrayType(T.LongType()))])

    def priced(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        lists = left.column("_cells")
        units, _ = _dense(lists.chunk(0) if lists.num_chunks else pa.array([], lists.type), len(days))
        known, first = np.unique(right.column("wm_yr_wk").to_numpy(), return_index=True)
        cents = np.append(right.column("_cents").to_numpy()[first], 0)         # the last is that of no price
        at = np.searchsorted(known, week)
        at[(at == len(known)) | (np.append(known, -2)[at] != week)] = len(known)
        total = units * cents[at]
        ends = pa.array(np.arange(0, units.size + 1, len(days), dtype=np.int32))
        return pa.table([left.column(c) for c in keep]
                        + [pa.ListArray.from_arrays(ends, pa.array(x.reshape(-1))) for x in (units.astype(np.int32), total.astype(np.int64))],
                        names=[f.name for f in schema])

    whole = wide.select(*dict.fromkeys([*keys, *keep]), cells(days).alias("_cells")).groupBy(*keys)
    cents = prices.where("sell_price is not null and wm_yr_wk is not null").select(
        *[F.col(k).alias(f"_{k}") for k in keys], F.col("wm_yr_wk").cast("bigint").alias("wm_yr_wk"),
        (F.col("sell_price") * 100).cast("bigint").alias("_cents")).groupBy(*[f"_{k}" for k in keys])
    rows = whole.cogroup(cents).applyInArrow(priced, schema)
    return rows.select(*keep, F.posexplode(F.arrays_zip("_units", "_cents")).alias("day_no", "_cell")).select(
        *keep, "day_no", F.col("_cell")["_units"].alias("units_sold"), F.col("_cell")["_cents"].alias("cents"))


def pivot_long(long: DataFrame, id_cols: Sequence[str], var_name: str, value_name: str,
               columns: Sequence[str]) -> DataFrame:
    """Long -> wide with an explicit column list (no value discovery pass).
    Missing cells stay NULL."""
    return (long.groupBy(*id_cols).pivot(var_name, list(columns))
            .agg(F.first(value_name)))
