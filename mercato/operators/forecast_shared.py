"""One model for very many series: the design is factored once, series are columns.

The design of ``operators.forecast`` depends on the days alone. Where all series have the same
days (a dense fact) and the prior is fixed (no Laplace steps), so do the normal equations: with
``A = X'X + diag(1 / prior variance)``, the coefficients of series y are ``A^-1 X' y``. The driver
factors A once (columns x columns), broadcasts ``X`` and ``A^-1 X'`` (days x columns: bounded by the
calendar), and a task solves a block of series as one matrix product. Time is linear in the series.

Series come as they are stored, sparse: one row a series with its days of sale, gathered from a
map-side combined aggregate and bounded by the days. The dense vectors exist in blocks of
``BLOCK`` series only. Values equal ``forecast.fit_predict(..., irls_iterations=1)``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.operators.forecast import Design, design, half_width

#: series solved together
BLOCK = 512


class Solver(NamedTuple):
    design: Design
    solve: np.ndarray      # columns x history: coefficients = solve @ y
    first_day: int         # days since epoch
    n_train: int
    horizon: int


def factor(first_day: int, n_train: int, horizon: int, holidays: dict[int, list[str]], **priors) -> Solver:
    """The solver of all series whose history is ``n_train`` days from ``first_day`` on and whose
    forecast is the ``horizon`` days after it."""
    ds = np.arange(first_day, first_day + n_train + horizon)
    d = design(ds, holidays, n_train, **priors)
    xt = d.x[:n_train]
    lower = np.linalg.cholesky(xt.T @ xt + np.diag(1.0 / d.prior_var))
    solve = np.linalg.solve(lower.T, np.linalg.solve(lower, xt.T))
    return Solver(d, solve, first_day, n_train, horizon)


def predict(s: Solver, y: np.ndarray, changepoint_range: float = 0.8, interval_width: float = 0.80) -> tuple[np.ndarray, np.ndarray]:
    """y: history x series -> forecast and half of its interval, horizon x series."""
    scale = np.abs(y).max(axis=0)
    scale[scale == 0] = 1.0
    ys = y / scale
    beta = s.solve @ ys
    sigma2 = np.maximum(((ys - s.design.x[:s.n_train] @ beta) ** 2).mean(axis=0), 1e-12)
    half = half_width(s.design, s.n_train, sigma2, beta[s.design.hinges], changepoint_range, interval_width)
    return s.design.x[s.n_train:] @ beta * scale, half[s.n_train:] * scale


def forecast_all(sales: DataFrame, keys: Sequence[str], day: str, value: str, solver: Solver) -> DataFrame:
    """sales(keys, day: date, value) -> keys, forecast_date, predicted_demand, lower_ci, upper_ci; all series
    with a row, days without one are 0. Rows outside of the history count for nothing."""
    spark = sales.sparkSession
    keys = list(keys)
    at = F.unix_date(day) - F.lit(solver.first_day)
    sums = sales.groupBy(*keys, at.alias("_at")).agg(F.sum(value).cast("double").alias("_y"))
    series = sums.groupBy(*keys).agg(F.collect_list("_at").alias("_at"), F.collect_list("_y").alias("_y"))
    shared = spark.sparkContext.broadcast(solver)
    fields = [sales.schema[k] for k in keys] + [T.StructField("forecast_date", T.DateType())] + [
        T.StructField(c, T.DoubleType()) for c in ("predicted_demand", "lower_ci", "upper_ci")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        days = np.arange(s.first_day + s.n_train, s.first_day + s.n_train + s.horizon).astype("datetime64[D]")
        for batch in batches:
            for first in range(0, len(batch), BLOCK):
                part = batch.slice(first, BLOCK)
                places, values = part.column(len(keys)), part.column(len(keys) + 1)
                row = np.repeat(np.arange(len(part)), places.value_lengths().to_numpy(zero_copy_only=False))
                where = places.flatten().to_numpy(zero_copy_only=False)
                inside = (where >= 0) & (where < s.n_train)
                y = np.zeros((s.n_train, len(part)))
                y[where[inside], row[inside]] = values.flatten().to_numpy(zero_copy_only=False)[inside]
                yhat, half = predict(s, y)
                many = np.repeat(np.arange(len(part)), s.horizon)
                ahead = [pa.array(x.T.reshape(-1)) for x in (yhat, yhat - half, yhat + half)]
                yield pa.RecordBatch.from_arrays([part.column(k).take(pa.array(many)) for k in range(len(keys))]
                                                 + [pa.array(np.tile(days, len(part))), *ahead], names=[f.name for f in fields])

    return series.select(*keys, "_at", "_y").mapInArrow(run, T.StructType(fields))
