"""Models of very many series: the shared design, the line from moments, long series in ranges."""

from __future__ import annotations

import numpy as np
import pytest
from helpers import make_star
from mercato.operators.forecast import fit_predict
from mercato.operators.forecast_shared import BLOCK, factor, forecast_all, predict
from mercato.operators.regression import linear_trend
from mercato.plans import forecasting
from pyspark.sql import functions as F

FIRST = 18_000


def histories(n_series: int, days: int, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    t = np.arange(days)[:, None]
    level = rng.uniform(0, 20, n_series) + 0.02 * t * rng.uniform(-1, 1, n_series) + 5 * np.sin(2 * np.pi * (t + rng.integers(0, 7, n_series)) / 7)
    y = np.maximum(0, np.round(level + rng.normal(0, 2, (days, n_series))))
    y[:, 0] = 0                      # a series that never sold
    return y


def test_shared_design_gives_each_series_its_own_fit():
    days, horizon = 420, 30
    holidays = {FIRST + k: ["Feast|0"] for k in (50, 150, 250, 350, days + 5)}
    y = histories(25, days)
    yhat, half = predict(factor(FIRST, days, horizon, holidays), y)
    ds = np.arange(FIRST, FIRST + days + horizon)
    for k in range(y.shape[1]):
        one = fit_predict(ds, np.concatenate([y[:, k], np.full(horizon, np.nan)]), holidays, days, irls_iterations=1)
        np.testing.assert_allclose(yhat[:, k], one["yhat"][days:], rtol=1e-7, atol=1e-7)
        np.testing.assert_allclose(yhat[:, k] - half[:, k], one["yhat_lower"][days:], rtol=1e-6, atol=1e-6)


def test_all_series_in_blocks(spark):
    days, n = 90, BLOCK + 40
    y = histories(n, days)
    rows = [(f"s{k}", int(t), float(y[t, k])) for k in range(n) for t in range(days) if y[t, k] or not t]
    rows += [("s1", -3, 99.0), ("s1", days + 2, 99.0), ("s2", 5, 1.0)]                  # outside of the history; twice a day
    y[5, 2] += 1
    sales = spark.createDataFrame(rows, "k string, t int, y double").select("k", F.date_from_unix_date(F.col("t") + FIRST).alias("day"), "y")
    solver = factor(FIRST, days, 7, {})
    got = forecast_all(sales.repartition(3), ["k"], "day", "y", solver).orderBy("k", "forecast_date").toPandas()
    assert len(got) == n * 7 and not got.isna().any().any()
    want, _ = predict(solver, y)
    for k in (0, 1, 2, n - 1):
        np.testing.assert_allclose(got[got.k == f"s{k}"].predicted_demand, want[:, k], atol=1e-9)
    assert (got.lower_ci <= got.predicted_demand).all()


def test_series_that_never_sold_are_predicted(spark):
    star = make_star(spark, [("2021-01-01", "A", "S1", 3), ("2021-02-10", "A", "S1", 4), ("2021-01-20", "B", "S2", 1)], "2021-01-01", "2021-02-28")
    star.series_ids = spark.createDataFrame([("A", "S1"), ("B", "S2"), ("C", "S1")], "product_id string, store_id string")
    got = {(r.product_id, r.store_id): r for r in forecasting.fc_item_store(star).collect()}
    assert set(got) == {("A", "S1"), ("B", "S2"), ("C", "S1")}
    assert all(r.forecast_rows == 30 and r.outside == 0 for r in got.values())
    assert got["A", "S1"].holdout_units == 4 and got["C", "S1"].holdout_units == 0
    values = forecasting.fc_item_store_30d(star).where("product_id = 'C'").collect()
    assert all(abs(r.predicted_demand) < 1e-9 for r in values)


def test_line_from_moments(spark):
    rng = np.random.default_rng(1)
    t = np.arange(200)
    series = {"up": 3 + 2 * t, "noise": rng.integers(0, 50, 200), "gaps": np.where(t % 5 == 0, 10 + t, 0), "flat": np.full(200, 7)}
    rows = [(k, int(a), int(b)) for k, y in series.items() for a, b in zip(t, y, strict=True) if b]
    df = spark.createDataFrame(rows, "k string, t int, y bigint").repartition(5)
    got = {r.k: r for r in linear_trend(df, ["k"], F.col("t"), "y", F.lit(200), 30).collect()}
    for k, y in series.items():
        slope, intercept = np.polyfit(t, y, 1)
        assert got[k].slope == pytest.approx(slope, abs=1e-9) and got[k].intercept == pytest.approx(intercept, abs=1e-7)
        assert got[k].next_total == pytest.approx(np.polyval([slope, intercept], np.arange(200, 230)).sum(), abs=1e-6)
    assert got["up"].r2 == got["flat"].r2 == 1.0 and got["up"].resid_sd == pytest.approx(0, abs=1e-6)
    resid = series["noise"] - np.polyval(np.polyfit(t, series["noise"], 1), t)
    assert got["noise"].resid_sd == pytest.approx(np.sqrt((resid ** 2).sum() / 198))
    one = linear_trend(df.where("t = 0"), ["k"], F.col("t"), "y", F.lit(1), 30).first()
    assert one.slope is None and one.r2 is None
    assert linear_trend(df.limit(0), ["k"], F.col("t"), "y", F.lit(5), 30).count() == 0


def one_series(spark, y, nulls=()):
    rows = spark.range(len(y)).select(F.lit("a").alias("k"), F.date_from_unix_date(F.col("id").cast("int") - 700_000).alias("day"), "id")
    values = spark.createDataFrame([(i, None if i in nulls else float(v)) for i, v in enumerate(y)], "id bigint, y double")
    return rows.join(values, "id").select("k", "day", "y")


@pytest.mark.parametrize("period, block", [(7, 16), (8, 16), (30, 16), (5, 1000), (61, 16)])
def test_centred_average_is_that_of_a_plain_loop(spark, period, block):
    from mercato.operators.timeseries import centred_average
    rng = np.random.default_rng(period)
    y, nulls = rng.integers(0, 90, 150).astype(float), {3, 77}
    df = one_series(spark, y, nulls).unionByName(one_series(spark, y[:40]).withColumn("k", F.lit("b")))
    got = {(r.k, r.pos): r.trend for r in centred_average(df, ["k"], "day", "y", period, block).collect()}
    assert len(got) == 190
    h = period // 2
    weight = np.ones(2 * h + 1)
    if period % 2 == 0:
        weight[[0, -1]] = 0.5
    for k, n, gone in (("a", 150, nulls), ("b", 40, set())):
        for i in range(n):
            full = i >= h and i + h < n and not gone & set(range(i - h, i + h + 1))
            if full:
                assert got[k, i] == pytest.approx((weight * y[i - h:i + h + 1]).sum() / period)
            else:
                assert got[k, i] is None


def test_a_series_of_a_million_days(spark):
    """Split into ranges that several tasks take; no window of a period's rows."""
    from mercato.operators.timeseries import decompose
    n, period = 1_000_000, 365
    days = spark.range(n).select(F.lit("a").alias("k"), F.date_from_unix_date(F.col("id").cast("int") - 500_000).alias("day"),
                                 (F.col("id") * 2 + F.pmod("id", F.lit(period)) * 3).alias("y")).repartition(8)
    out = decompose(days, ["k"], "day", "y", period)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "specifiedwindowframe(RowFrame, -182" not in plan
    assert out.where("trend is not null").count() == n - period + 1
    worst = out.where("trend is not null").agg(F.max(F.abs("resid")).alias("r")).first()
    assert worst.r < 1e-6
    # ranges, and with them rows, in all tasks
    from mercato.operators.timeseries import running_sums
    tasks = running_sums(days, ["k"], "day", "y").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(tasks) > 1 and max(r["count"] for r in tasks) < n
