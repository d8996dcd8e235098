"""Decomposition, forecasting and the file-to-file ETL job."""

from __future__ import annotations

import datetime as dt
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mercato.operators.forecast import fit_predict
from mercato.operators.timeseries import decompose, regularise


def _series(spark, values, start="2020-01-01"):
    d0 = dt.date.fromisoformat(start)
    rows = [("s", d0 + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "k string, ds date, y double")


def test_decomposition_recovers_yearly_pattern(spark):
    n, period = 800, 365
    t = np.arange(n)
    pattern = 10 * np.sin(2 * np.pi * t / period)
    y = 100 + 0.05 * t + pattern
    out = decompose(_series(spark, y), ["k"], "ds", "y", period).orderBy("ds").toPandas()
    assert out["trend"].iloc[:182].isna().all() and out["trend"].iloc[-182:].isna().all()
    assert out["trend"].iloc[182:n - 182].notna().all()
    ok = out["trend"].notna()
    recon = out.loc[ok, "trend"] + out.loc[ok, "seasonal"] + out.loc[ok, "resid"]
    assert np.allclose(recon, out.loc[ok, "observed"])
    assert np.corrcoef(out["seasonal"], pattern)[0, 1] > 0.95
    assert abs(out["seasonal"].iloc[:period].mean()) < 1e-6


def test_forward_fill_regularise(spark):
    df = spark.createDataFrame([("s", dt.date(2020, 1, 1), 1.0), ("s", dt.date(2020, 1, 4), 4.0)],
                               "k string, ds date, y double")
    got = [r.y for r in regularise(df, ["k"], "ds", "y", "ffill").orderBy("ds").collect()]
    assert got == [1.0, 1.0, 1.0, 4.0]
    got0 = [r.y for r in regularise(df, ["k"], "ds", "y", "zero").orderBy("ds").collect()]
    assert got0 == [1.0, 0.0, 0.0, 4.0]


def test_forecast_beats_seasonal_naive_and_is_deterministic():
    n, h = 800, 30
    t = np.arange(n)
    rng = np.random.default_rng(0)
    y = 50 + 0.1 * t + 8 * np.sin(2 * np.pi * t / 7) + rng.normal(0, 1.0, n)
    ds = (np.datetime64("2020-01-01") + t).astype("datetime64[D]").astype("int64")
    res = fit_predict(ds, y, {}, n - h)
    res2 = fit_predict(ds, y, {}, n - h)
    assert np.array_equal(res["yhat"], res2["yhat"])
    model_mae = np.mean(np.abs(y[-h:] - res["yhat"][-h:]))
    naive = np.array([y[n - h - 7 + (i % 7)] for i in range(h)])
    naive_mae = np.mean(np.abs(y[-h:] - naive))
    assert model_mae < naive_mae
    assert np.all(res["yhat_lower"] <= res["yhat"]) and np.all(res["yhat"] <= res["yhat_upper"])


def _write_inputs(root):
    days = 10
    d0 = dt.date(2024, 1, 6)
    wide = pd.DataFrame({
        "id": ["A_S1", "B_S1", "C_S2"], "item_id": ["A", "B", "C"], "dept_id": ["D1", "D1", "D2"],
        "cat_id": ["FOODS", "FOODS", "HOBBIES"], "store_id": ["S1", "S1", "S2"],
        "state_id": ["CA", "CA", "TX"]})
    for i in range(1, days + 1):
        wide[f"d_{i}"] = [i % 3, 0, 5]
    wide.to_csv(os.path.join(root, "sales_train_validation.csv"), index=False)
    cal = pd.DataFrame({
        "date": [(d0 + dt.timedelta(days=i)).isoformat() for i in range(days)],
        "wm_yr_wk": [11101 if i < 7 else 11102 for i in range(days)],
        "weekday": [(d0 + dt.timedelta(days=i)).strftime("%A") for i in range(days)],
        "wday": [i % 7 + 1 for i in range(days)],
        "month": [1] * days, "year": [2024] * days, "d": [f"d_{i}" for i in range(1, days + 1)],
        "event_name_1": ["NewYear"] + [None] * (days - 1), "event_type_1": ["National"] + [None] * (days - 1),
        "event_name_2": [None] * days, "event_type_2": [None] * days,
        "snap_CA": [1] * 3 + [0] * 7, "snap_TX": [0] * days, "snap_WI": [0] * days})
    cal.to_csv(os.path.join(root, "calendar.csv"), index=False)
    prices = pd.DataFrame({"store_id": ["S1", "S1", "S2"], "item_id": ["A", "B", "C"],
                           "wm_yr_wk": [11101, 11101, 11102], "sell_price": [1.5, 2.0, 3.25]})
    prices.to_csv(os.path.join(root, "sell_prices.csv"), index=False)


def test_etl_job_on_csv(spark, tmpdir_path):
    from mercato.plans.etl import run_etl
    from mercato.sources.m5 import load_raw, missing_inputs
    raw = os.path.join(tmpdir_path, "raw")
    os.makedirs(raw)
    assert len(missing_inputs(spark, raw)) == 3
    with pytest.raises(FileNotFoundError):
        load_raw(spark, raw)
    _write_inputs(raw)
    wide, cal, prices = load_raw(spark, raw)
    assert dict(wide.dtypes)["d_3"] == "int" and dict(cal.dtypes)["date"] == "date"
    report = run_etl(wide, cal, prices, os.path.join(tmpdir_path, "out"), k=2)
    assert report["calendar_clean"] == 10
    agg = spark.read.parquet(os.path.join(tmpdir_path, "out", "daily_aggregated.parquet"))
    # (date x dept x store): D1/S1 and D2/S2 every day
    assert report["daily_aggregated"] == 20
    tot = agg.agg(F.sum("total_units"), F.sum("total_revenue")).collect()[0]
    units_a = sum(i % 3 for i in range(1, 11))
    assert tot[0] == units_a + 50
    # revenue: A priced 1.5 in week 11101 (days 1-7), C priced 3.25 in 11102 (days 8-10)
    rev = 1.5 * sum(i % 3 for i in range(1, 8)) + 3.25 * 5 * 3
    assert float(tot[1]) == pytest.approx(rev)
    assert report["sales_enriched_sample"] == 20  # top-2 series x 10 days
    assert report["daily_aggregated_bytes"] > 0


def test_all_outputs_are_written_and_verified(spark, tmpdir_path):
    from mercato.plans.etl import OUTPUTS, run_analytics, run_etl, verify_outputs
    from mercato.sources.m5 import load_raw, star_from_m5
    raw, out = os.path.join(tmpdir_path, "raw"), os.path.join(tmpdir_path, "out")
    os.makedirs(raw)
    _write_inputs(raw)
    wide, cal, prices = load_raw(spark, raw)
    run_etl(wide, cal, prices, out, k=2)
    half = verify_outputs(spark, out)
    assert half["stockout_risk"] == -1 and half["calendar_clean"] == 10
    star = star_from_m5(wide, cal, prices)
    report = run_analytics(star, out)
    assert all(report[f"{name}_unexpected"] == 0 for name in OUTPUTS)
    # the series that never sold has its row in each table
    assert report["abc_classification"] == report["inventory_recommendations"] == report["stockout_risk"] == 3
    risk = {r.product_id: r for r in spark.read.parquet(os.path.join(out, "stockout_risk.parquet")).collect()}
    assert risk["B"].forecast_demand_7d == 0 and risk["B"].alert_date is not None
    # ten days are no history for 90 or 30 held-out ones
    assert report["category_forecasts"] == report["store_forecasts"] == 0


def test_star_from_files_keeps_series_that_never_sold(spark, tmpdir_path):
    from mercato.plans import audit, kpi
    from mercato.sources.m5 import load_raw, star_from_m5
    _write_inputs(tmpdir_path)
    star = star_from_m5(*load_raw(spark, tmpdir_path))
    assert star.series().count() == 3 and star.sales.where("units_sold <= 0").count() == 0
    zero = {r.product_id: r for r in kpi.kpi29_zero_sales(star).collect()}
    assert zero["B"].zero_sale_days == zero["B"].total_days == 10
    totals = kpi.kpi01_totals(star).collect()[0]
    assert totals.total_transactions == star.sales.count()
    report = {r.table_name: r for r in audit.audit_report(star).collect()}
    assert report["sales_wide"].always_zero_series == 1 and report["sales_wide"].always_zero_pct == pytest.approx(33.33)
    assert report["sell_prices"].unique_items == 3 and report["sell_prices"].unique_stores == 2


def test_short_series_do_not_decompose(spark):
    with pytest.raises(Exception, match="fewer than two periods"):
        decompose(_series(spark, range(20)), ["k"], "ds", "y", 14).collect()


def test_forecast_future_and_short_history():
    from mercato.operators.forecast import forecast_group
    n, horizon = 400, 20
    t = np.arange(n)
    days = (np.datetime64("2021-01-01") + t).astype("datetime64[D]")
    first = int(days[0].astype("int64"))
    feast = {first + k: ["Feast|0"] for k in (50, 150, 250, 350, n + 5)}
    y = 100.0 + 40.0 * np.isin(t, (50, 150, 250, 350)) + 0.3 * np.maximum(t - 150, 0) - 0.5 * np.maximum(t - 300, 0)
    pdf = pd.DataFrame({"a": "x", "b": "y", "ds": days, "y": y})
    out = forecast_group(pdf, ["a", "b"], horizon, feast, mode="future").reset_index(drop=True)
    assert len(out) == horizon and list(out.columns[-2:]) == ["a", "b"]
    assert out.predicted_demand[5] > out.predicted_demand.drop(5).max() + 15     # the known feast ahead
    width = (out.upper_ci - out.lower_ci).to_numpy()
    assert (np.diff(width) > 0).all()            # the trend's uncertainty grows
    assert len(forecast_group(pdf.head(20), ["a", "b"], 20, {})) == 0
    assert len(forecast_group(pdf.head(25), ["a", "b"], 20, {})) == 20
