"""Per-series demand forecasting as one grouped Spark job.

Every series (category, store, item x store, ...) is a group of a
``groupBy(key).applyInPandas``: Spark shuffles each series to one task
(a series is bounded by the number of days), and numpy fits it there.
Parallelism = number of series.

Model (additive decomposable regression in the style of Taylor & Letham,
"Forecasting at scale", 2018, re-derived, not the Stan implementation):

    y(t) = trend(t) + yearly(t) + weekly(t) + holidays(t) + noise

* y is scaled by max|y| of the training part;
* trend: piecewise linear in t in [0, 1] with ``n_changepoints`` hinges
  placed on the first ``changepoint_range`` of the history; Laplace prior
  on hinge slopes (scale ``changepoint_prior``) via iteratively reweighted
  ridge;
* yearly Fourier terms (period 365.25, order 10) and weekly (period 7,
  order 3) with Normal prior (scale ``seasonality_prior``);
* one indicator per (holiday, day offset) seen in training, Normal prior
  (scale ``holiday_prior``);
* interval: yhat +/- z * sd (z for ``interval_width``). The variance is the residual one
  plus, beyond the training part, that of the trend: changes of slope go on as often as
  in the history and with Laplace sizes of the mean fitted scale b, so h ahead it is
  rate * 2 * b^2 * h^3 / 3, the integral that the original simulates.

Deterministic: no sampling, fixed iteration count.
"""

from __future__ import annotations

from statistics import NormalDist
from typing import NamedTuple

import numpy as np
import pandas as pd

YEARLY_PERIOD, YEARLY_ORDER = 365.25, 10
WEEKLY_PERIOD, WEEKLY_ORDER = 7.0, 3


def fourier(days: np.ndarray, period: float, order: int) -> np.ndarray:
    x = 2.0 * np.pi * np.outer(days, np.arange(1, order + 1)) / period
    return np.hstack([np.sin(x), np.cos(x)])


def holiday_matrix(ds: np.ndarray, holidays: dict[int, list[str]], n_train: int) -> np.ndarray:
    """One indicator column per holiday key seen in training."""
    places = [(i, k) for i, day in enumerate(ds.tolist()) for k in holidays.get(day, ())]
    keys = {k: j for j, k in enumerate(sorted({k for i, k in places if i < n_train}))}
    out = np.zeros((len(ds), len(keys)))
    for i, k in places:
        if k in keys:
            out[i, keys[k]] = 1.0
    return out


class Design(NamedTuple):
    """The columns of the model over all days; the first ``n_train`` rows are fitted."""
    x: np.ndarray
    t: np.ndarray            # time, 0 to 1 over the history
    prior_var: np.ndarray    # of each column, hinges with the Laplace prior's variance
    hinges: slice
    seasons: slice
    holidays: slice


def design(ds: np.ndarray, holidays: dict[int, list[str]], n_train: int,
           n_changepoints: int = 25, changepoint_range: float = 0.8, changepoint_prior: float = 0.05,
           seasonality_prior: float = 10.0, holiday_prior: float = 10.0) -> Design:
    """It depends on the days alone, so all series of the same days share it."""
    n = len(ds)
    t0, t1 = float(ds[0]), float(ds[n_train - 1]) if n_train > 1 else float(ds[0]) + 1.0
    span = max(t1 - t0, 1.0)
    t = (ds.astype(float) - t0) / span

    # changepoints at evenly spaced training points in the first range
    n_cp = min(n_changepoints, max(n_train - 1, 0))
    hist_end = int(np.floor(n_train * changepoint_range))
    if n_cp > 0 and hist_end > 1:
        idx = np.linspace(0, hist_end - 1, n_cp + 1).round().astype(int)[1:]
        cps = t[idx]
    else:
        cps = np.array([])
    hinge = np.maximum(t[:, None] - cps[None, :], 0.0) if len(cps) else np.zeros((n, 0))

    seas = np.hstack([fourier(ds.astype(float), YEARLY_PERIOD, YEARLY_ORDER),
                      fourier(ds.astype(float), WEEKLY_PERIOD, WEEKLY_ORDER)])
    hol = holiday_matrix(ds, holidays, n_train)

    X = np.hstack([np.ones((n, 1)), t[:, None], hinge, seas, hol])
    n_h = hinge.shape[1]
    s_cp = slice(2, 2 + n_h)
    s_seas = slice(2 + n_h, 2 + n_h + seas.shape[1])
    s_hol = slice(2 + n_h + seas.shape[1], X.shape[1])
    prior_var = np.empty(X.shape[1])
    prior_var[:2] = 5.0 ** 2
    prior_var[s_seas] = seasonality_prior ** 2
    prior_var[s_hol] = holiday_prior ** 2
    prior_var[s_cp] = (changepoint_prior ** 2) * 2.0  # Laplace variance, first pass
    return Design(X, t, prior_var, s_cp, s_seas, s_hol)


def half_width(d: Design, n_train: int, sigma2: np.ndarray, slopes: np.ndarray, changepoint_range: float,
               interval_width: float) -> np.ndarray:
    """Half of the interval on every day, scaled; ``sigma2`` and ``slopes`` (of the hinges) may have
    a last axis of series."""
    z = NormalDist().inv_cdf(0.5 + interval_width / 2.0)
    ahead = np.maximum(d.t - d.t[n_train - 1], 0.0)
    slope_scale = np.mean(np.abs(slopes), axis=0) if len(slopes) else np.zeros(np.shape(sigma2))
    rate = len(slopes) / changepoint_range
    return z * np.sqrt(sigma2 + rate * 2.0 * slope_scale ** 2 * (ahead ** 3 / 3.0).reshape(-1, *[1] * np.ndim(sigma2)))


def fit_predict(ds: np.ndarray, y: np.ndarray, holidays: dict[int, list[str]], n_train: int,
                n_changepoints: int = 25, changepoint_range: float = 0.8,
                changepoint_prior: float = 0.05, seasonality_prior: float = 10.0,
                holiday_prior: float = 10.0, interval_width: float = 0.80,
                irls_iterations: int = 5) -> dict[str, np.ndarray]:
    """Fit on the first ``n_train`` points, predict every point of ``ds``.

    ``ds``: days as integers (days since epoch), ascending; ``holidays``: the
    holiday keys active on a day, for days that have any."""
    n = len(ds)
    y_tr = y[:n_train].astype(float)
    scale = float(np.max(np.abs(y_tr))) if n_train and np.max(np.abs(y_tr)) > 0 else 1.0
    ys = y_tr / scale
    d = design(ds, holidays, n_train, n_changepoints, changepoint_range, changepoint_prior, seasonality_prior, holiday_prior)
    X, prior_var, s_cp, s_seas, s_hol = d.x, d.prior_var.copy(), d.hinges, d.seasons, d.holidays
    n_h, n_year = s_cp.stop - s_cp.start, 2 * YEARLY_ORDER
    Xt = X[:n_train]

    sigma2 = 1.0
    beta = np.zeros(X.shape[1])
    XtX, Xty = Xt.T @ Xt, Xt.T @ ys
    for _ in range(irls_iterations):
        lam = sigma2 / prior_var
        beta = np.linalg.solve(XtX + np.diag(lam), Xty)
        resid = ys - Xt @ beta
        sigma2 = max(float(np.mean(resid ** 2)), 1e-12)
        if n_h:  # Laplace(0, b) on hinge slopes: quadratic bound at current slopes
            prior_var[s_cp] = changepoint_prior * np.maximum(np.abs(beta[s_cp]), 1e-6)

    fit = X @ beta
    trend = X[:, :2 + n_h] @ beta[:2 + n_h]
    seas = X[:, s_seas]
    yearly = seas[:, :n_year] @ beta[s_seas][:n_year]
    weekly = seas[:, n_year:] @ beta[s_seas][n_year:]
    holi = X[:, s_hol] @ beta[s_hol] if s_hol.stop > s_hol.start else np.zeros(n)
    half = half_width(d, n_train, sigma2, beta[s_cp], changepoint_range, interval_width)
    return {"yhat": fit * scale, "yhat_lower": (fit - half) * scale,
            "yhat_upper": (fit + half) * scale, "trend": trend * scale,
            "yearly": yearly * scale, "weekly": weekly * scale, "holidays": holi * scale}


def forecast_group(pdf: pd.DataFrame, keys: list[str], horizon: int, holidays: dict[int, list[str]],
                   mode: str = "holdout", output: str = "forecast") -> pd.DataFrame:
    """applyInPandas body. Input columns: keys, ds (date), y.

    ``mode='holdout'`` fits on all but the last ``horizon`` days and predicts them (the
    reference's saved "forecast" is this holdout); ``mode='future'`` fits on all days and
    extends ``horizon`` days, with the holidays that the calendar knows there. A holdout
    needs a history longer than the horizon; a shorter series yields no rows."""
    pdf = pdf.sort_values("ds")
    ds = pd.to_datetime(pdf["ds"]).to_numpy(dtype="datetime64[D]").astype("int64")
    y = pdf["y"].to_numpy(dtype=float)
    n_train = len(ds) if mode == "future" else len(ds) - horizon
    key_values = {k: pdf[k].iloc[0] for k in keys}
    if n_train < 2:
        ds, y, n_train, horizon = ds[:0], y[:0], 0, 0
    if mode == "future" and n_train:
        ds = np.concatenate([ds, np.arange(ds[-1] + 1, ds[-1] + 1 + horizon)])
        y = np.concatenate([y, np.full(horizon, np.nan)])
    names = ("yhat", "yhat_lower", "yhat_upper", "trend", "yearly", "weekly", "holidays")
    res = fit_predict(ds, y, holidays, n_train) if n_train else {k: y for k in names}
    dates = ds.astype("datetime64[D]")
    if output == "components":
        return pd.DataFrame({"ds": dates, **{k: res[k] for k in ("trend", "weekly", "yearly", "holidays", "yhat")}}
                            ).assign(**key_values)
    tail = slice(len(ds) - horizon, len(ds))
    return pd.DataFrame({
        "forecast_date": dates[tail], "predicted_demand": res["yhat"][tail],
        "lower_ci": res["yhat_lower"][tail], "upper_ci": res["yhat_upper"][tail],
        "actual": y[tail]}).assign(**key_values)
