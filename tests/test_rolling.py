"""Rolling helpers against a fit of every window on its own."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from volpanel.functions.columns import normal_cdf
from volpanel.operators import rolling

LAGS = (1, 5, 22)


def one_step(x):
    mean = lambda n, i: x[i - n + 1 : i + 1].mean()
    rows = [[1, *(mean(n, i) for n in LAGS)] for i in range(max(LAGS) - 1, len(x))]
    beta = np.linalg.lstsq(np.array(rows[:-1]), x[max(LAGS) :], rcond=None)[0]
    return beta @ rows[-1]


@pytest.mark.parametrize("window", [60, 100])
def test_component_paths(window):
    rng = np.random.default_rng(window)
    n, raw = 200, window + 22
    m = -9 + np.cumsum(rng.normal(size=n)) * 0.1 + rng.normal(size=n) * 0.3
    s = 0.7 * m - 2 + rng.normal(size=n) * 0.3
    y = 0.5 * m + 0.6 * s + rng.normal(size=n) * 0.4
    found = rolling.component_paths(y, m, s, window, LAGS, raw, 30)
    assert len(found["origin"]) == n - raw
    for k, o in enumerate(found["origin"]):
        part = slice(o - raw + 1, o + 1)
        c = np.linalg.lstsq(np.c_[np.ones(raw), m[part]], s[part], rcond=None)[0]
        perp = s[part] - c[0] - c[1] * m[part]
        b = np.linalg.lstsq(np.c_[np.ones(raw), m[part], perp], y[part], rcond=None)[0]
        q = y[part] - b[0] - b[1] * m[part] - b[2] * perp
        series = {"stock_log_rv": y[part], "market_log_rv": m[part], "sector_etf_log_rv": s[part], "sector_perp": perp, "relative_q": q}
        for name, x in series.items():
            assert found[name][k] == pytest.approx(one_step(x), abs=1e-9)
            assert found[f"{name}_baseline"][k] == pytest.approx(x[-window:].mean(), abs=1e-9)
        assert [found[c][k] for c in ("alpha_hat", "beta_market_hat", "beta_sector_hat")] == pytest.approx(list(b), abs=1e-9)


def test_rolling_forecasts_and_dependent_regressors():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(160, 3))
    y = x @ [1, 2, 3] + rng.normal(size=160)
    fit = lambda cols, t: np.r_[1, x[t, cols]] @ np.linalg.lstsq(np.c_[np.ones(50), x[t - 50 : t][:, cols]], y[t - 50 : t], rcond=None)[0]
    assert rolling.rolling_forecasts(x, y, 50) == pytest.approx([fit([0, 1, 2], t) for t in range(50, 160)], abs=1e-9)
    x[:, 2] = 2 * x[:, 0]
    assert rolling.rolling_forecasts(x, y, 50) == pytest.approx([fit([0, 1], t) for t in range(50, 160)], abs=1e-8)
    x[:, 1] = 4.0
    assert rolling.rolling_forecasts(x, y, 50) == pytest.approx([fit([0], t) for t in range(50, 160)], abs=1e-8)


def test_short_series_and_bad_windows():
    assert len(rolling.rolling_forecasts(np.zeros((5, 1)), np.zeros(5), 5)) == 0
    assert rolling.component_paths(np.zeros(10), np.zeros(10), np.zeros(10), 60, LAGS, 82, 30) == {}
    assert rolling.windows_of([100, 100, 60, -1, 0]) == [60, 100]
    with pytest.raises(ValueError):
        rolling.windows_of([])


def test_flat_market_gives_no_component_forecast():
    rng = np.random.default_rng(3)
    found = rolling.component_paths(rng.normal(size=120), np.full(120, 2.0), rng.normal(size=120), 60, LAGS, 82, 30)
    assert np.isnan(found["relative_q"]).all()


@pytest.mark.parametrize("noise", [1e-4, 1e-5])
def test_smooth_series_keep_every_origin(noise):
    """Near dependence of trailing means is no dependence: every origin equals a fit of its window."""
    rng = np.random.default_rng(7)
    n, window, raw = 230, 60, 82
    t = np.arange(n)
    m = -9 + np.sin(t / 40) + rng.normal(size=n) * noise
    s = 0.7 * m - 2 + 0.3 * np.cos(t / 55) + rng.normal(size=n) * noise
    y = 0.5 * m + 0.6 * s + rng.normal(size=n) * 0.4
    found = rolling.component_paths(y, m, s, window, LAGS, raw, 30)
    assert all(np.isfinite(found[c]).all() for c in rolling.COMPONENTS)
    for k, o in enumerate(found["origin"]):
        part = slice(o - raw + 1, o + 1)
        assert found["market_log_rv"][k] == pytest.approx(one_step(m[part]), abs=1e-7)
        assert found["sector_etf_log_rv"][k] == pytest.approx(one_step(s[part]), abs=1e-7)
        assert found["stock_log_rv"][k] == pytest.approx(one_step(y[part]), abs=1e-9)


@pytest.mark.parametrize("noise", [1e-1, 1e-4, 1e-5, 1e-6])
def test_fund_that_is_nearly_a_line_in_the_market(spark, noise):
    """Coefficients equal a fit of each window however little of the fund the market leaves, in the helper and in built-in functions."""
    rng, n, window = np.random.default_rng(0), 400, 100
    m = -9 + 0.05 * np.cumsum(rng.normal(size=n)) + 0.3 * rng.normal(size=n)
    s = 0.3 + 0.8 * m + noise * rng.normal(size=n)
    y = 0.1 + 0.5 * m + 0.7 * s + 0.4 * rng.normal(size=n)
    raw = window + 22
    found = rolling.component_paths(y, m, s, window, (1, 5, 22), raw, 30)
    rows = [("T", "A", "F", "M", dt.date(2020, 1, 1) + dt.timedelta(days=i), float(y[i]), float(m[i]), float(s[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "ticker string, sector string, sector_etf string, market_ticker string, date date, y double, m double, s double")
    built_in = {r.date: r for r in rolling.window_decomposition(df, raw).collect()}
    assert len(found["origin"]) == n - raw
    for i, o in enumerate(found["origin"]):
        part = slice(o + 1 - raw, o + 1)
        mm, ss, yy = (v[part].astype(np.longdouble) - v[part].astype(np.longdouble).mean() for v in (m, s, y))
        c1 = ss @ mm / (mm @ mm)
        perp = ss - c1 * mm
        bs = yy @ perp / (perp @ perp)
        row = built_in[dt.date(2020, 1, 1) + dt.timedelta(days=int(o))]
        for got in (found["beta_sector_hat"][i], row.beta_sector_hat):
            assert abs(got - bs) <= (1e-8 if noise >= 1e-5 else 1e-6) * max(1, abs(bs))
        assert abs(found["sector_beta_market_hat"][i] - c1) <= 1e-10 and abs(row.sector_beta_market_hat - c1) <= 1e-10 and row.s == s[o]


def test_normal_distribution(spark):
    z = [-40.0, -9.0, -3.0, -2.83, -2.82, -1.0, -1e-9, 0.0, 1e-3, 0.5, 1.96, 2.82, 2.83, 3.0, 6.0, 12.0, float("inf"), float("-inf"), None, float("nan")]
    df = spark.createDataFrame([(x,) for x in z], "z double").select(normal_cdf(F.col("z")))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    for x, (got,) in zip(z, df.collect(), strict=True):
        want = None if x is None or x != x else 0.5 * math.erfc(-x / math.sqrt(2))
        assert got is None if want is None else abs(got - want) <= 1e-15 + 1e-12 * want
