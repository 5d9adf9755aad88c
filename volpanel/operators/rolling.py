"""Rolling one-step-ahead regressions.

All windows of a series share one running sum of cross products, so that a window costs one difference and one small solve
whatever its length. One helper call gets one ticker's rows and all training windows; Spark deals the tickers out. Series
are centred before they are summed, since log variances lie far from zero against their spread.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from volpanel.functions.columns import all_finite, finite

from .features import HAR, HARX, LAGS, component_rows, har_rows, harx_rows

#: A regressor counts as dependent on those before it if this share of its length, or less, is new.
DEPENDENT = 1e-7
#: Below this share of unexplained variance a window of the decomposition is fitted on its own.
NEAR = 1e-5
IDS = "ticker string, sector string, sector_etf string, market_ticker string"
KEYS = "training_window int, forecast_origin_date date, target_date date"


def windows_of(windows: Iterable[int]) -> list[int]:
    """Distinct positive whole windows in order; ValueError without any."""
    found = sorted({int(w) for w in windows if w and w > 0 and w == int(w)})
    if not found:
        raise ValueError("no positive training window")
    return found


def full_rank_fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Least squares in which a regressor that depends on earlier ones gets no coefficient (NaN)."""
    kept, basis = [], []
    for j in range(x.shape[1]):
        rest = x[:, j].copy()
        for _ in range(2):
            for q in basis:
                rest -= q * (q @ rest)
        size = np.linalg.norm(rest)
        if size > DEPENDENT * max(np.linalg.norm(x[:, j]), 1e-300):
            kept.append(j)
            basis.append(rest / size)
    beta = np.full(x.shape[1], np.nan)
    beta[kept] = np.linalg.lstsq(x[:, kept], y, rcond=None)[0]
    return beta


def ill(gram: np.ndarray) -> np.ndarray:
    """Which of the stacked cross-product matrices are too close to dependence to be solved as they are."""
    scale = np.sqrt(np.maximum(np.diagonal(gram, axis1=1, axis2=2), 0))
    flat = (scale <= 0).any(1)
    scale = np.where(scale > 0, scale, 1)
    least = np.linalg.eigvalsh(gram / scale[:, :, None] / scale[:, None, :])[:, 0]
    return flat | (least < 1e-9)


def running(z: np.ndarray) -> np.ndarray:
    """Sums of the rows' cross products before each row, and after the last."""
    return np.concatenate([np.zeros((1, z.shape[1], z.shape[1])), np.cumsum(z[:, :, None] * z[:, None, :], axis=0)])


def rolling_forecasts(x: np.ndarray, y: np.ndarray, window: int, sums: np.ndarray | None = None) -> np.ndarray:
    """Forecast of y for each row from `window` on, by the rows before it; x without the constant."""
    n, k = x.shape
    if n <= window:
        return np.zeros(0)
    mean_x, mean_y = x.mean(0), y.mean()
    z = np.column_stack([np.ones(n), x - mean_x, y - mean_y])
    p = running(z) if sums is None else sums
    g = p[window:n] - p[: n - window]
    gram, right = g[:, : k + 1, : k + 1], g[:, : k + 1, k + 1]
    bad = ill(gram)
    beta = np.zeros((n - window, k + 1))
    if (~bad).any():
        beta[~bad] = np.linalg.solve(gram[~bad], right[~bad][:, :, None])[:, :, 0]
    for i in np.flatnonzero(bad):
        beta[i] = np.nan_to_num(full_rank_fit(z[i : i + window, : k + 1], z[i : i + window, k + 1]))
    return (beta * z[window:, : k + 1]).sum(1) + mean_y


def with_losses(df: DataFrame, actual: str = "actual", forecast: str = "forecast") -> DataFrame:
    """df with error, squared_error, absolute_error and qlike (of logs)."""
    e = F.col(actual) - F.col(forecast)
    return df.withColumn("error", e).withColumn("squared_error", F.col("error") * F.col("error")).withColumn("absolute_error", F.abs("error")).withColumn("qlike", F.exp("error") - F.col("error") - 1)


def _regressions(rows: DataFrame, features: tuple[str, ...], ids: str, windows: Iterable[int]) -> DataFrame:
    sizes, names = windows_of(windows), [part.split()[0] for part in ids.split(", ")]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("origin_date", ignore_index=True)
        x, y = pdf[list(features)].to_numpy(float), pdf["target"].to_numpy(float)
        z = np.column_stack([np.ones(len(y)), x - x.mean(0), y - y.mean()])
        sums, out = running(z), []
        for w in sizes:
            if len(y) > w:
                at = pdf.iloc[w:]
                out.append(pd.DataFrame({n: at[n] for n in names} | {"training_window": w, "forecast_origin_date": at["origin_date"], "target_date": at["target_date"], "actual": y[w:], "forecast": rolling_forecasts(x, y, w, sums)}))
        columns = [*names, "training_window", "forecast_origin_date", "target_date", "actual", "forecast"]
        return pd.concat(out)[columns] if out else pd.DataFrame(columns=columns)

    keys = ["ticker"] + (["sector_etf"] if "sector_etf" in names else [])
    fitted = rows.groupBy(*keys).applyInPandas(fit, f"{ids}, {KEYS}, actual double, forecast double")
    return with_losses(fitted.where(finite("actual") & finite("forecast")))


def har_forecasts(panel: DataFrame, windows: Iterable[int], lags: tuple[int, ...] = LAGS, tickers: list[str] | None = None) -> DataFrame:
    """Plain model: target on its trailing means, refitted for every day. Tickers with too few rows give none."""
    chosen = panel if tickers is None else panel.where(F.col("ticker").isin(tickers))
    return _regressions(har_rows(chosen, lags), HAR, "ticker string", windows)


def harx_forecasts(panel: DataFrame, tickers: DataFrame, windows: Iterable[int], lags: tuple[int, ...] = LAGS) -> DataFrame:
    """Model with the trailing means of market and fund besides the stock's."""
    return _regressions(harx_rows(panel, tickers, lags), HARX, IDS, windows)


# ---- window decomposition, and the model of three components


def window_decomposition(rows: DataFrame, length: int, least: int = 30) -> DataFrame:
    """component_rows with the coefficients of the last `length` rows by built-in functions; NULL where they do not exist.

    Fund on market leaves the orthogonal fund component; stock on market and on it is, as they are orthogonal, two simple fits.
    """
    series = Window.partitionBy("ticker", "sector_etf")
    frame = series.orderBy("date").rowsBetween(-(length - 1), 0)
    over = lambda c: c.over(frame)
    # the fund less what the market explains of it over the whole series, so that windows near dependence lose no digits
    whole = F.coalesce(F.try_divide(F.covar_pop("s", "m").over(series), F.var_pop("m").over(series)), F.lit(0.0))
    columns, rows = rows.columns, rows.withColumns({"__whole": whole, "__vf": over(F.var_pop("s"))} | {f"__{v}0": F.avg(v).over(series) for v in "yms"} | {f"__{v}1": F.col(v) for v in "yms"})
    rows = rows.withColumns({v: F.col(v) - F.col(f"__{v}0") for v in "yms"}).withColumn("s", F.col("s") - F.col("__whole") * F.col("m"))
    means = {v: over(F.avg(v)) for v in "yms"}
    vm, vs, sm, ym, ys = over(F.var_pop("m")), over(F.var_pop("s")), over(F.covar_pop("s", "m")), over(F.covar_pop("y", "m")), over(F.covar_pop("y", "s"))
    df = rows.select("*", over(F.count("*")).alias("n_decomposition_obs"), *(v.alias(f"__{k}") for k, v in means.items()), *(v.alias(n) for n, v in {"__vm": vm, "__vs": vs, "__sm": sm, "__ym": ym, "__ys": ys}.items()))
    c1, left = F.try_divide("__sm", "__vm"), F.col("__vs") - F.try_divide(F.col("__sm") * F.col("__sm"), F.col("__vm"))
    df = df.withColumn("sector_beta_market_hat", c1 + F.col("__whole")).withColumn("beta_market_hat", F.try_divide("__ym", "__vm"))
    df = df.withColumn("sector_intercept_hat", F.col("__s") - c1 * F.col("__m") + F.col("__s0") - F.col("sector_beta_market_hat") * F.col("__m0"))
    df = df.withColumn("alpha_hat", F.col("__y") + F.col("__y0") - F.col("beta_market_hat") * (F.col("__m") + F.col("__m0")))
    df = df.withColumn("beta_sector_hat", F.when(left > 1e-14 * F.col("__vf"), F.try_divide(F.col("__ys") - c1 * F.col("__ym"), left)))
    names = ["alpha_hat", "beta_market_hat", "beta_sector_hat", "sector_intercept_hat", "sector_beta_market_hat"]
    ok = (F.col("n_decomposition_obs") == length) & (F.col("n_decomposition_obs") >= least) & finite("beta_sector_hat") & finite("sector_beta_market_hat") & finite("beta_market_hat")
    df = df.withColumns({v: F.col(f"__{v}1") for v in "yms"})
    return df.select(*columns, "n_decomposition_obs", *(F.when(ok, F.col(n)).alias(n) for n in names))


COMPONENTS = ("stock_log_rv", "market_log_rv", "sector_etf_log_rv", "sector_perp", "relative_q")


def _trailing(x: np.ndarray, n: int) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(x)])
    out = np.full(len(x), np.nan)
    out[n - 1 :] = (total[n:] - total[:-n]) / n
    return out


def _moving_variance(x: np.ndarray, n: int) -> np.ndarray:
    """n times the variance of the n values up to each, NaN before."""
    mean, square = _trailing(x, n), _trailing(x * x, n)
    return n * np.maximum(square - mean * mean, 0)


def _refitted(series: np.ndarray, lags: tuple[int, ...]) -> float:
    """One-step forecast of a window's series by least squares; NaN if a regressor depends on earlier ones."""
    longest = max(lags)
    means = [np.lib.stride_tricks.sliding_window_view(series, n).mean(1)[longest - n :] for n in lags]
    x = np.column_stack([np.ones(len(means[0])), *means])
    beta = full_rank_fit(x[:-1], series[longest:])
    return float(beta @ x[-1])


def component_paths(y: np.ndarray, m: np.ndarray, s: np.ndarray, window: int, lags: tuple[int, ...], raw: int, least: int) -> dict[str, np.ndarray]:
    """Per origin with a next row: coefficients, and each component's forecast, baseline and actual value at the next row.

    Components are linear in the three series with coefficients that stay fixed in a window, and so are their trailing means:
    their cross products are those of the 13 basic numbers of a day, seen through a small matrix per origin.
    """
    n = len(y)
    origins = np.arange(raw - 1, n - 1)
    if len(origins) < 1 or raw < least or raw - max(lags) != window:
        return {}
    mean = np.array([m.mean(), s.mean(), y.mean()])
    base = np.column_stack([m, s, y]) - mean
    # the fund less what the market explains of it over the whole series: windows lose no digits where the fund is nearly a line in the market
    spread = float(base[:, 0] @ base[:, 0])
    whole = float(base[:, 1] @ base[:, 0]) / spread if spread > 0 else 0.0
    fund_variance = _moving_variance(base[:, 1], raw)[origins]
    base[:, 1] -= whole * base[:, 0]
    base[:, 1] -= base[:, 1].mean()
    # the decomposition, from sums over the raw window
    r = running(np.column_stack([np.ones(n), base]))
    g = r[origins + 1] - r[origins + 1 - raw]
    cov = g[:, 1:, 1:] - g[:, 1:, :1] * g[:, :1, 1:] / raw
    mu = g[:, 0, 1:] / raw
    vm, vs, sm, ym, ys = cov[:, 0, 0], cov[:, 1, 1], cov[:, 1, 0], cov[:, 2, 0], cov[:, 2, 1]
    with np.errstate(divide="ignore", invalid="ignore"):
        c1, bm = sm / vm, ym / vm
        left = vs - c1 * sm
        bs = (ys - c1 * ym) / left
        ok = (vm > 0) & (left > 1e-14 * fund_variance) & np.isfinite(bs)
    for k in np.flatnonzero((vm > 0) & (left < NEAR * vs)):  # near dependence in this window alone: fitted on its own
        part = base[origins[k] + 1 - raw : origins[k] + 1]
        part = part - part.mean(0)
        c1[k] = part[:, 1] @ part[:, 0] / (part[:, 0] @ part[:, 0])
        perp = part[:, 1] - c1[k] * part[:, 0]
        left[k] = perp @ perp
        ok[k] = left[k] > 1e-14 * fund_variance[k]
        bs[k] = part[:, 2] @ perp / left[k] if ok[k] else np.nan
    c0, a = mu[:, 1] - c1 * mu[:, 0], mu[:, 2] - bm * mu[:, 0]
    # basic numbers of a target row: 1, then target and three trailing means before it, of market, fund and stock
    z = np.ones((n, 13))
    now = np.ones((n, 13))
    for j in range(3):
        z[0, 1 + 4 * j : 5 + 4 * j] = np.nan
        z[:, 1 + 4 * j] = base[:, j]
        for i, lag in enumerate(lags):
            t = _trailing(base[:, j], lag)
            z[1:, 2 + 4 * j + i], now[:, 2 + 4 * j + i] = t[:-1], t
    usable = np.nan_to_num(z)
    usable[: max(lags)] = 0  # rows without all means are in no window
    p = running(usable)
    gram = p[origins + 1] - p[origins + 1 - window]
    # components as combinations of market, fund and stock, and a constant
    zero = np.zeros(len(origins))
    shift = {"stock_log_rv": zero, "market_log_rv": zero, "sector_etf_log_rv": zero, "sector_perp": -c0, "relative_q": -(a - bs * c0)}
    mix = {
        "stock_log_rv": (zero, zero, zero + 1), "market_log_rv": (zero + 1, zero, zero), "sector_etf_log_rv": (zero + whole, zero + 1, zero),
        "sector_perp": (-c1, zero + 1, zero), "relative_q": (-(bm - bs * c1), -bs, zero + 1),
    }
    ahead = base[origins + 1]
    out: dict[str, np.ndarray] = {"origin": origins}
    recent = np.column_stack([_trailing(base[:, j], window)[origins] for j in range(3)])
    level = {"stock_log_rv": mean[2], "market_log_rv": mean[0], "sector_etf_log_rv": mean[1], "sector_perp": 0.0, "relative_q": 0.0}
    for name in COMPONENTS:
        weights, constant = mix[name], shift[name]
        lin = np.zeros((len(origins), 5, 13))  # rows: constant, three means, target
        lin[:, 0, 0] = 1
        for row, place in ((4, 0), (1, 1), (2, 2), (3, 3)):
            lin[:, row, 0] = constant
            for j in range(3):
                lin[:, row, 1 + 4 * j + place] = weights[j]
        lin = np.where(ok[:, None, None], np.nan_to_num(lin), 0)
        seen = lin @ gram @ lin.transpose(0, 2, 1)
        left_side, right_side = seen[:, :4, :4], seen[:, :4, 4]
        good = ok & ~ill(left_side)
        beta = np.full((len(origins), 4), np.nan)
        if good.any():
            beta[good] = np.linalg.solve(left_side[good], right_side[good][:, :, None])[:, :, 0]
        features = (lin[:, :4] @ now[origins][:, :, None])[:, :, 0]
        value = lambda base_rows: constant + sum(w * base_rows[:, j] for j, w in enumerate(weights))  # noqa: B023, E731
        out[name] = (beta * features).sum(1) + level[name]
        for k in np.flatnonzero(ok & ~good):  # near dependence: that window's series is built and fitted on its own
            part = base[origins[k] + 1 - raw : origins[k] + 1]
            out[name][k] = _refitted(part @ np.array([w[k] for w in weights]) + constant[k] + level[name], lags)
        out[f"{name}_actual"] = value(ahead) + level[name]
        out[f"{name}_baseline"] = value(recent) + level[name]
    out |= {"beta_market_hat": bm, "beta_sector_hat": bs, "sector_beta_market_hat": c1 + whole}
    out["sector_intercept_hat"] = c0 + mean[1] - (c1 + whole) * mean[0]
    out["alpha_hat"] = a + mean[2] - bm * mean[0]
    return out


COEFFICIENTS = ("alpha_hat", "beta_market_hat", "beta_sector_hat", "sector_intercept_hat", "sector_beta_market_hat")


def component_fits(panel: DataFrame, tickers: DataFrame, windows: Iterable[int], lags: tuple[int, ...] = LAGS, least: int = 30, longest: int | None = None) -> DataFrame:
    """One row per origin with all that the two runs over components want: every window of a ticker is fitted here and nowhere else.

    (IDS, KEYS, actual, forecast, actual and baseline of each component, coefficients). A window has `longest` rows more than it trains on.
    """
    sizes, more = windows_of(windows), lags[2] if longest is None else longest
    numbers = [f"{c}_{x}" for c in COMPONENTS for x in ("forecast", "actual", "baseline")]
    schema = f"{IDS}, {KEYS}, n_decomposition_obs int, actual double, {', '.join(f'{c} double' for c in (*numbers, *COEFFICIENTS))}"
    columns = [part.split()[0] for part in schema.split(", ")]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date", ignore_index=True)
        out = []
        for w in sizes:
            found = component_paths(*(pdf[c].to_numpy(float) for c in "yms"), w, lags, w + more, least)
            if found:
                at, ahead = pdf.iloc[found["origin"]].reset_index(drop=True), pdf.iloc[found["origin"] + 1].reset_index(drop=True)
                values = {f"{c}_{x}": found[c + y] for c in COMPONENTS for x, y in (("forecast", ""), ("actual", "_actual"), ("baseline", "_baseline"))}
                out.append(at[["ticker", "sector", "sector_etf", "market_ticker"]].assign(
                    training_window=w, forecast_origin_date=at["date"], target_date=ahead["date"], n_decomposition_obs=w + more, actual=ahead["y"], **values, **{c: found[c] for c in COEFFICIENTS}
                ))
        return pd.concat(out)[columns] if out else pd.DataFrame(columns=columns)

    return component_rows(panel, tickers).groupBy("ticker", "sector_etf").applyInPandas(fit, schema)


def forecasts_of(fits: DataFrame) -> DataFrame:
    """Market, orthogonal fund and residual forecast of component_fits put together again; with coefficients and counts of rows."""
    parts = {"market_forecast": "market_log_rv_forecast", "sector_perp_forecast": "sector_perp_forecast", "q_forecast": "relative_q_forecast"}
    forecast = F.col("alpha_hat") + F.col("beta_market_hat") * F.col(parts["market_forecast"]) + F.col("beta_sector_hat") * F.col("sector_perp_forecast") + F.col(parts["q_forecast"])
    keys = [part.split()[0] for part in f"{IDS}, {KEYS}".split(", ")]
    rows = fits.withColumn("forecast", forecast).where(finite("forecast"))
    counts = [F.col("training_window").alias(f"n_{c}_har_obs") for c in ("market", "sector", "relative")]
    return with_losses(rows.select(*keys, "actual", "forecast", *(F.col(c).alias(n) for n, c in parts.items()), *COEFFICIENTS, "n_decomposition_obs", *counts))


def forecastability_of(fits: DataFrame) -> DataFrame:
    """Five rows per origin of component_fits: each component's forecast against its rolling mean; an origin stays if all five are finite."""
    every = [f"{c}_{x}" for c in COMPONENTS for x in ("actual", "forecast", "baseline")]
    ids, keys = ([part.split()[0] for part in p.split(", ")] for p in (IDS, KEYS))
    one = F.array(*(F.struct(F.lit(c).alias("component"), F.col(f"{c}_actual").alias("actual"), F.col(f"{c}_forecast").alias("forecast"), F.col(f"{c}_baseline").alias("baseline_forecast")) for c in COMPONENTS))
    rows = fits.where(all_finite(every)).select(*ids, *keys, F.explode(one).alias("x")).select(*ids, "x.component", *keys, "x.actual", "x.forecast", "x.baseline_forecast")
    square = lambda c: F.pow(F.col("actual") - F.col(c), 2)
    return rows.withColumn("squared_error_har", square("forecast")).withColumn("squared_error_baseline", square("baseline_forecast"))


def component_forecasts(panel: DataFrame, tickers: DataFrame, windows: Iterable[int], lags: tuple[int, ...] = LAGS, least: int = 30) -> DataFrame:
    return forecasts_of(component_fits(panel, tickers, windows, lags, least))


def forecastability(panel: DataFrame, tickers: DataFrame, windows: Iterable[int], lags: tuple[int, ...] = LAGS, least: int = 30) -> DataFrame:
    return forecastability_of(component_fits(panel, tickers, windows, lags, least, max(lags)))
