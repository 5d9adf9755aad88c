"""Queries from log-variance panel to forecasts, checks, losses, tests and diagnostics, over the weekly stand-in, with their SQL.

The SQL fits every window by normal equations that a Python function writes out, or by joining every origin with its window;
the helpers under test use neither way. Doubles are rounded to 6 digits on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volpanel.functions.columns import rounded
from volpanel.operators import checks, compare, diagnostics, features, rolling, significance, variance

from volpanel.sources.steps import stored

from . import fixtures as fx

WINDOWS = (60, 100)
BIG = 100
MODELS = list(compare.MODELS)


def panel(spark: SparkSession, sf: str) -> DataFrame:
    return fx.log_panel(spark, sf)


def tickers(spark: SparkSession, sf: str, p: DataFrame) -> DataFrame:
    return variance.eligible(p, fx.panel_dimension(spark, sf), "MKT")


def losses(spark: SparkSession, sf: str) -> DataFrame:
    """The three models' forecasts over all windows as a loss panel, stored: checks and tables read it several times."""
    p = panel(spark, sf)
    t = tickers(spark, sf, p)
    stocks = p.join(fx.panel_dimension(spark, sf), "ticker", "left_semi")
    outputs = dict(zip(MODELS, (rolling.har_forecasts(stocks, WINDOWS), rolling.harx_forecasts(p, t, WINDOWS), rolling.component_forecasts(p, t, WINDOWS)), strict=True))
    return stored(compare.loss_panel(outputs, fx.panel_dimension(spark, sf), 30), "losses")


def bad_benchmark_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Every series of the stand-in stands as a benchmark here, so that some weeks are bad."""
    p = panel(spark, sf)
    return variance.bad_benchmark_dates(p, p.select("ticker"))


def eligible_tickers(spark: SparkSession, sf: str) -> DataFrame:
    p = panel(spark, sf)
    return tickers(spark, sf, variance.without_tickers(p, ["NATION_7", "ETF_ASIA"]))


def har_features(spark: SparkSession, sf: str) -> DataFrame:
    return features.har_rows(panel(spark, sf)).transform(rounded)


def harx_features(spark: SparkSession, sf: str) -> DataFrame:
    p = panel(spark, sf)
    return features.harx_rows(p, tickers(spark, sf, p)).transform(rounded)


def rolling_baseline(spark: SparkSession, sf: str) -> DataFrame:
    return features.rolling_baseline(panel(spark, sf), BIG).transform(rounded)


def window_decomposition(spark: SparkSession, sf: str) -> DataFrame:
    p = panel(spark, sf)
    return rolling.window_decomposition(features.component_rows(p, tickers(spark, sf, p)), BIG + 22).transform(rounded)


def har_forecast(spark: SparkSession, sf: str) -> DataFrame:
    return rolling.har_forecasts(panel(spark, sf), WINDOWS).transform(rounded)


def harx_forecast(spark: SparkSession, sf: str) -> DataFrame:
    p = panel(spark, sf)
    return rolling.harx_forecasts(p, tickers(spark, sf, p), WINDOWS).transform(rounded)


def component_forecast(spark: SparkSession, sf: str) -> DataFrame:
    p = panel(spark, sf)
    return rolling.component_forecasts(p, tickers(spark, sf, p), WINDOWS).transform(rounded)


def model_summary_checks(spark: SparkSession, sf: str) -> DataFrame:
    keep = ("training_window", "model", "n_rows", "n_tickers", "n_target_dates", "first_target_date", "last_target_date", "n_ticker_date_pairs", "n_missing_key_rows", "n_nonfinite_rows", "n_duplicate_pairs", "n_invalid_date_order", "n_inconsistent_rows")
    return checks.model_summary(losses(spark, sf), ("training_window", "model")).select(*keep)


def alignment_checks(spark: SparkSession, sf: str) -> DataFrame:
    return checks.alignment_checks(losses(spark, sf), MODELS, "HAR", by=("training_window",))


def metadata_checks(spark: SparkSession, sf: str) -> DataFrame:
    return checks.metadata_checks(losses(spark, sf), fx.panel_dimension(spark, sf), "MKT")


def ticker_losses(spark: SparkSession, sf: str) -> DataFrame:
    return compare.ticker_losses(losses(spark, sf)).transform(rounded)


def overall_losses(spark: SparkSession, sf: str) -> DataFrame:
    return compare.overall_losses(compare.ticker_losses(losses(spark, sf))).transform(rounded)


def sector_losses(spark: SparkSession, sf: str) -> DataFrame:
    return compare.loss_curves(compare.sector_losses(compare.ticker_losses(losses(spark, sf)))).transform(rounded)


def loss_reduction_table(spark: SparkSession, sf: str) -> DataFrame:
    return compare.reduction_table(compare.sector_losses(compare.ticker_losses(losses(spark, sf))), WINDOWS)


def _tests(spark: SparkSession, sf: str) -> DataFrame:
    return significance.stock_tests(significance.pair_losses(losses(spark, sf), "RELATIVE", ["HAR", "HAR-X"]))


def dmw_tests(spark: SparkSession, sf: str) -> DataFrame:
    return _tests(spark, sf).transform(rounded)


def dmw_summary(spark: SparkSession, sf: str) -> DataFrame:
    return significance.summary(_tests(spark, sf)).transform(rounded)


def _r2(spark: SparkSession, sf: str) -> DataFrame:
    p = panel(spark, sf)
    return stored(diagnostics.r2_table(rolling.forecastability(p, tickers(spark, sf, p), [BIG])), "r2")


def forecastability_r2(spark: SparkSession, sf: str) -> DataFrame:
    return _r2(spark, sf).transform(rounded)


def component_r2_summary(spark: SparkSession, sf: str) -> DataFrame:
    return diagnostics.component_summary(_r2(spark, sf)).transform(rounded)


def sector_r2_comparison(spark: SparkSession, sf: str) -> DataFrame:
    return diagnostics.sector_comparison(diagnostics.paired(_r2(spark, sf))).transform(rounded)


def r2_to_plot(spark: SparkSession, sf: str) -> DataFrame:
    return diagnostics.r2_to_plot(_r2(spark, sf)).transform(rounded)


def _decomposed(spark: SparkSession, sf: str) -> DataFrame:
    p = panel(spark, sf)
    return diagnostics.error_decomposition(rolling.component_forecasts(p, tickers(spark, sf, p), [BIG]), p)


def error_decomposition(spark: SparkSession, sf: str) -> DataFrame:
    return _decomposed(spark, sf).transform(rounded)


def error_decomposition_summary(spark: SparkSession, sf: str) -> DataFrame:
    return diagnostics.decomposition_summary(_decomposed(spark, sf)).withColumn("decomposition_gap", F.round("decomposition_gap", 6)).transform(rounded)


def error_shares_to_plot(spark: SparkSession, sf: str) -> DataFrame:
    return diagnostics.shares_to_plot(diagnostics.decomposition_summary(_decomposed(spark, sf))).transform(rounded)


# ---- SQL


def _r(e: str, n: str | None = None) -> str:
    return f"round({e}, 6) + 0.0 AS {n or e}"


def eliminated(source: str, k: int, keep: str) -> str:
    """SQL that solves k normal equations: source has c_i_j for i <= j <= k (k+1 being the target) and gives b_1 .. b_k.

    One nested query per pivot takes it out of the rows below; then coefficients come from the last to the first.
    """
    q = f"SELECT {keep}, " + ", ".join(f"c_{i}_{j} AS a1_{i}_{j}" for i in range(1, k + 1) for j in range(i, k + 2)) + f" FROM {source}"
    for p in range(1, k):
        new = ", ".join(f"a{p}_{i}_{j} - a{p}_{p}_{i} * a{p}_{p}_{j} / a{p}_{p}_{p} AS a{p + 1}_{i}_{j}" for i in range(p + 1, k + 1) for j in range(i, k + 2))
        q = f"SELECT *, {new} FROM ({q})"
    for i in range(k, 0, -1):
        rest = "".join(f" - a{i}_{i}_{j} * b_{j}" for j in range(i + 1, k + 1))
        q = f"SELECT *, (a{i}_{i}_{k + 1}{rest}) / a{i}_{i}_{i} AS b_{i} FROM ({q})"
    return q


_FEATURES = """SELECT ticker, date AS origin_date, target_date, target, daily, weekly, monthly FROM (
  SELECT ticker, date, x AS daily, CASE WHEN count(x) OVER w5 = 5 THEN avg(x) OVER w5 END AS weekly, CASE WHEN count(x) OVER w22 = 22 THEN avg(x) OVER w22 END AS monthly,
         lead(x) OVER o AS target, lead(date) OVER o AS target_date FROM panel
  WINDOW o AS (PARTITION BY ticker ORDER BY date), w5 AS (PARTITION BY ticker ORDER BY date ROWS 4 PRECEDING), w22 AS (PARTITION BY ticker ORDER BY date ROWS 21 PRECEDING))"""
_HAR = {"means": _FEATURES, "har": "SELECT * FROM means WHERE daily IS NOT NULL AND weekly IS NOT NULL AND monthly IS NOT NULL AND target IS NOT NULL"}
_PAIRS = {"who": "SELECT *, 'MKT' AS market_ticker FROM pdim WHERE ticker IN (SELECT ticker FROM panel) AND sector_etf IN (SELECT ticker FROM panel)"}
_X = [f"{w}_{f}" for w in ("stock", "market", "sector") for f in ("daily", "weekly", "monthly")]
_HARX = _PAIRS | {
    "means": _FEATURES,
    "harx": "SELECT p.ticker, p.sector, p.sector_etf, p.market_ticker, a.origin_date, a.target_date, a.target, "
    + ", ".join(f"{t}.{f} AS {w}_{f}" for t, w in (("a", "stock"), ("b", "market"), ("c", "sector")) for f in ("daily", "weekly", "monthly"))
    + """ FROM who p JOIN means a ON a.ticker = p.ticker JOIN means b ON b.ticker = p.market_ticker AND b.origin_date = a.origin_date JOIN means c ON c.ticker = p.sector_etf AND c.origin_date = a.origin_date
        WHERE a.target IS NOT NULL AND """
    + " AND ".join(f"{t}.monthly IS NOT NULL AND {t}.weekly IS NOT NULL AND {t}.daily IS NOT NULL" for t in "abc"),
}


def _fits(source: str, xs: list[str], ids: str, w: int) -> str:
    """Forecasts of a window length: sums over the rows before, of series centred by ticker; eliminate; predict."""
    k = len(xs)
    names = [*xs, "target"]
    centred = ", ".join(f"{x} - avg({x}) OVER (PARTITION BY ticker) AS z{i}" for i, x in enumerate(names, 1))
    sums = ", ".join([f"avg(z{i}) OVER w AS m{i}" for i in range(1, k + 2)] + [f"avg(z{i} * z{j}) OVER w AS s{i}_{j}" for i in range(1, k + 1) for j in range(i, k + 2)])
    covs = ", ".join(f"s{i}_{j} - m{i} * m{j} AS c_{i}_{j}" for i in range(1, k + 1) for j in range(i, k + 2))
    keep = f"{ids}, origin_date, target_date, target, base, " + ", ".join(f"z{i}, m{i}" for i in range(1, k + 2))
    inner = f"""(SELECT {keep}, {covs} FROM (SELECT *, count(*) OVER w AS n, {sums} FROM (SELECT *, avg(target) OVER (PARTITION BY ticker) AS base, {centred} FROM {source})
        WINDOW w AS (PARTITION BY ticker ORDER BY origin_date ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)) WHERE n = {w})"""
    forecast = f"base + m{k + 1} + " + " + ".join(f"b_{i} * (z{i} - m{i})" for i in range(1, k + 1))
    return f"SELECT {ids}, {w} AS training_window, origin_date AS forecast_origin_date, target_date, target AS actual, {forecast} AS forecast FROM ({eliminated(inner, k, keep)})"


_IDS = "ticker, sector, sector_etf, market_ticker"
_LOSS = "actual - forecast AS error, (actual - forecast) * (actual - forecast) AS squared_error, abs(actual - forecast) AS absolute_error, exp(actual - forecast) - (actual - forecast) - 1 AS qlike"
_HAR_F = _HAR | {"harf": " UNION ALL ".join(_fits("har", ["daily", "weekly", "monthly"], "ticker", w) for w in WINDOWS)}
_HARX_F = _HARX | {"harxf": " UNION ALL ".join(_fits("harx", _X, _IDS, w) for w in WINDOWS)}
_COMP_ROWS = _PAIRS | {
    "comp": """SELECT p.*, a.date, a.x AS y, b.x AS m, c.x AS s, row_number() OVER (PARTITION BY p.ticker ORDER BY a.date) AS rn
        FROM who p JOIN panel a ON a.ticker = p.ticker JOIN panel b ON b.ticker = p.market_ticker AND b.date = a.date JOIN panel c ON c.ticker = p.sector_etf AND c.date = a.date
        WHERE a.x IS NOT NULL AND b.x IS NOT NULL AND c.x IS NOT NULL"""
}
_C3 = ", ".join(f"covar_pop({a}, {b}) AS c_{i}_{j}" for i, a in enumerate(("d", "w5", "w22"), 1) for j, b in enumerate(("d", "w5", "w22", "target"), 1) if j >= i)


def _component(windows: tuple[int, ...], parts: dict[str, str]) -> dict[str, str]:
    """Every origin joined with its window; the named parts (series of a window) each fitted on their own."""
    long = " UNION ALL ".join(f"SELECT ticker, training_window, o, rn, '{n}' AS component, {e} AS v FROM series" for n, e in parts.items())
    keep = "ticker, training_window, o, component"
    return _COMP_ROWS | {
        "sizes": "SELECT * FROM (VALUES " + ", ".join(f"({w}, {w + 22})" for w in windows) + ") t(training_window, raw)",
        "origins": "SELECT c.*, training_window, raw, lead(date) OVER g AS target_date, lead(y) OVER g AS y1, lead(m) OVER g AS m1, lead(s) OVER g AS s1 FROM comp c, sizes WINDOW g AS (PARTITION BY ticker, training_window ORDER BY rn)",
        "used": "SELECT * FROM origins WHERE rn >= raw AND target_date IS NOT NULL",
        "win": "SELECT u.ticker, u.training_window, u.rn AS o, c.rn, c.y, c.m, c.s FROM used u JOIN comp c ON c.ticker = u.ticker AND c.rn BETWEEN u.rn - u.raw + 1 AND u.rn",
        "dec": """SELECT *, (sy - c1 * my) / (ss - sm * sm / mm) AS bs FROM (SELECT ticker, training_window, o, regr_slope(s, m) AS c1, regr_intercept(s, m) AS c0, regr_slope(y, m) AS bm, regr_intercept(y, m) AS a,
            covar_pop(s, y) AS sy, covar_pop(m, y) AS my, covar_pop(s, m) AS sm, var_pop(s) AS ss, var_pop(m) AS mm FROM win GROUP BY 1, 2, 3)""",
        "perp": "SELECT w.*, w.s - c0 - c1 * w.m AS sp, a, bm, bs FROM win w JOIN dec USING (ticker, training_window, o)",
        "series": "SELECT *, y - a - bm * m - bs * sp AS q FROM perp",
        "long": long,
        "lagged": """SELECT *, v AS d, avg(v) OVER (g ROWS 4 PRECEDING) AS w5, avg(v) OVER (g ROWS 21 PRECEDING) AS w22, lead(v) OVER g AS target, row_number() OVER g AS pos
            FROM long WINDOW g AS (PARTITION BY ticker, training_window, o, component ORDER BY rn)""",
        "covs": f"SELECT {keep}, avg(d) AS m_1, avg(w5) AS m_2, avg(w22) AS m_3, avg(target) AS m_4, {_C3} FROM lagged WHERE pos >= 22 AND target IS NOT NULL GROUP BY ALL",
        "betas": eliminated("covs", 3, f"{keep}, m_1, m_2, m_3, m_4"),
        "fits": f"SELECT b.*, m_4 + b_1 * (l.d - m_1) + b_2 * (l.w5 - m_2) + b_3 * (l.w22 - m_3) AS f FROM betas b JOIN lagged l USING ({keep}) WHERE l.target IS NULL",
    }


_THREE = {"market": "m", "perp": "sp", "q": "q"}
_COMP_TABLE = """SELECT u.ticker, u.sector, u.sector_etf, u.market_ticker, u.training_window, u.date AS forecast_origin_date, u.target_date, u.y1 AS actual,
  a + bm * fm + bs * fs + fq AS forecast, fm AS market_forecast, fs AS sector_perp_forecast, fq AS q_forecast, a AS alpha_hat, bm AS beta_market_hat, bs AS beta_sector_hat, c0 AS sector_intercept_hat,
  c1 AS sector_beta_market_hat, raw AS n_decomposition_obs, u.training_window AS n_market_har_obs, u.training_window AS n_sector_har_obs, u.training_window AS n_relative_har_obs
  FROM used u JOIN dec ON dec.ticker = u.ticker AND dec.training_window = u.training_window AND dec.o = u.rn
  JOIN (SELECT ticker, training_window, o, max(f) FILTER (component = 'market') AS fm, max(f) FILTER (component = 'perp') AS fs, max(f) FILTER (component = 'q') AS fq FROM fits GROUP BY 1, 2, 3) f
    ON f.ticker = u.ticker AND f.training_window = u.training_window AND f.o = u.rn"""
_COMP_F = _component(WINDOWS, _THREE) | {"compf": _COMP_TABLE}
_COLS = ["actual", "forecast", "error", "squared_error", "absolute_error", "qlike"]
_MORE = ["market_forecast", "sector_perp_forecast", "q_forecast", "alpha_hat", "beta_market_hat", "beta_sector_hat", "sector_intercept_hat", "sector_beta_market_hat"]
_COUNTS = "CAST(n_decomposition_obs AS INTEGER) AS n_decomposition_obs, CAST(n_market_har_obs AS INTEGER) AS n_market_har_obs, CAST(n_sector_har_obs AS INTEGER) AS n_sector_har_obs, CAST(n_relative_har_obs AS INTEGER) AS n_relative_har_obs"
_ALL = _HAR_F | _HARX_F | _COMP_F | {
    "alls": f"""SELECT *, {_LOSS}, 30 AS rv_interval_minutes FROM (
        SELECT 'HAR' AS model, h.ticker, d.sector, CAST(NULL AS VARCHAR) AS sector_etf, CAST(NULL AS VARCHAR) AS market_ticker, training_window, forecast_origin_date, target_date, actual, forecast FROM harf h JOIN pdim d USING (ticker)
        UNION ALL SELECT 'HAR-X', {_IDS}, training_window, forecast_origin_date, target_date, actual, forecast FROM harxf
        UNION ALL SELECT 'RELATIVE', {_IDS}, training_window, forecast_origin_date, target_date, actual, forecast FROM compf)""",
    "tl": "SELECT training_window, rv_interval_minutes, model, ticker, sector, avg(squared_error) AS mse, avg(absolute_error) AS mae, avg(qlike) AS qlike, count(*) AS n_forecasts FROM alls GROUP BY ALL",
    "sl": "SELECT training_window, rv_interval_minutes, model, sector, avg(mse) AS mse, avg(mae) AS mae, avg(qlike) AS qlike, count(DISTINCT ticker) AS n_tickers, CAST(sum(n_forecasts) AS BIGINT) AS n_forecasts FROM tl GROUP BY ALL",
}
_SEEN = {
    "seen": "SELECT training_window, ticker, target_date, bool_or(model = 'HAR') AS i0, bool_or(model = 'HAR-X') AS i1, bool_or(model = 'RELATIVE') AS i2, count(DISTINCT model) AS k, max(actual) - min(actual) AS ar, max(forecast_origin_date) - min(forecast_origin_date) AS od FROM alls GROUP BY 1, 2, 3",
    "bt": "SELECT training_window, ticker, bool_or(i0) AS i0, bool_or(i1) AS i1, bool_or(i2) AS i2 FROM seen GROUP BY 1, 2",
    "bd": "SELECT training_window, target_date, bool_or(i0) AS i0, bool_or(i1) AS i1, bool_or(i2) AS i2 FROM seen GROUP BY 1, 2",
    "facts": "SELECT training_window, "
    + ", ".join(f"(SELECT count(*) FILTER (i1 <> i0) + count(*) FILTER (i2 <> i0) FROM {t} WHERE {t}.training_window = z.training_window) AS {n}" for t, n in (("bt", "dt"), ("bd", "dd"), ("seen", "dp")))
    + """, (SELECT count(*) FROM seen s WHERE s.training_window = z.training_window AND k = 3) AS nc, (SELECT count(*) FROM seen s WHERE s.training_window = z.training_window AND k = 3 AND ar > 1e-10) AS na,
        (SELECT count(*) FROM seen s WHERE s.training_window = z.training_window AND k = 3 AND od > 0) AS no_,
        (SELECT count(*) FROM bt WHERE bt.training_window = z.training_window AND i0 AND i1 AND i2) * (SELECT count(*) FROM bd WHERE bd.training_window = z.training_window AND i0 AND i1 AND i2) AS ne FROM sizes z""",
}
_PF = "CASE WHEN {} THEN 'PASS' ELSE '{}' END"
_CHECKS = [
    ("Individual model output checks", "true", "FAIL", "fatal", "'Models with faults: 0'"), ("Same ticker universe", "dt = 0", "FAIL", "fatal", "'Ticker differences: ' || dt"),
    ("Same target-date universe", "dd = 0", "FAIL", "fatal", "'Date differences: ' || dd"), ("Same ticker-date universe", "dp = 0", "FAIL", "fatal", "'Pair differences: ' || dp"),
    ("Non-empty common ticker-date panel", "nc > 0", "FAIL", "fatal", "'Common ticker-date pairs: ' || nc"), ("Actual values identical on common pairs", "na = 0", "FAIL", "fatal", "'Actual mismatches: ' || na"),
    ("Forecast origins identical on common pairs", "no_ = 0", "WARNING", "warning", "'Forecast-origin mismatches: ' || no_"), ("Balanced common panel", "nc = ne", "WARNING", "warning", "'Expected pairs: ' || ne"),
]
_TESTS = _ALL | {
    "pl": """SELECT r.training_window, b.model AS benchmark_model, r.model AS relative_model, r.ticker, r.sector, r.target_date, k.metric, k.metric_column,
        CASE k.metric WHEN 'mse' THEN b.squared_error WHEN 'qlike' THEN b.qlike ELSE b.absolute_error END AS bl, CASE k.metric WHEN 'mse' THEN r.squared_error WHEN 'qlike' THEN r.qlike ELSE r.absolute_error END AS rl
        FROM alls r JOIN alls b ON r.model = 'RELATIVE' AND b.model <> 'RELATIVE' AND b.training_window = r.training_window AND b.ticker = r.ticker AND b.target_date = r.target_date,
        (VALUES ('mse', 'squared_error'), ('absolute_error', 'absolute_error'), ('qlike', 'qlike')) k(metric, metric_column)""",
    "cd": """SELECT *, bl - rl - avg(bl - rl) OVER g AS c, count(*) OVER g AS n FROM pl WINDOW g AS (PARTITION BY training_window, benchmark_model, metric, ticker)""",
    "lg": "SELECT *, least(greatest(CAST(floor(4 * pow(n / 100.0, 2.0 / 9)) AS INTEGER), 0), n - 1) AS nw, " + ", ".join(f"lag(c, {k}) OVER g AS l{k}" for k in range(1, 8)) + " FROM cd WINDOW g AS (PARTITION BY training_window, benchmark_model, metric, ticker ORDER BY target_date)",
    "agg": "SELECT training_window, benchmark_model, relative_model, metric, metric_column, ticker, max(sector) AS sector, n AS n_obs, CAST(nw AS INTEGER) AS nw_lag, avg(bl) AS mean_benchmark_loss, avg(rl) AS mean_relative_loss, avg(bl - rl) AS mean_difference, "
    + "sum(c * c) / n + " + " + ".join(f"coalesce(CASE WHEN nw >= {k} THEN 2 * (1 - {k} / (nw + 1.0)) * sum(c * l{k}) / n END, 0)" for k in range(1, 8)) + " AS lrv FROM lg GROUP BY 1, 2, 3, 4, 5, 6, n, nw",
    "st": "SELECT *, CASE WHEN lrv > 0 THEN sqrt(n_obs) * mean_difference / sqrt(lrv) END AS z FROM agg",
    "pv": """SELECT *, CASE WHEN abs(z) > 8 THEN CAST(z > 0 AS INTEGER) ELSE 0.5 + exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 90), lambda k: z * pow(z * z, k) * sqrt(pi()) / (pow(2.0, k + 1) * gamma(k + 1.5)))) END AS cdf FROM st""",
    "tests": """SELECT *, CASE WHEN lrv <= 0 THEN 'invalid_variance' WHEN mean_difference > 0 AND 1 - cdf < 0.05 THEN 'significant_improvement' WHEN mean_difference < 0 AND cdf < 0.05 THEN 'significant_underperformance'
        ELSE 'not_significant' END AS test_result, CASE WHEN lrv > 0 THEN 'valid' ELSE 'invalid' END AS test_status, 100 * mean_difference / nullif(mean_benchmark_loss, 0) AS pct FROM pv""",
}
_FIVE = {"stock_log_rv": "y", "market_log_rv": "m", "sector_etf_log_rv": "s", "sector_perp": "sp", "relative_q": "q"}
_R2 = _component((BIG,), _FIVE) | {
    "acts": """SELECT u.*, c0, c1, a, bm, bs, s1 - c0 - c1 * m1 AS sp1, y1 - a - bm * m1 - bs * (s1 - c0 - c1 * m1) AS q1 FROM used u JOIN dec ON dec.ticker = u.ticker AND dec.o = u.rn AND dec.training_window = u.training_window""",
    "bases": "SELECT l.ticker, l.o, l.component, avg(v) AS base FROM long l WHERE l.rn > l.o - " + str(BIG) + " GROUP BY 1, 2, 3",
    "fp": """SELECT f.training_window, f.component, f.ticker, t.sector, f.f, b.base, CASE f.component WHEN 'stock_log_rv' THEN y1 WHEN 'market_log_rv' THEN m1 WHEN 'sector_etf_log_rv' THEN s1 WHEN 'sector_perp' THEN sp1 ELSE q1 END AS act
        FROM fits f JOIN acts t ON t.ticker = f.ticker AND t.rn = f.o JOIN bases b ON b.ticker = f.ticker AND b.o = f.o AND b.component = f.component""",
    "r2": "SELECT training_window, component, ticker, sector, count(*) AS n_forecasts, avg((act - f) * (act - f)) AS msfe_har, avg((act - base) * (act - base)) AS msfe_baseline, 1 - avg((act - f) * (act - f)) / avg((act - base) * (act - base)) AS r2_oos FROM fp GROUP BY 1, 2, 3, 4",
    "pr": "SELECT training_window, ticker, sector, max(r2_oos) FILTER (component = 'stock_log_rv') AS st, max(r2_oos) FILTER (component = 'relative_q') AS q FROM r2 GROUP BY 1, 2, 3 HAVING st IS NOT NULL AND q IS NOT NULL",
}
_ED = _component((BIG,), _THREE) | {
    "compf": _COMP_TABLE,
    "e0": """SELECT f.*, y.x AS stock_actual, m.x AS market_actual, s.x AS sector_actual_raw, s.x - sector_intercept_hat - sector_beta_market_hat * m.x AS sector_perp_actual, actual - forecast AS final_error
        FROM compf f JOIN panel y ON y.ticker = f.ticker AND y.date = f.target_date JOIN panel m ON m.ticker = f.market_ticker AND m.date = f.target_date JOIN panel s ON s.ticker = f.sector_etf AND s.date = f.target_date""",
    "e1": "SELECT *, stock_actual - alpha_hat - beta_market_hat * market_actual - beta_sector_hat * sector_perp_actual AS q_actual, market_actual - market_forecast AS market_error, sector_perp_actual - sector_perp_forecast AS sector_perp_error FROM e0",
    "e2": "SELECT *, q_actual - q_forecast AS q_error, beta_market_hat * market_error AS mc, beta_sector_hat * sector_perp_error AS sc FROM e1",
    "ed": """SELECT *, forecast AS stock_forecast, final_error AS stored_error, mc AS market_error_contribution, sc AS sector_error_contribution, q_error AS q_error_contribution, mc + sc + q_error AS reconstructed_error,
        mc + sc + q_error - final_error AS reconstruction_difference, final_error * final_error AS final_squared_error, (mc + sc + q_error) * (mc + sc + q_error) AS reconstructed_squared_error, mc * mc AS market_squared_term,
        sc * sc AS sector_squared_term, q_error * q_error AS q_squared_term, 2 * mc * sc AS market_sector_cross_term, 2 * mc * q_error AS market_q_cross_term, 2 * sc * q_error AS sector_q_cross_term FROM e2""",
    "es": """SELECT sector, count(DISTINCT ticker) AS n_tickers, count(*) AS n_forecasts, avg(final_squared_error) AS final_msfe, avg(reconstructed_squared_error) AS reconstructed_msfe, avg(market_squared_term) AS market_squared_component,
        avg(sector_squared_term) AS sector_squared_component, avg(q_squared_term) AS q_squared_component, avg(market_sector_cross_term) AS market_sector_cross_component, avg(market_q_cross_term) AS market_q_cross_component,
        avg(sector_q_cross_term) AS sector_q_cross_component, max(abs(reconstruction_difference)) AS max_abs_reconstruction_difference FROM ed GROUP BY 1""",
    "et": """SELECT *, market_squared_component + sector_squared_component + q_squared_component AS total_squared_component, market_sector_cross_component + market_q_cross_component + sector_q_cross_component AS total_cross_component,
        market_squared_component + sector_squared_component + q_squared_component + market_sector_cross_component + market_q_cross_component + sector_q_cross_component AS total_decomposed_msfe FROM es""",
    "eu": """SELECT *, total_decomposed_msfe - final_msfe AS decomposition_gap, 100 * market_squared_component / final_msfe AS market_squared_share_pct, 100 * sector_squared_component / final_msfe AS sector_squared_share_pct,
        100 * q_squared_component / final_msfe AS q_squared_share_pct, 100 * total_cross_component / final_msfe AS total_cross_share_pct FROM et""",
}
_ED_IDS = ["ticker", "sector", "sector_etf", "market_ticker", "forecast_origin_date", "target_date"]
_ED_COLS = [
    "stock_actual", "stock_forecast", "final_error", "stored_error", "market_actual", "market_forecast", "market_error", "sector_actual_raw", "sector_perp_actual", "sector_perp_forecast", "sector_perp_error", "q_actual", "q_forecast",
    "q_error", "alpha_hat", "beta_market_hat", "beta_sector_hat", "sector_intercept_hat", "sector_beta_market_hat", "market_error_contribution", "sector_error_contribution", "q_error_contribution", "reconstructed_error",
    "reconstruction_difference", "final_squared_error", "reconstructed_squared_error", *diagnostics.TERMS,
]
_EU_COLS = [
    "final_msfe", "reconstructed_msfe", "market_squared_component", "sector_squared_component", "q_squared_component", "market_sector_cross_component", "market_q_cross_component", "sector_q_cross_component",
    "max_abs_reconstruction_difference", "total_squared_component", "total_cross_component", "total_decomposed_msfe", "decomposition_gap", "market_squared_share_pct", "sector_squared_share_pct", "q_squared_share_pct", "total_cross_share_pct",
]


def _sql(select: str, more: dict[str, str]) -> str:
    return fx.sql(select, "panel", "pdim", more=more)


def _rs(names: list[str]) -> str:
    return ", ".join(map(_r, names))


_KINDS = {"mse": "MSE", "mae": "MAE", "qlike": "QLIKE"}
_FORECAST = f"CAST(training_window AS INTEGER) AS training_window, forecast_origin_date, target_date, {_rs(_COLS)}"
ORACLE_SQL = {
    "bad_benchmark_dates": _sql("SELECT date FROM panel GROUP BY 1 HAVING count(x) < (SELECT count(DISTINCT ticker) FROM panel)", {}),
    "eligible_tickers": _sql(
        "SELECT ticker, sector, sector_etf, 'MKT' AS market_ticker FROM pdim WHERE ticker IN (SELECT ticker FROM have) AND sector_etf IN (SELECT ticker FROM have)",
        {"have": "SELECT DISTINCT ticker FROM panel WHERE ticker NOT IN ('NATION_7', 'ETF_ASIA')"},
    ),
    "har_features": _sql(f"SELECT ticker, origin_date, target_date, {_rs(['target', 'daily', 'weekly', 'monthly'])} FROM har", _HAR),
    "harx_features": _sql(f"SELECT {_IDS}, origin_date, target_date, {_rs(['target', *_X])} FROM harx", _HARX),
    "rolling_baseline": _sql(f"SELECT ticker, date, {_r('x', 'log_rv')}, {_r(f'CASE WHEN count(x) OVER w = {BIG} THEN avg(x) OVER w END', 'baseline')} FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN {BIG} PRECEDING AND 1 PRECEDING)", {}),
    "window_decomposition": _sql(
        f"""SELECT {_IDS}, date, {_rs(['y', 'm', 's'])}, n AS n_decomposition_obs, {", ".join(_r(f"CASE WHEN n = {BIG + 22} THEN {e} END", nm) for e, nm in (("a", "alpha_hat"), ("bm", "beta_market_hat"), ("(ys - c1 * ym) / (ss - sm * sm / mm)", "beta_sector_hat"), ("c0", "sector_intercept_hat"), ("c1", "sector_beta_market_hat")))}
        FROM (SELECT *, count(*) OVER w AS n, regr_slope(s, m) OVER w AS c1, regr_intercept(s, m) OVER w AS c0, regr_slope(y, m) OVER w AS bm, regr_intercept(y, m) OVER w AS a, covar_pop(y, s) OVER w AS ys, covar_pop(y, m) OVER w AS ym,
              covar_pop(s, m) OVER w AS sm, var_pop(s) OVER w AS ss, var_pop(m) OVER w AS mm FROM comp WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS {BIG + 21} PRECEDING))""",
        _COMP_ROWS,
    ),
    "har_forecast": _sql(f"SELECT ticker, {_FORECAST} FROM (SELECT *, {_LOSS} FROM harf)", _HAR_F),
    "harx_forecast": _sql(f"SELECT {_IDS}, {_FORECAST} FROM (SELECT *, {_LOSS} FROM harxf)", _HARX_F),
    "component_forecast": _sql(f"SELECT {_IDS}, {_FORECAST}, {_rs(_MORE)}, {_COUNTS} FROM (SELECT *, {_LOSS} FROM compf)", _COMP_F),
    "model_summary_checks": _sql(
        """SELECT CAST(training_window AS INTEGER) AS training_window, model, count(*) AS n_rows, count(DISTINCT ticker) AS n_tickers, count(DISTINCT target_date) AS n_target_dates, min(target_date) AS first_target_date, max(target_date) AS last_target_date,
        count(DISTINCT (ticker, target_date)) AS n_ticker_date_pairs, CAST(0 AS BIGINT) AS n_missing_key_rows, count(*) FILTER (NOT isfinite(actual + forecast + qlike)) AS n_nonfinite_rows,
        count(*) - count(DISTINCT (ticker, target_date)) AS n_duplicate_pairs, count(*) FILTER (forecast_origin_date >= target_date) AS n_invalid_date_order,
        count(*) FILTER (abs(error - (actual - forecast)) > 1e-10 OR abs(squared_error - error * error) > 1e-10) AS n_inconsistent_rows FROM alls GROUP BY 1, 2""",
        _ALL,
    ),
    "alignment_checks": _sql(" UNION ALL ".join(f"SELECT CAST(training_window AS INTEGER) AS training_window, '{n}' AS check_name, {_PF.format(c, bad)} AS status, '{sev}' AS severity, {d} AS details FROM facts" for n, c, bad, sev, d in _CHECKS), _ALL | _SEEN),
    "metadata_checks": _sql(
        " UNION ALL ".join(
            f"SELECT '{n}' AS check_name, {_PF.format(c, bad)} AS status, '{sev}' AS severity, {d} AS details FROM mf"
            for n, c, bad, sev, d in (
                ("Metadata available in at least one model", "nm > 0", "WARNING", "warning", "'Models that carry metadata: ' || nm"), ("No missing metadata values", "nb = 0", "FAIL", "fatal", "'Values missing: ' || nb"),
                ("Unique metadata per ticker within each model", "ni = 0", "FAIL", "fatal", "'Tickers of several values: ' || ni"), ("Expected market ticker", "me", "FAIL", "fatal", "'Market: MKT'"),
                ("Metadata consistent across models", "nx = 0", "FAIL", "fatal", "'Tickers on which models differ: ' || nx"), ("Metadata consistent with reference table", "nr = 0", "FAIL", "warning", "'Rows unlike the dimension: ' || nr"),
            )
        ),
        _ALL | {
            "mv": "SELECT DISTINCT model, ticker, sector, sector_etf, market_ticker FROM alls WHERE model <> 'HAR'",
            "mf": """SELECT (SELECT count(DISTINCT model) FROM mv) AS nm, (SELECT count(*) FROM alls WHERE model <> 'HAR' AND (sector IS NULL OR sector_etf IS NULL OR market_ticker IS NULL)) AS nb,
                (SELECT count(*) FROM (SELECT model, ticker FROM mv GROUP BY 1, 2 HAVING count(*) > 1)) AS ni, (SELECT bool_and(market_ticker = 'MKT') FROM mv) AS me,
                (SELECT count(*) FROM (SELECT ticker FROM mv GROUP BY 1 HAVING count(DISTINCT (sector, sector_etf, market_ticker)) > 1)) AS nx,
                (SELECT count(*) FROM mv LEFT JOIN pdim d USING (ticker) WHERE d.sector IS NULL OR mv.sector <> d.sector OR mv.sector_etf <> d.sector_etf) AS nr""",
        },
    ),
    "ticker_losses": _sql(f"SELECT CAST(training_window AS INTEGER) AS training_window, rv_interval_minutes, model, ticker, sector, {_rs(['mse', 'mae', 'qlike'])}, n_forecasts FROM tl", _ALL),
    "overall_losses": _sql(f"SELECT CAST(training_window AS INTEGER) AS training_window, rv_interval_minutes, model, {_r('avg(mse)', 'mse')}, {_r('avg(mae)', 'mae')}, {_r('avg(qlike)', 'qlike')}, count(DISTINCT ticker) AS n_tickers, CAST(sum(n_forecasts) AS BIGINT) AS n_forecasts FROM tl GROUP BY ALL", _ALL),
    "sector_losses": _sql(" UNION ALL ".join(f"SELECT CAST(training_window AS INTEGER) AS training_window, rv_interval_minutes, model, sector, n_tickers, n_forecasts, '{n}' AS metric, {_r(n, 'loss')}, '{k}' AS metric_label FROM sl" for n, k in _KINDS.items()), _ALL),
    "loss_reduction_table": _sql(
        "SELECT s.sector, s.model, " + ", ".join(f"""round(max(100 * (b.{n} - s.{n}) / b.{n}) FILTER (s.training_window = {w}), 2) AS "{k} training = {w}" """ for w in WINDOWS for n, k in _KINDS.items())
        + " FROM sl s JOIN sl b ON b.model = 'HAR' AND b.sector = s.sector AND b.training_window = s.training_window WHERE s.model <> 'HAR' GROUP BY 1, 2",
        _ALL,
    ),
    "dmw_tests": _sql(
        f"""SELECT CAST(training_window AS INTEGER) AS training_window, benchmark_model, relative_model, metric, ticker, metric_column, sector, n_obs, nw_lag, {_rs(['mean_benchmark_loss', 'mean_relative_loss', 'mean_difference'])},
        {_r('pct', 'pct_loss_reduction')}, {_r('lrv', 'long_run_variance')}, {_r('z', 'dmw_stat')}, {_r('1 - cdf', 'p_improvement')}, {_r('cdf', 'p_underperformance')}, test_result, test_status FROM tests""",
        _TESTS,
    ),
    "dmw_summary": _sql(
        "SELECT CAST(training_window AS INTEGER) AS training_window, benchmark_model, relative_model, metric, count(DISTINCT ticker) AS n_tickers, " + ", ".join(f"count(*) FILTER (test_result = '{c}') AS n_{c}, {_r(f'''100.0 * count(*) FILTER (test_result = '{c}') / count(DISTINCT ticker)''', f'pct_{c}')}" for c in significance.CLASSES)
        + f", {_r('avg(pct)', 'mean_pct_loss_reduction')} FROM tests WHERE test_status = 'valid' GROUP BY 1, 2, 3, 4",
        _TESTS,
    ),
    "forecastability_r2": _sql(f"SELECT CAST(training_window AS INTEGER) AS training_window, component, ticker, sector, n_forecasts, {_rs(['msfe_har', 'msfe_baseline', 'r2_oos'])} FROM r2", _R2),
    "component_r2_summary": _sql(f"SELECT CAST(training_window AS INTEGER) AS training_window, component, count(DISTINCT ticker) AS n_tickers, {_r('avg(r2_oos)', 'mean_r2_oos')}, {_r('median(r2_oos)', 'median_r2_oos')}, {_r('100.0 * avg(CAST(r2_oos > 0 AS INTEGER))', 'pct_positive_r2_oos')} FROM r2 GROUP BY 1, 2", _R2),
    "sector_r2_comparison": _sql(f"SELECT CAST(training_window AS INTEGER) AS training_window, sector, count(DISTINCT ticker) AS n_tickers, {_r('avg(st)', 'mean_stock_r2_oos')}, {_r('avg(q)', 'mean_q_r2_oos')}, {_r('avg(q - st)', 'mean_delta_r2')}, {_r('median(q - st)', 'median_delta_r2')}, {_r('100.0 * avg(CAST(q - st > 0 AS INTEGER))', 'pct_positive_delta')} FROM pr GROUP BY 1, 2", _R2),
    "r2_to_plot": _sql(
        f"SELECT sector, {_r('st', 'median_stock_r2')}, {_r('sp', 'median_sector_perp_r2')}, {_r('se', 'median_sector_etf_r2')}, {_r('mk', 'median_market_r2')}, CAST(row_number() OVER (ORDER BY st, sector) AS INTEGER) AS place FROM (SELECT sector, median(r2_oos) FILTER (component = 'stock_log_rv') AS st, median(r2_oos) FILTER (component = 'sector_perp') AS sp, median(r2_oos) FILTER (component = 'sector_etf_log_rv') AS se FROM r2 GROUP BY 1), (SELECT median(r2_oos) AS mk FROM r2 WHERE component = 'market_log_rv')",
        _R2,
    ),
    "error_decomposition": _sql(f"SELECT {', '.join(_ED_IDS)}, {_rs(_ED_COLS)} FROM ed", _ED),
    "error_decomposition_summary": _sql(f"SELECT sector, n_tickers, n_forecasts, {_rs(_EU_COLS)} FROM eu", _ED),
    "error_shares_to_plot": _sql(
        " UNION ALL ".join(f"SELECT sector, CAST(row_number() OVER (ORDER BY total_cross_share_pct, sector) AS INTEGER) AS place, {_r('total_cross_share_pct')}, '{c}' AS part, {_r(c, 'share_pct')}, '{k}' AS label FROM eu" for c, k in (("market_squared_share_pct", "Market"), ("sector_squared_share_pct", "Sector"), ("q_squared_share_pct", "Residual"))),
        _ED,
    ),
}

QUERIES = {name: globals()[name] for name in ORACLE_SQL}
