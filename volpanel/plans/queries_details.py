"""Queries that return the rows behind the checks, type standardisation, the forecastability panel and plot-ready test shares, with their SQL.

Faults are planted in the models' forecasts by the day of the target date, alike on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from volpanel.functions.columns import rounded
from volpanel.operators import checks, rolling, significance

from . import fixtures as fx
from . import queries_panel as panels

KEYS = ["ticker", "forecast_origin_date", "target_date"]


def day() -> Column:
    return F.dayofmonth("target_date")


def _har(spark: SparkSession, sf: str) -> DataFrame:
    return rolling.har_forecasts(panels.panel(spark, sf), (panels.BIG,)).select(*checks.REQUIRED)


def _faulty(spark: SparkSession, sf: str) -> DataFrame:
    """No forecast on the 10th, a wrong qlike on the 5th, rows twice on the 7th."""
    rows = _har(spark, sf).withColumn("forecast", F.when(day() != 10, F.col("forecast"))).withColumn("qlike", F.when(day() == 5, F.col("qlike") + 1).otherwise(F.col("qlike")))
    return rows.withColumn("copy", F.explode(F.when(day() == 7, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("copy")


def forecast_types(spark: SparkSession, sf: str) -> DataFrame:
    """All columns as text, with forecasts that are no numbers on the 3rd and dates that are none on the 4th."""
    text = _har(spark, sf).select(*(F.col(c).cast("string").alias(c) for c in checks.REQUIRED)).withColumn("__day", F.substring("target_date", 9, 2))
    text = text.withColumn("forecast", F.when(F.col("__day") == "03", F.lit("none")).otherwise(F.col("forecast")))
    text = text.withColumn("forecast_origin_date", F.when(F.col("__day") == "04", F.lit("soon")).otherwise(F.col("forecast_origin_date"))).drop("__day")
    return checks.standard(text).transform(rounded)


def nonfinite_forecast_rows(spark: SparkSession, sf: str) -> DataFrame:
    return checks.nonfinite_rows(_faulty(spark, sf)).transform(rounded)


def inconsistent_forecast_rows(spark: SparkSession, sf: str) -> DataFrame:
    return checks.inconsistent_rows(_faulty(spark, sf)).select(*KEYS)


def duplicate_forecast_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return checks.duplicate_pairs(_faulty(spark, sf))


def faulty_model_checks(spark: SparkSession, sf: str) -> DataFrame:
    """The check table of the faulty forecasts."""
    return checks.model_checks(checks.model_summary(_faulty(spark, sf).withColumn("model", F.lit("HAR"))))


def faulty_model_differences(spark: SparkSession, sf: str) -> DataFrame:
    """How many identities the faulty forecasts break, and by how much at the most; days without a forecast count but have no size."""
    names = list(checks.differences())
    found = checks.model_summary(_faulty(spark, sf).withColumn("model", F.lit("HAR")))
    return found.select("model", *(f"n_{n}_mismatch" for n in names), *(f"max_{n}_difference" for n in names)).transform(rounded)


def universe_difference_rows(spark: SparkSession, sf: str) -> DataFrame:
    by = ("training_window",)
    return checks.universe_differences(checks.presence(panels.losses(spark, sf), panels.MODELS, by), panels.MODELS, "HAR", "pair", by)


def mismatch_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the pairs whose actual value, in one model one higher on the 6th, differs between models."""
    by = ("training_window",)
    moved = panels.losses(spark, sf).withColumn("actual", F.when((F.col("model") == "HAR-X") & (day() == 6), F.col("actual") + 1).otherwise(F.col("actual")))
    return checks.mismatch_rows(moved, checks.presence(moved, panels.MODELS, by), len(panels.MODELS), 1e-6, by).select("training_window", "model", "ticker", "target_date", "actual").transform(rounded)


def test_shares_to_plot(spark: SparkSession, sf: str) -> DataFrame:
    return significance.shares_to_plot(panels.dmw_summary(spark, sf), ["HAR", "HAR-X"])


def forecastability_panel(spark: SparkSession, sf: str) -> DataFrame:
    p = panels.panel(spark, sf)
    rows = rolling.forecastability(p, panels.tickers(spark, sf, p), [panels.BIG])
    return rows.select("training_window", "component", "ticker", "sector", "forecast_origin_date", "actual", "forecast", "baseline_forecast").transform(rounded)


_r, _loss = panels._r, panels._LOSS
_FAULTY = panels._HAR_F | {
    "clean_": f"SELECT *, {_loss} FROM harf WHERE training_window = {panels.BIG}",
    "faulty": """SELECT ticker, forecast_origin_date, target_date, actual, CASE WHEN day(target_date) <> 10 THEN forecast END AS forecast, error, squared_error, absolute_error,
        CASE WHEN day(target_date) = 5 THEN qlike + 1 ELSE qlike END AS qlike FROM clean_, range(2) k(k) WHERE k = 0 OR day(target_date) = 7""",
}
_NUMBERS = [c for c in checks.NUMBERS if c != "forecast"]
_rs = lambda names: ", ".join(_r(n) for n in names)
_ZERO = lambda name, label, count: f"SELECT 'HAR' AS model, '{name}' AS check_name, CASE WHEN {count} = 0 THEN 'PASS' ELSE 'FAIL' END AS status, 'fatal' AS severity, '{label}: ' || {count} AS details FROM counts"
_IDENTITIES = {"error": "actual - forecast", "squared_error": "pow(actual - forecast, 2)", "absolute_error": "abs(actual - forecast)", "qlike": "exp(actual - forecast) - (actual - forecast) - 1"}
ORACLE_SQL = {
    "forecast_types": panels._sql(
        f"SELECT ticker, CASE WHEN day(target_date) <> 4 THEN forecast_origin_date END AS forecast_origin_date, target_date, {_r('CASE WHEN day(target_date) <> 3 THEN forecast END', 'forecast')}, {_rs(_NUMBERS)} FROM clean_", _FAULTY
    ),
    "nonfinite_forecast_rows": panels._sql(f"SELECT ticker, forecast_origin_date, target_date, CAST(NULL AS DOUBLE) AS forecast, {_rs(_NUMBERS)} FROM faulty WHERE forecast IS NULL", _FAULTY),
    "inconsistent_forecast_rows": panels._sql("SELECT ticker, forecast_origin_date, target_date FROM faulty WHERE day(target_date) IN (5, 10)", _FAULTY),
    "duplicate_forecast_pairs": panels._sql("SELECT ticker, target_date, CAST(2 AS BIGINT) AS n_rows FROM clean_ WHERE day(target_date) = 7", _FAULTY),
    "faulty_model_checks": panels._sql(
        " UNION ALL ".join(
            [
                "SELECT 'HAR' AS model, 'Required columns' AS check_name, 'PASS' AS status, 'fatal' AS severity, 'Columns all there' AS details",
                _ZERO("Missing key values", "Rows lacking a key", "0"),
                _ZERO("Finite numerical values", "Rows with a number that is not finite", "ten"),
                _ZERO("Duplicated ticker-date pairs", "Pairs met more than once", "seven"),
                _ZERO("Forecast origin before target date", "Rows whose origin is no earlier than the target", "0"),
                _ZERO("Error identity", "Error mismatches", "ten"),
                _ZERO("Squared error identity", "Squared error mismatches", "ten"),
                _ZERO("Absolute error identity", "Absolute error mismatches", "ten"),
                _ZERO("QLIKE identity", "QLIKE mismatches", "(ten + five)"),
            ]
        ),
        _FAULTY | {"counts": "SELECT count(*) FILTER (day(target_date) = 10) AS ten, count(*) FILTER (day(target_date) = 7) AS seven, count(*) FILTER (day(target_date) = 5) AS five FROM clean_"},
    ),
    "faulty_model_differences": panels._sql(
        "SELECT 'HAR' AS model, " + ", ".join(f"count(*) FILTER (day(target_date) = 10{' OR day(target_date) = 5' if n == 'qlike' else ''}) AS n_{n}_mismatch, {_r(f'max(abs({n} - ({e})))', f'max_{n}_difference')}" for n, e in _IDENTITIES.items()) + " FROM faulty",
        _FAULTY,
    ),
    "universe_difference_rows": panels._sql(
        """SELECT CAST(training_window AS INTEGER) AS training_window, ticker, target_date, model, CASE WHEN i0 THEN 'missing' ELSE 'extra' END AS kind
        FROM (SELECT *, 'HAR-X' AS model, i1 AS i FROM seen UNION ALL SELECT *, 'RELATIVE', i2 FROM seen) WHERE i <> i0""",
        panels._ALL | panels._SEEN,
    ),
    "mismatch_rows": panels._sql(
        f"""SELECT CAST(training_window AS INTEGER) AS training_window, model, ticker, target_date, {_r("CASE WHEN model = 'HAR-X' THEN actual + 1 ELSE actual END", "actual")}
        FROM alls SEMI JOIN (SELECT training_window, ticker, target_date FROM seen WHERE k = 3 AND day(target_date) = 6) USING (training_window, ticker, target_date)""",
        panels._ALL | panels._SEEN,
    ),
    "test_shares_to_plot": f"""SELECT training_window, benchmark_model, metric, CASE metric WHEN 'mse' THEN 'MSE' WHEN 'absolute_error' THEN 'MAE' ELSE upper(metric) END AS metric_label,
        pct_significant_improvement AS share FROM ({panels.ORACLE_SQL["dmw_summary"]}) WHERE pct_significant_improvement IS NOT NULL""",
    "forecastability_panel": panels._sql(
        f"SELECT CAST(training_window AS INTEGER) AS training_window, component, ticker, sector, forecast_origin_date, {_r('act', 'actual')}, {_r('f', 'forecast')}, {_r('base', 'baseline_forecast')} FROM dated",
        panels._R2 | {"dated": """SELECT f.*, b.base, t.sector, t.date AS forecast_origin_date,
            CASE f.component WHEN 'stock_log_rv' THEN y1 WHEN 'market_log_rv' THEN m1 WHEN 'sector_etf_log_rv' THEN s1 WHEN 'sector_perp' THEN sp1 ELSE q1 END AS act
            FROM (SELECT ticker, training_window, o, component, f FROM fits) f JOIN acts t ON t.ticker = f.ticker AND t.rn = f.o JOIN bases b ON b.ticker = f.ticker AND b.o = f.o AND b.component = f.component"""},
    ),
}
QUERIES = {name: globals()[name] for name in ORACLE_SQL}
