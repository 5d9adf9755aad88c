"""Queries from bars to log variances and signatures, over the intraday stand-in, with their SQL. Doubles are rounded to 6 digits on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volpanel.functions.columns import rounded
from volpanel.operators import clean, series, signature
from volpanel.sources import bars as landing
from volpanel.sources.steps import stored

from . import fixtures as fx

K, LEAST_BLOCKS = 3, 2
INTERVALS, PLATEAU, LEAST_DAYS = list(range(1, 9)), (4, 8), 10


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    """The stand-in's bars, stored: events are scanned once, however often days and tickers are asked for."""
    return stored(fx.ticks(spark, sf), "ticks")


def opened(spark: SparkSession, sf: str) -> DataFrame:
    """All ticker-days with their bars and what they open with."""
    seen = stored(series.observed(fx.ticks(spark, sf)), "ticker-days")
    return series.opened(seen, seen, seen, fx.PER_DAY)


def returns(spark: SparkSession, sf: str) -> DataFrame:
    return series.with_returns(opened(spark, sf), fx.PER_DAY)


def days(spark: SparkSession, sf: str) -> DataFrame:
    return series.day_returns(returns(spark, sf))


def session_filter(spark: SparkSession, sf: str) -> DataFrame:
    t = fx.trades(spark, sf)
    return t.where(landing.in_session(F.hour("ts"), F.minute("ts"))).groupBy("ticker", "date").agg(F.count("*").alias("n"), F.sum("close").alias("total")).transform(rounded)


def bars_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return landing.first_bars(fx.trades(spark, sf), ("ticker", "date", "m")).select("ticker", "date", "m", "close").transform(rounded)


def bad_ticker_days(spark: SparkSession, sf: str) -> DataFrame:
    t = fx.ticks(spark, sf)
    return landing.capped(landing.bad_ticker_days(t, t, t.select("date", "m").distinct(), 0.25, "m"), 50).transform(rounded)


def patch_overlay(spark: SparkSession, sf: str) -> DataFrame:
    """The ticker-days of a ticker's every fifth day of the month are re-delivered, ten times as high and in even slots only."""
    t = fx.ticks(spark, sf)
    patch = t.where((F.dayofmonth("date") % 5 == 0) & (F.col("m") % 2 == 0)).withColumn("close", F.col("close") * 10)
    return landing.overlay(t, t, patch, "m").select("ticker", "date", "m", "close").transform(rounded)


def wide_bars(spark: SparkSession, sf: str) -> DataFrame:
    return landing.wide(fx.ticks(spark, sf).withColumn("slot", F.concat_ws(" ", F.col("date").cast("string"), F.col("m").cast("string"))), [f"T{i}" for i in range(8)], "slot").transform(rounded)


def grid_coverage(spark: SparkSession, sf: str) -> DataFrame:
    t = ticks(spark, sf)
    return clean.coverage(t, fx.days(t), fx.PER_DAY).transform(rounded)


def gap_stats(spark: SparkSession, sf: str) -> DataFrame:
    t = ticks(spark, sf)
    return clean.gap_stats(clean.day_gaps(t, fx.days(t)), 2).transform(rounded)


def filter_universe(spark: SparkSession, sf: str) -> DataFrame:
    t = ticks(spark, sf)
    d = stored(fx.days(t), "days")
    kept = stored(clean.covered(t, d, fx.PER_DAY, 0.82), "covered")
    return clean.ungapped(kept, d, 2, 0.5, 4).groupBy("ticker").agg(F.count("*").alias("n"))


def fill_prices(spark: SparkSession, sf: str) -> DataFrame:
    return series.filled(opened(spark, sf), fx.PER_DAY).transform(rounded)


def fill_panel(spark: SparkSession, sf: str) -> DataFrame:
    """The same from a panel that has a row for every minute."""
    t = ticks(spark, sf)
    return clean.filled(clean.aligned(t, clean.grid(fx.days(t), fx.PER_DAY), t)).transform(rounded)


def log_returns(spark: SparkSession, sf: str) -> DataFrame:
    return series.long_returns(returns(spark, sf)).transform(rounded)


def zero_shares(spark: SparkSession, sf: str) -> DataFrame:
    return series.zero_shares(returns(spark, sf), fx.PER_DAY).transform(rounded)


def early_close(spark: SparkSession, sf: str) -> DataFrame:
    return series.open_returns(series.opened_market(stored(returns(spark, sf), "returns"), fx.PER_DAY, 0.3)).transform(rounded)


def interval_rv(spark: SparkSession, sf: str) -> DataFrame:
    return series.interval_variance(days(spark, sf), K, True).transform(rounded)


def daily_log_rv(spark: SparkSession, sf: str) -> DataFrame:
    return series.daily_log_rv(days(spark, sf), K, False, LEAST_BLOCKS).transform(rounded)


def open_log_rv(spark: SparkSession, sf: str) -> DataFrame:
    """Daily log variances of the returns that early closes leave."""
    left = series.opened_market(stored(returns(spark, sf), "returns"), fx.PER_DAY, 0.3)
    return series.daily_log_rv(series.day_returns(left), K, False, LEAST_BLOCKS).transform(rounded)


def _by(spark: SparkSession, sf: str) -> DataFrame:
    return signature.signature(days(spark, sf), INTERVALS, least_days=LEAST_DAYS)


def _ratios(spark: SparkSession, sf: str) -> DataFrame:
    return signature.ratios(_by(spark, sf), fx.dimension(spark), PLATEAU, LEAST_DAYS)


def signature_by_ticker(spark: SparkSession, sf: str) -> DataFrame:
    return _by(spark, sf).transform(rounded)


def signature_of_tickers(spark: SparkSession, sf: str) -> DataFrame:
    """Of the tickers asked for, those that exist."""
    return signature.signature(days(spark, sf), INTERVALS, ["T1", "T5", "T99"], least_days=LEAST_DAYS).transform(rounded)


def signature_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return _ratios(spark, sf).select("ticker", "sector", "interval_minutes", "mean_rv", "plateau_rv", "rv_ratio").transform(rounded)


def signature_interval_summary(spark: SparkSession, sf: str) -> DataFrame:
    return signature.bands(signature.interval_summary(_ratios(spark, sf))).transform(rounded)


def signature_sector_summary(spark: SparkSession, sf: str) -> DataFrame:
    return signature.bands(signature.sector_summary(_ratios(spark, sf), least_stocks=2)).transform(rounded)


# ---- SQL

_R = lambda e, n: f"round({e}, 6) + 0.0 AS {n}"
_NUMBERED = "SELECT ticker, date, r, row_number() OVER (PARTITION BY ticker, date ORDER BY m) - 1 AS i FROM rets WHERE r IS NOT NULL"
_BLOCKS = f"SELECT ticker, date, i // {K} AS block, sum(r) AS r, count(*) AS n FROM numbered GROUP BY 1, 2, 3"
_RV = {"numbered": _NUMBERED, "blocks": _BLOCKS, "tickerdays": "SELECT DISTINCT ticker, date FROM rets"}
_GAPS = """SELECT ticker, date, coalesce(CAST(max(hole) AS DOUBLE), CAST('inf' AS DOUBLE)) AS gap
  FROM (SELECT DISTINCT ticker FROM {src}) CROSS JOIN days
  LEFT JOIN (SELECT ticker, date, m - lag(m) OVER (PARTITION BY ticker, date ORDER BY m) - 1 AS hole FROM {src}) h USING (ticker, date) GROUP BY 1, 2"""
_STATS = """SELECT ticker, count(*) AS n_days, count(*) FILTER (gap >= 2) AS n_days_big_gap, count(*) FILTER (gap >= 2) / count(*) AS ratio_days_big_gap,
  coalesce(max(gap) FILTER (isfinite(gap)), CAST('inf' AS DOUBLE)) AS max_gap_any_day FROM gaps GROUP BY 1"""
_Q = lambda c, sfx: ", ".join(f"quantile_cont({c}, {q}) AS {n}{sfx}" for n, q in signature.QUANTILES.items())
_SIG = _RV | {
    "cut": """SELECT ticker, date, k, (i // k) AS block, sum(r) AS r FROM numbered, range(1, 9) t(k) GROUP BY 1, 2, 3, 4""",
    "daily": """SELECT td.ticker, td.date, CAST(ks.k AS INTEGER) AS interval_minutes, rv, coalesce(n, 0) AS n_blocks FROM tickerdays td CROSS JOIN range(1, 9) ks(k)
        LEFT JOIN (SELECT ticker, date, k, sum(r * r) AS rv, count(*) AS n FROM cut GROUP BY 1, 2, 3) c ON c.ticker = td.ticker AND c.date = td.date AND c.k = ks.k""",
    "stats": f"""SELECT ticker, interval_minutes, avg(rv) AS mean_rv, median(rv) AS median_daily_rv, {_Q('rv', '_daily_rv')}, count(rv) AS n_days,
        avg(n_blocks) FILTER (n_blocks > 0) AS avg_n_blocks FROM daily GROUP BY 1, 2""",
    "plateau": "SELECT ticker, median(mean_rv) AS plateau_rv FROM stats WHERE interval_minutes BETWEEN 4 AND 8 GROUP BY 1",
    "ratios": """SELECT s.ticker, d.sector, s.interval_minutes, s.mean_rv, p.plateau_rv, s.mean_rv / p.plateau_rv AS rv_ratio
        FROM stats s JOIN plateau p USING (ticker) LEFT JOIN dim d ON d.ticker = s.ticker WHERE s.mean_rv > 0 AND p.plateau_rv > 0 AND s.n_days >= 10""",
}
_SUM = f"""{_R('median(rv_ratio)', 'median_ratio')}, {_R('avg(rv_ratio)', 'mean_ratio')},
  {", ".join(_R(f"quantile_cont(rv_ratio, {q})", f"{n}_ratio") for n, q in signature.QUANTILES.items())},
  {_R('stddev_samp(rv_ratio)', 'sd_ratio')}, count(DISTINCT ticker) AS n_tickers"""
_DAILY = [f"CASE WHEN n_days >= {LEAST_DAYS} THEN {c} END" for c in ("mean_rv", "median_daily_rv", "p10_daily_rv", "p25_daily_rv", "p75_daily_rv", "p90_daily_rv", "avg_n_blocks")]
_NAMES = ("mean_rv", "median_daily_rv", "p10_daily_rv", "p25_daily_rv", "p75_daily_rv", "p90_daily_rv", "avg_n_blocks")
_STATED = "SELECT ticker, interval_minutes, n_days, " + ", ".join(_R(e, n) for e, n in zip(_DAILY, _NAMES, strict=True)) + " FROM stats"
_STATS_ONLY = {k: v for k, v in _SIG.items() if k not in ("plateau", "ratios")}

ORACLE_SQL = {
    "session_filter": fx.sql(f"SELECT ticker, date, count(*) AS n, {_R('sum(close)', 'total')} FROM trades WHERE (hour(ts) > 9 OR (hour(ts) = 9 AND minute(ts) >= 30)) AND hour(ts) < 16 GROUP BY 1, 2", "trades"),
    "bars_dedup": fx.sql(f"SELECT ticker, date, m, {_R('close', 'close')} FROM trades QUALIFY row_number() OVER (PARTITION BY ticker, date, m ORDER BY ingest_seq) = 1", "trades"),
    "bad_ticker_days": fx.sql(
        f"""SELECT date, ticker, {_R('na_share', 'na_share')} FROM (SELECT * FROM shares WHERE na_share >= 0.25
            QUALIFY row_number() OVER (PARTITION BY year(date), quarter(date) ORDER BY date, ticker) <= 50)""",
        "ticks",
        more={
            "shares": """SELECT date, ticker, 1 - coalesce(n, 0) / total AS na_share FROM (SELECT date, count(DISTINCT m) AS total FROM ticks GROUP BY 1)
                CROSS JOIN (SELECT DISTINCT ticker FROM ticks) LEFT JOIN (SELECT date, ticker, count(*) AS n FROM ticks GROUP BY 1, 2) USING (date, ticker)"""
        },
    ),
    "patch_overlay": fx.sql(
        f"SELECT ticker, date, m, {_R('CASE WHEN day(date) % 5 = 0 THEN close * 10 ELSE close END', 'close')} FROM ticks t WHERE day(date) % 5 <> 0 OR m % 2 = 0 OR NOT EXISTS (SELECT 1 FROM ticks p WHERE p.ticker = t.ticker AND p.date = t.date AND p.m % 2 = 0)",
        "ticks",
    ),
    "wide_bars": fx.sql("SELECT date || ' ' || m AS slot, " + ", ".join(f"round(max(close) FILTER (ticker = 'T{i}'), 6) + 0.0 AS T{i}" for i in range(8)) + " FROM ticks GROUP BY 1", "ticks"),
    "grid_coverage": fx.sql(f"SELECT ticker, n * {fx.PER_DAY} AS n_total, count(*) AS n_obs, {_R(f'count(*) / (n * {fx.PER_DAY})', 'coverage')} FROM ticks, (SELECT count(*) AS n FROM days) GROUP BY ticker, n", "days"),
    "gap_stats": fx.sql(f"SELECT ticker, n_days, n_days_big_gap, {_R('ratio_days_big_gap', 'ratio_days_big_gap')}, {_R('max_gap_any_day', 'max_gap_any_day')} FROM stats", "days", more={"gaps": _GAPS.format(src="ticks"), "stats": _STATS}),
    "filter_universe": fx.sql(
        "SELECT ticker, count(*) AS n FROM kept JOIN stats USING (ticker) WHERE ratio_days_big_gap <= 0.5 AND max_gap_any_day < 4 GROUP BY 1",
        "days",
        more={"kept": f"SELECT * FROM ticks WHERE ticker IN (SELECT ticker FROM ticks GROUP BY 1 HAVING count(*) / ((SELECT count(*) FROM days) * {fx.PER_DAY}) >= 0.82)", "gaps": _GAPS.format(src="kept"), "stats": _STATS},
    ),
    "fill_prices": fx.sql(f"SELECT ticker, date, m, {_R('close', 'close')} FROM filled", "filled"),
    "fill_panel": fx.sql(f"SELECT ticker, date, m, {_R('close', 'close')} FROM filled", "filled"),
    "zero_shares": fx.sql(f"SELECT date, m, {_R('count(*) FILTER (r = 0) / nullif(count(r), 0)', 'zero_share')} FROM rets GROUP BY 1, 2", "rets"),
    "open_log_rv": fx.sql(
        f"""SELECT ticker, date, {_R(f'CASE WHEN count(block) >= {LEAST_BLOCKS} AND sum(r * r) > 0 THEN ln(sum(r * r)) END', 'log_rv')}
            FROM (SELECT DISTINCT ticker, date FROM rets) LEFT JOIN (SELECT * FROM blocks WHERE n = {K}) USING (ticker, date) GROUP BY 1, 2""",
        "rets",
        more={
            "shut": "SELECT date, m FROM rets GROUP BY 1, 2 HAVING count(r) > 0 AND count(*) FILTER (r = 0) / nullif(count(r), 0) > 0.3",
            "numbered": _NUMBERED.replace("FROM rets WHERE", "FROM rets WHERE (date, m) NOT IN (SELECT (date, m) FROM shut) AND"),
            "blocks": _BLOCKS,
        },
    ),
    "log_returns": fx.sql(f"SELECT ticker, date, m, {_R('r', 'r')} FROM rets", "rets"),
    "early_close": fx.sql(
        f"SELECT ticker, date, m, {_R('r', 'r')}, CAST(dense_rank() OVER (PARTITION BY date ORDER BY m) AS INTEGER) AS k FROM rets WHERE (date, m) NOT IN (SELECT (date, m) FROM shut)",
        "rets",
        more={"shut": "SELECT date, m FROM rets GROUP BY 1, 2 HAVING count(r) > 0 AND count(*) FILTER (r = 0) / nullif(count(r), 0) > 0.3"},
    ),
    "interval_rv": fx.sql(f"SELECT ticker, date, {_R('sum(r * r)', 'rv')}, count(block) AS n_blocks FROM tickerdays LEFT JOIN blocks USING (ticker, date) GROUP BY 1, 2", "rets", more=_RV),
    "daily_log_rv": fx.sql(
        f"SELECT ticker, date, {_R(f'CASE WHEN count(block) >= {LEAST_BLOCKS} AND sum(r * r) > 0 THEN ln(sum(r * r)) END', 'log_rv')} FROM tickerdays LEFT JOIN (SELECT * FROM blocks WHERE n = {K}) USING (ticker, date) GROUP BY 1, 2",
        "rets",
        more=_RV,
    ),
    "signature_by_ticker": fx.sql(_STATED, "rets", more=_STATS_ONLY),
    "signature_of_tickers": fx.sql(f"{_STATED} WHERE ticker IN ('T1', 'T5')", "rets", more=_STATS_ONLY),
    "signature_ratio": fx.sql(f"SELECT ticker, sector, interval_minutes, {_R('mean_rv', 'mean_rv')}, {_R('plateau_rv', 'plateau_rv')}, {_R('rv_ratio', 'rv_ratio')} FROM ratios", "rets", "dim", more=_SIG),
    "signature_interval_summary": fx.sql(f"SELECT interval_minutes, {_SUM} FROM ratios GROUP BY 1", "rets", "dim", more=_SIG),
    "signature_sector_summary": fx.sql(
        f"""SELECT *, sector || ' (n = ' || max(n_tickers) OVER (PARTITION BY sector) || ')' AS sector_label
            FROM (SELECT sector, interval_minutes, {_SUM} FROM ratios WHERE sector IN (SELECT sector FROM ratios GROUP BY 1 HAVING count(DISTINCT ticker) >= 2) GROUP BY 1, 2)""",
        "rets", "dim", more=_SIG,
    ),
}

QUERIES = {name: globals()[name] for name in ORACLE_SQL}
