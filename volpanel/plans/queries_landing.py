"""Queries of the landing operators over the given tables, with their SQL. Doubles are rounded to 6 digits on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volpanel.functions.columns import rounded
from volpanel.operators import clean, series
from volpanel.sources import bars as landing
from volpanel.sources.steps import stored

from . import fixtures as fx

FIRST, LAST = "2024-01-05", "2024-01-20"


def payload_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Events as payloads of a ticker's day, read as bars of the exchange's session; a few numbers of each ticker-day."""
    t = fx.trades(spark, sf).withColumn("t", F.unix_millis(F.col("ts").cast("timestamp")))
    payloads = t.groupBy("ticker", "date").agg(F.collect_list(F.struct("t", F.col("close").alias("c"))).alias("results")).select("ticker", "results")
    bars = landing.session_bars(landing.exploded(payloads))
    return bars.groupBy("ticker", "date").agg(F.count("*").alias("n"), F.sum("close").alias("total"), F.min(F.hour("ts") * 60 + F.minute("ts")).alias("first_minute")).transform(rounded)


def ticker_universe(spark: SparkSession, sf: str) -> DataFrame:
    return landing.universe(fx.read(spark, sf, "nation").select(F.col("n_name").alias("symbol")), fx.read(spark, sf, "region").select(F.col("r_name").alias("symbol")), 20)


def fallback_universe(spark: SparkSession, sf: str) -> DataFrame:
    return landing.universe(fx.read(spark, sf, "region").select(F.col("r_name").alias("symbol")), fx.read(spark, sf, "nation").select(F.col("n_name").alias("symbol")), 20)


def _dimension(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as tickers, the first supplier's number choosing the sector; one ticker is unknown."""
    sectors = F.array(*(F.lit(s) for s, _ in landing.SECTOR_FUNDS))
    nation = fx.read(spark, sf, "nation").select(F.col("n_name").alias("ticker"), "n_nationkey")
    known = fx.read(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    known = known.select("ticker", F.element_at(sectors, (F.col("s_suppkey") % len(landing.SECTOR_FUNDS) + 1).cast("int")).alias("sector"), "s_suppkey")
    wanted = nation.select("ticker").union(spark.createDataFrame([("UNKNOWN",)], "ticker string"))
    return landing.add_sector_fund(landing.attach_sector(wanted, known, ["s_suppkey"]), landing.sector_funds(spark)).select("ticker", "sector", "sector_etf")


def sector_dimension(spark: SparkSession, sf: str) -> DataFrame:
    return _dimension(spark, sf)


def download_universe(spark: SparkSession, sf: str) -> DataFrame:
    return landing.full_universe(_dimension(spark, sf), "SPY")


def trading_day_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Bars on the days of the market inside the bounds."""
    t = fx.ticks(spark, sf)
    days = landing.trading_days(t.where(F.col("ticker") == fx.MARKET), FIRST, LAST)
    return landing.on_days(t, days).groupBy("ticker", "date").agg(F.count("*").alias("n"), F.sum("close").alias("total")).transform(rounded)


def stacked_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """A chunk of even slots and one of all slots with other closes and one more column: the first chunk's bars win."""
    t = fx.ticks(spark, sf)
    first, second = t.where(F.col("m") % 2 == 0), t.withColumn("close", F.col("close") * 2).withColumn("late", F.lit(1))
    return landing.stack([first, second], ("ticker", "date", "m")).select("ticker", "date", "m", "close", "late").transform(rounded)


def missing_series(spark: SparkSession, sf: str) -> DataFrame:
    """Of the tickers that the users modulo 11 name, those that the panel lacks."""
    required = fx.read(spark, sf, "events").select(F.concat(F.lit("T"), (F.col("user_id") % 11).cast("string")).alias("ticker"))
    return landing.missing_series(fx.ticks(spark, sf), required)


def sample_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Bounds of the sample and counts of faulty prices on the grid."""
    seen = stored(series.observed(fx.ticks(spark, sf)), "ticker-days")
    full = series.check_days(series.opened(seen, seen, seen, fx.PER_DAY), seen)
    return clean.bounds(seen).crossJoin(series.price_counts(full, fx.PER_DAY))  # one row each


_FUNDS = ", ".join(f"({i}, '{s}', '{e}')" for i, (s, e) in enumerate(landing.SECTOR_FUNDS))
_DIM = {
    "funds": f"SELECT * FROM (VALUES {_FUNDS}) f(i, sector, sector_etf)",
    "known": f"SELECT n_name AS ticker, arg_min(s_suppkey % {len(landing.SECTOR_FUNDS)}, s_suppkey) AS i FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1",
    "dims": "SELECT t.ticker, f.sector, f.sector_etf FROM (SELECT n_name AS ticker FROM nation UNION ALL SELECT 'UNKNOWN') t LEFT JOIN known k USING (ticker) LEFT JOIN funds f USING (i)",
}
ORACLE_SQL = {
    "payload_bars": fx.sql(
        """SELECT ticker, CAST(l AS DATE) AS date, count(*) AS n, round(sum(close), 6) AS total, CAST(min(hour(l) * 60 + minute(l)) AS INTEGER) AS first_minute
        FROM (SELECT *, ts - INTERVAL 5 HOUR AS l FROM trades) WHERE (hour(l) > 9 OR hour(l) = 9 AND minute(l) >= 30) AND hour(l) < 16 GROUP BY 1, 2""",
        "trades",
    ),
    "ticker_universe": "SELECT DISTINCT n_name AS symbol FROM nation WHERE (SELECT count(DISTINCT n_name) FROM nation) >= 20 UNION ALL SELECT DISTINCT r_name FROM region WHERE (SELECT count(DISTINCT n_name) FROM nation) < 20",
    "fallback_universe": "SELECT DISTINCT n_name AS symbol FROM nation",
    "sector_dimension": fx.sql("SELECT * FROM dims", more=_DIM),
    "download_universe": fx.sql("SELECT ticker FROM dims UNION SELECT sector_etf FROM dims WHERE sector_etf IS NOT NULL UNION SELECT 'SPY'", more=_DIM),
    "trading_day_bars": fx.sql(
        f"""SELECT ticker, date, count(*) AS n, round(sum(close), 6) AS total FROM ticks
        WHERE date BETWEEN '{FIRST}' AND '{LAST}' AND date IN (SELECT date FROM ticks WHERE ticker = '{fx.MARKET}') GROUP BY 1, 2""",
        "ticks",
    ),
    "stacked_chunks": fx.sql("SELECT ticker, date, m, round(CASE WHEN m % 2 = 0 THEN close ELSE close * 2 END, 6) AS close, CAST(CASE WHEN m % 2 = 1 THEN 1 END AS INTEGER) AS late FROM ticks", "ticks"),
    "missing_series": fx.sql("SELECT DISTINCT 'T' || CAST(user_id % 11 AS VARCHAR) AS ticker FROM events WHERE 'T' || CAST(user_id % 11 AS VARCHAR) NOT IN (SELECT ticker FROM ticks)", "ticks"),
    "sample_facts": fx.sql(
        "SELECT (SELECT min(date) FROM ticks) AS first_date, (SELECT max(date) FROM ticks) AS last_date, count(*) FILTER (close IS NULL) AS n_na, count(*) FILTER (isinf(close)) AS n_inf, count(*) FILTER (close = 0) AS n_zero FROM full_panel",
        "full_panel",
    ),
}
QUERIES = {name: globals()[name] for name in ORACLE_SQL}
