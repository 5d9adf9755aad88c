"""Trailing-mean features of log-variance series (ticker, date, log_rv) in which every series has every date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from volpanel.functions.columns import all_finite, blank, clean, finite

LAGS = (1, 5, 22)
HAR = ("daily", "weekly", "monthly")
HARX = tuple(f"{who}_{f}" for who in ("stock", "market", "sector") for f in HAR)


def by_ticker() -> WindowSpec:
    return Window.partitionBy("ticker").orderBy("date")


def trailing_mean(c: str, rows: int, until: int = 0) -> Column:
    """Mean of `rows` rows that end `until` rows from here, NULL unless all are finite."""
    frame = by_ticker().rowsBetween(until - rows + 1, until)
    return F.when(F.count(clean(c)).over(frame) == rows, F.avg(clean(c)).over(frame))


def check_lags(lags: tuple[int, ...]) -> tuple[int, ...]:
    if len(lags) != 3 or any(x < 1 or x != int(x) for x in lags):
        raise ValueError(f"three positive whole lags are needed, not {lags}")
    return lags


def means(panel: DataFrame, lags: tuple[int, ...] = LAGS) -> DataFrame:
    """(ticker, date, log_rv, daily, weekly, monthly, target, target_date): one hash by ticker serves all windows."""
    check_lags(lags)
    return panel.select(
        "ticker", "date", "log_rv", *(trailing_mean("log_rv", n).alias(f) for n, f in zip(lags, HAR, strict=True)),
        F.lead("log_rv").over(by_ticker()).alias("target"), F.lead("date").over(by_ticker()).alias("target_date"), F.row_number().over(by_ticker()).alias("__n"),
    ).where(F.col("__n") >= max(lags)).drop("__n")


def har_rows(panel: DataFrame, lags: tuple[int, ...] = LAGS) -> DataFrame:
    """(ticker, origin_date, target_date, target, daily, weekly, monthly), finite in all."""
    return means(panel, lags).where(all_finite(("target", *HAR)) & F.col("target_date").isNotNull()).select("ticker", F.col("date").alias("origin_date"), "target_date", "target", *HAR)


def pairs(tickers: DataFrame) -> DataFrame:
    """Eligible (ticker, sector, sector_etf, market_ticker) without blank ids and repeated pairs."""
    return tickers.where(~blank("ticker") & ~blank("sector_etf")).dropDuplicates(["ticker", "sector_etf"])


def harx_rows(panel: DataFrame, tickers: DataFrame, lags: tuple[int, ...] = LAGS) -> DataFrame:
    """Features of stock, market and fund side by side; market and funds are one and a few series, one row a date each."""
    all_rows = means(panel, lags)
    who = pairs(tickers)
    of = lambda name, key: all_rows.select(F.col("ticker").alias(key), "date", *(F.col(f).alias(f"{name}_{f}") for f in HAR))
    market = of("market", "market_ticker").join(F.broadcast(who.select("market_ticker").distinct()), "market_ticker", "left_semi")
    funds = of("sector", "sector_etf").join(F.broadcast(who.select("sector_etf").distinct()), "sector_etf", "left_semi")
    rows = all_rows.join(F.broadcast(who), "ticker")  # the dimension: a row per ticker
    rows = rows.select("ticker", "sector", "sector_etf", "market_ticker", F.col("date").alias("origin_date"), "target_date", "target", *(F.col(f).alias(f"stock_{f}") for f in HAR))
    # no hint: the planner broadcasts these series if they are small and shuffles by (series, date) if not
    rows = rows.join(market.withColumnRenamed("date", "origin_date"), ["market_ticker", "origin_date"]).join(funds.withColumnRenamed("date", "origin_date"), ["sector_etf", "origin_date"])
    ids = ("ticker", "sector", "sector_etf", "market_ticker", "origin_date", "target_date", "target")
    return rows.where(all_finite(("target", *HARX)) & F.col("target_date").isNotNull()).select(*ids, *HARX)


def component_rows(panel: DataFrame, tickers: DataFrame) -> DataFrame:
    """(ticker, sector, sector_etf, market_ticker, date, y, m, s): stock, market and fund on the dates on which all are finite."""
    who = pairs(tickers)
    good = panel.where(finite("log_rv"))
    market = good.select(F.col("ticker").alias("market_ticker"), "date", F.col("log_rv").alias("m")).join(F.broadcast(who.select("market_ticker").distinct()), "market_ticker", "left_semi")
    funds = good.select(F.col("ticker").alias("sector_etf"), "date", F.col("log_rv").alias("s")).join(F.broadcast(who.select("sector_etf").distinct()), "sector_etf", "left_semi")
    rows = good.join(F.broadcast(who), "ticker").withColumnRenamed("log_rv", "y")
    return rows.join(market, ["market_ticker", "date"]).join(funds, ["sector_etf", "date"]).select("ticker", "sector", "sector_etf", "market_ticker", "date", "y", "m", "s")


def rolling_baseline(panel: DataFrame, window: int) -> DataFrame:
    """(ticker, date, baseline): mean of the `window` values before, all of them finite."""
    return panel.select("ticker", "date", "log_rv", trailing_mean("log_rv", window, -1).alias("baseline"))
