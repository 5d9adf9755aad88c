"""Realised variance of interval returns, and the daily log-variance panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from volpanel.functions.columns import blank, finite


def interval_returns(returns: DataFrame, k: int, partial: bool = True) -> DataFrame:
    """(ticker, date, block, r): sums of k consecutive finite returns; the last, shorter block stays or goes."""
    numbered = returns.where(finite("r")).withColumn("block", F.floor((F.row_number().over(Window.partitionBy("ticker", "date").orderBy("m")) - 1) / k).cast("int"))
    blocks = numbered.groupBy("ticker", "date", "block").agg(F.sum("r").alias("r"), F.count("*").alias("n"))
    return (blocks if partial else blocks.where(F.col("n") == k)).drop("n")


def interval_variance(returns: DataFrame, k: int, partial: bool = True) -> DataFrame:
    """(ticker, date, rv, n_blocks) of every ticker-day of returns; days without blocks have NULL and 0."""
    rv = interval_returns(returns, k, partial).groupBy("ticker", "date").agg(F.sum(F.col("r") * F.col("r")).alias("rv"), F.count("*").alias("n_blocks"))
    days = returns.select("ticker", "date").distinct()
    return days.join(rv, ["ticker", "date"], "left").withColumn("n_blocks", F.coalesce("n_blocks", F.lit(0)))


def daily_log_rv(returns: DataFrame, k: int = 30, partial: bool = False, least_blocks: int = 10) -> DataFrame:
    """(ticker, date, log_rv): NULL unless the variance is positive and of enough blocks."""
    ok = finite("rv") & (F.col("rv") > 0) & (F.col("n_blocks") >= least_blocks)
    return interval_variance(returns, k, partial).select("ticker", "date", F.when(ok, F.log("rv")).alias("log_rv"))


def bad_benchmark_dates(panel: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Dates on which a benchmark that the panel has is missing or not finite."""
    present = panel.join(benchmarks.select("ticker").distinct(), "ticker", "left_semi")
    n = present.select(F.count_distinct("ticker").alias("n"))
    good = present.groupBy("date").agg(F.count_if(finite("log_rv")).alias("n_good"))
    return panel.select("date").distinct().join(good, "date", "left").crossJoin(F.broadcast(n)).where(F.coalesce("n_good", F.lit(0)) < F.col("n")).select("date")


def without_bad_dates(panel: DataFrame, benchmarks: DataFrame) -> DataFrame:
    return panel.join(bad_benchmark_dates(panel, benchmarks), "date", "left_anti")


def without_tickers(panel: DataFrame, names: list[str]) -> DataFrame:
    return panel.where(~F.col("ticker").isin(names)) if names else panel


def eligible(panel: DataFrame, dimension: DataFrame, market: str) -> DataFrame:
    """(ticker, sector, sector_etf, market_ticker) of stocks that the panel has together with their funds; each pair once."""
    have = panel.select("ticker").distinct()
    if have.where(F.col("ticker") == market).isEmpty():
        raise ValueError(f"market ticker {market} is not in the panel")
    out = dimension.where(~blank("ticker") & ~blank("sector_etf")).join(have, "ticker", "left_semi")
    out = out.join(have.withColumnRenamed("ticker", "sector_etf"), "sector_etf", "left_semi").dropDuplicates(["ticker", "sector_etf"])
    return out.select("ticker", "sector", "sector_etf", F.lit(market).alias("market_ticker"))
