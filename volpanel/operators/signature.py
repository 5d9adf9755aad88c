"""Volatility signature: realised variance by sampling interval, normalised and summarised."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volpanel.functions.columns import blank, finite

DAILY = "array<struct<interval_minutes:int,rv:double,n_blocks:int>>"
QUANTILES = {"p10": 0.10, "p25": 0.25, "p75": 0.75, "p90": 0.90}


def day_variances(returns: np.ndarray, intervals: list[int], partial: bool) -> list[tuple[int, float | None, int]]:
    """(interval, variance, blocks) of one ticker-day: block sums are differences of one running sum."""
    total = np.concatenate([[0.0], np.cumsum(returns)])
    out = []
    for k in intervals:
        ends = np.arange(0, len(returns) + 1, k)
        if partial and ends[-1] < len(returns):
            ends = np.append(ends, len(returns))
        n = len(ends) - 1
        out.append((k, float(np.square(np.diff(total[ends])).sum()) if n else None, n))
    return out


def daily_signature(returns: DataFrame, intervals: list[int], partial: bool = True) -> DataFrame:
    """(ticker, date, interval_minutes, rv, n_blocks). One array a ticker-day goes to a helper, instead of each return to every interval.

    returns are rows (ticker, date, m, r), or days (ticker, date, rs) whose finite returns are already one array.
    """

    @F.pandas_udf(DAILY)
    def variances(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for days in batches:
            yield pd.Series([[{"interval_minutes": k, "rv": rv, "n_blocks": n} for k, rv, n in day_variances(np.asarray(d, float), intervals, partial)] for d in days], dtype=object)

    rs = F.sort_array(F.collect_list(F.when(finite("r"), F.struct("m", "r"))))["r"].alias("rs")
    one = returns if "rs" in returns.columns else returns.groupBy("ticker", "date").agg(rs)
    rows = one.select("ticker", "date", F.explode(variances(F.col("rs"))).alias("v"))
    return rows.select("ticker", "date", "v.interval_minutes", "v.rv", "v.n_blocks")


def daily_signature_built_in(returns: DataFrame, intervals: list[int], partial: bool = True) -> DataFrame:
    """The same from built-in functions: a running sum, kept at block ends only, and its differences. For checks."""
    from pyspark.sql import Window

    day = Window.partitionBy("ticker", "date")
    up_to = day.orderBy("m").rowsBetween(Window.unboundedPreceding, 0)
    run = returns.where(finite("r")).select("ticker", "date", F.row_number().over(day.orderBy("m")).alias("i"), F.sum("r").over(up_to).alias("c"), F.count("*").over(day).alias("n"))
    ends = F.filter(F.array(*map(F.lit, intervals)), lambda k: (F.col("i") % k == 0) | ((F.col("i") == F.col("n")) if partial else F.lit(False)))
    cut = run.select("ticker", "date", "i", "c", F.explode(ends).alias("interval_minutes"))
    blocks = cut.withColumn("r", F.col("c") - F.coalesce(F.lag("c").over(Window.partitionBy("ticker", "date", "interval_minutes").orderBy("i")), F.lit(0.0)))
    found = blocks.groupBy("ticker", "date", "interval_minutes").agg(F.sum(F.col("r") * F.col("r")).alias("rv"), F.count("*").cast("int").alias("n_blocks"))
    keys = returns.select("ticker", "date").distinct().select("ticker", "date", F.explode(F.array(*map(F.lit, intervals))).alias("interval_minutes"))
    return keys.join(found, ["ticker", "date", "interval_minutes"], "left").withColumn("n_blocks", F.coalesce("n_blocks", F.lit(0)))


def by_ticker(daily: DataFrame, least_days: int = 50) -> DataFrame:
    """(ticker, interval_minutes, mean_rv, median_daily_rv, p10..p90_daily_rv, n_days, avg_n_blocks); statistics are NULL below least_days."""
    rv = F.when(finite("rv"), F.col("rv"))
    stats = {"mean_rv": F.avg(rv), "median_daily_rv": F.median(rv)} | {f"{n}_daily_rv": F.percentile(rv, q) for n, q in QUANTILES.items()}
    blocks = F.avg(F.when(F.col("n_blocks") > 0, F.col("n_blocks")))
    out = daily.groupBy("ticker", "interval_minutes").agg(*(v.alias(n) for n, v in stats.items()), F.count(rv).alias("n_days"), blocks.alias("avg_n_blocks"))
    enough = F.col("n_days") >= least_days
    return out.select("ticker", "interval_minutes", *(F.when(enough, F.col(n)).alias(n) for n in stats), "n_days", F.when(enough, F.col("avg_n_blocks")).alias("avg_n_blocks"))


def signature(returns: DataFrame, intervals: list[int], tickers: list[str] | None = None, partial: bool = True, least_days: int = 50) -> DataFrame:
    """by_ticker of the requested tickers that exist; ValueError if none does."""
    chosen = returns if tickers is None else returns.where(F.col("ticker").isin(tickers))
    if tickers is not None and chosen.isEmpty():
        raise ValueError("none of the tickers has returns")
    return by_ticker(daily_signature(chosen, intervals, partial), least_days)


def ratios(by: DataFrame, dimension: DataFrame, plateau: tuple[int, int] = (40, 70), least_days: int = 50, drop_invalid: bool = True) -> DataFrame:
    """by_ticker rows with the plateau (median of mean_rv over its intervals), rv_ratio to it, and the sector."""
    inside = F.col("interval_minutes").between(*plateau)
    level = by.where(inside & finite("mean_rv")).groupBy("ticker").agg(F.median("mean_rv").alias("plateau_rv"))
    good = finite("plateau_rv") & (F.col("plateau_rv") > 0)
    rows = by.where(finite("mean_rv") & (F.col("mean_rv") > 0) & (F.col("n_days") >= least_days)).join(level, "ticker", "left")
    rows = rows.withColumn("rv_ratio", F.when(good, F.col("mean_rv") / F.col("plateau_rv")))
    rows = rows.where(good & finite("rv_ratio")) if drop_invalid else rows
    return rows.join(F.broadcast(dimension.select("ticker", "sector").dropDuplicates(["ticker"])), "ticker", "left")


def _summary(c: Column) -> list[Column]:
    return [
        F.median(c).alias("median_ratio"), F.avg(c).alias("mean_ratio"), *(F.percentile(c, q).alias(f"{n}_ratio") for n, q in QUANTILES.items()),
        F.stddev_samp(c).alias("sd_ratio"), F.count_distinct("ticker").alias("n_tickers"),
    ]


def interval_summary(ratio_rows: DataFrame, ratio: str = "rv_ratio") -> DataFrame:
    return ratio_rows.where(finite(ratio)).groupBy("interval_minutes").agg(*_summary(F.col(ratio)))


def sector_summary(ratio_rows: DataFrame, ratio: str = "rv_ratio", least_stocks: int = 10, drop_missing: bool = True) -> DataFrame:
    """By (sector, interval), of sectors with at least this many tickers in all."""
    rows = ratio_rows.where(finite(ratio))
    rows = rows.where(~blank("sector")) if drop_missing else rows
    sizes = rows.groupBy("sector").agg(F.count_distinct("ticker").alias("n_in_sector")).where(F.col("n_in_sector") >= least_stocks)
    return rows.join(sizes, rows["sector"].eqNullSafe(sizes["sector"]), "left_semi").groupBy("sector", "interval_minutes").agg(*_summary(F.col(ratio)))


def bands(summary: DataFrame, low: str = "p25_ratio", high: str = "p75_ratio") -> DataFrame:
    """Plot-ready: rows with finite median and band; sectors get the label "sector (n = k)" of their largest count."""
    from pyspark.sql import Window

    rows = summary.where(finite("median_ratio") & finite(low) & finite(high))
    if "sector" not in rows.columns:
        return rows
    n = F.max("n_tickers").over(Window.partitionBy("sector"))
    return rows.withColumn("sector_label", F.concat("sector", F.lit(" (n = "), n.cast("string"), F.lit(")")))
