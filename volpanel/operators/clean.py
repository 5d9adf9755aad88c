"""Grid alignment, filters and fills of long bars (ticker, date, m, close); m is a bar's number within its session."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from volpanel.functions.columns import INFINITY, finite



def by_day() -> WindowSpec:
    """Functions, because windows need a running session."""
    return Window.partitionBy("ticker", "date").orderBy("m")


def bounds(bars: DataFrame) -> DataFrame:
    return bars.agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def grid(days: DataFrame, per_day: int = 390) -> DataFrame:
    """(date, m): every trading day's bars, m from 0."""
    return days.select("date").distinct().select("date", F.explode(F.sequence(F.lit(0), F.lit(per_day - 1))).alias("m"))


def check_grid(full: DataFrame, per_day: int) -> DataFrame:
    """full, or ValueError if it is not days times bars per day."""
    n, days = full.agg(F.count("*"), F.count_distinct("date")).first()
    if n != days * per_day:
        raise ValueError(f"{n} grid rows, {days * per_day} expected")
    return full


def aligned(bars: DataFrame, full: DataFrame, tickers: DataFrame) -> DataFrame:
    """Every ticker's close at every grid bar, NULL where there is none; bars off the grid go.

    The ticker list is small and broadcast over the grid's rows; the result is as large as the panel itself.
    """
    return full.crossJoin(F.broadcast(tickers.select("ticker").distinct())).join(bars.select("ticker", "date", "m", "close"), ["ticker", "date", "m"], "left")


def on_grid(bars: DataFrame, days: DataFrame, per_day: int) -> DataFrame:
    return bars.where((F.col("m") >= 0) & (F.col("m") < per_day)).join(days.select("date").distinct(), "date", "left_semi")


def coverage(bars: DataFrame, days: DataFrame, per_day: int = 390) -> DataFrame:
    """(ticker, n_total, n_obs, coverage): observed against all bars of the grid, counted without building it."""
    n = days.select(F.count_distinct("date").alias("n_days"))
    seen = on_grid(bars, days, per_day).groupBy("ticker").agg(F.count("close").alias("n_obs"))
    total = (F.col("n_days") * per_day).alias("n_total")
    return seen.crossJoin(F.broadcast(n)).select("ticker", total, "n_obs", (F.col("n_obs") / (F.col("n_days") * per_day)).alias("coverage"))


def covered(bars: DataFrame, days: DataFrame, per_day: int = 390, least: float = 0.9) -> DataFrame:
    return bars.join(coverage(bars, days, per_day).where(F.col("coverage") >= least), "ticker", "left_semi")


def day_gaps(bars: DataFrame, days: DataFrame) -> DataFrame:
    """(ticker, date, gap): longest run of missing bars between observations of a day; fewer than two give infinity."""
    seen = bars.where(F.col("close").isNotNull()).withColumn("hole", F.col("m") - F.lag("m").over(by_day()) - 1)
    per = seen.groupBy("ticker", "date").agg(F.max("hole").alias("hole"))
    pairs = bars.select("ticker").distinct().crossJoin(days.select("date").distinct())  # a row per ticker and day
    return pairs.join(per, ["ticker", "date"], "left").select("ticker", "date", F.coalesce(F.col("hole").cast("double"), F.lit(INFINITY)).alias("gap"))


def gap_stats(gaps: DataFrame, big_gap: int = 10) -> DataFrame:
    """(ticker, n_days, n_days_big_gap, ratio_days_big_gap, max_gap_any_day); infinity counts as big but not in the maximum."""
    big = F.count_if(F.col("gap") >= big_gap)
    largest = F.coalesce(F.max(F.when(finite("gap"), F.col("gap"))), F.lit(INFINITY))
    return gaps.groupBy("ticker").agg(F.count("*").alias("n_days"), big.alias("n_days_big_gap"), (big / F.count("*")).alias("ratio_days_big_gap"), largest.alias("max_gap_any_day"))


def ungapped(bars: DataFrame, days: DataFrame, big_gap: int = 10, most_share: float = 0.10, gap_limit: float = 22) -> DataFrame:
    """Bars of tickers with few days of big gaps (share at most) and no gap as long as the limit (below)."""
    good = gap_stats(day_gaps(bars, days), big_gap).where((F.col("ratio_days_big_gap") <= most_share) & (F.col("max_gap_any_day") < gap_limit))
    return bars.join(good, "ticker", "left_semi")


def filled(panel: DataFrame) -> DataFrame:
    """The last close carried forward over days; what is left at the head gets the ticker's first close.

    Minutes are ordered within a ticker's month; over months one row each, with its last close, is carried along.
    """
    panel = panel.withColumn("__block", F.date_trunc("month", "date").cast("date"))
    inside = Window.partitionBy("ticker", "__block").orderBy("date", "m").rowsBetween(Window.unboundedPreceding, 0)
    known = F.when(F.col("close").isNotNull(), F.struct("date", "m"))
    blocks = panel.groupBy("ticker", "__block").agg(F.max_by("close", known).alias("__last"), F.min_by("close", known).alias("__first"))
    along = Window.partitionBy("ticker").orderBy("__block")
    before = F.last("__last", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    head = F.first("__first", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    blocks = blocks.select("ticker", "__block", F.coalesce(before, head).alias("__carried"))
    carried = panel.withColumn("close", F.last("close", ignorenulls=True).over(inside)).join(blocks, ["ticker", "__block"])
    return carried.withColumn("close", F.coalesce("close", "__carried")).select("ticker", "date", "m", "close")


def price_counts(panel: DataFrame) -> DataFrame:
    """Sanity counts: missing, infinite and zero closes."""
    c = F.col("close")
    return panel.agg(F.count_if(c.isNull() | F.isnan(c)).alias("n_na"), F.count_if(F.abs(c) == INFINITY).alias("n_inf"), F.count_if(c == 0).alias("n_zero"))


def log_returns(panel: DataFrame) -> DataFrame:
    """(ticker, date, m, r): log differences within the day; the first bar of a day has NULL."""
    log = F.when(F.col("close") > 0, F.log("close"))
    return panel.select("ticker", "date", "m", log.alias("p")).select("ticker", "date", "m", (F.col("p") - F.lag("p").over(by_day())).alias("r"))


def zero_shares(returns: DataFrame) -> DataFrame:
    """(date, m, zero_share) of exactly zero returns over the tickers; NULL where none has a return."""
    return returns.groupBy("date", "m").agg(F.try_divide(F.count_if(F.col("r") == 0), F.count("r")).alias("zero_share"))


def open_bars(returns: DataFrame, most: float = 0.9) -> DataFrame:
    """Returns without the bars in which the market was in effect closed: more than this share of returns is zero."""
    closed = zero_shares(returns).where(F.col("zero_share") > most).select("date", "m")
    return returns.join(closed, ["date", "m"], "left_anti")


def renumbered(returns: DataFrame) -> DataFrame:
    """Returns with k, the bar's number from 1 among those that are left of its day."""
    left = returns.select("date", "m").distinct().withColumn("k", F.row_number().over(Window.partitionBy("date").orderBy("m")))
    return returns.join(left, ["date", "m"])
