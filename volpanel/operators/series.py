"""Ticker-days as rows: observed bars stay one array a day, and the grid is never built.

A day's closes are runs: each observed close holds until the next one, and the day begins with the close carried over from
days before. Returns differ from zero at most where a run begins, so that a minute's zero returns are counted from the borders of
runs. Only numbers a ticker-day are carried along a ticker, in blocks of a month; everything else stays within its row.

A series is (ticker, date, bars, opening): bars an array of (m, close) by m, opening the close before the day's first bar.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volpanel.functions.columns import finite

BARS = "array<struct<m:int,close:double>>"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def observed(bars: DataFrame) -> DataFrame:
    """(ticker, date, bars) of observed closes (ticker, date, m, close), one bar a slot."""
    seen = F.when(F.col("close").isNotNull(), F.struct(F.col("m").cast("int").alias("m"), F.col("close").cast("double").alias("close")))
    return bars.groupBy("ticker", "date").agg(F.array_sort(F.collect_list(seen)).alias("bars"))


def block_of(date: str) -> Column:
    """Blocks of days that one window orders: months."""
    return F.date_trunc("month", date).cast("date")


def carried(days: DataFrame, value: str, out: str) -> DataFrame:
    """days (ticker, date, __head, ...) with `out`: the last known value of the days before, else the ticker's first known __head.

    Within a month one window carries it; over months, one row each is carried along the ticker.
    """
    inside = Window.partitionBy("ticker", "__block").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("__block", block_of("date"))
    known = F.when(F.col(value).isNotNull(), F.col("date"))
    blocks = days.groupBy("ticker", "__block").agg(F.max_by(value, known).alias("__last"), F.min_by("__head", known).alias("__first"))
    along = Window.partitionBy("ticker").orderBy("__block")
    before = F.last("__last", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    first = F.first("__first", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    blocks = blocks.select(F.col("ticker").alias("__ticker"), F.col("__block").alias("__at"), F.coalesce(before, first).alias("__carried"))
    days = days.withColumn(out, F.last(value, ignorenulls=True).over(inside))
    days = days.join(blocks, (F.col("ticker") == F.col("__ticker")) & (F.col("__block") == F.col("__at")), "left")
    return days.withColumn(out, F.coalesce(out, "__carried")).drop("__block", "__ticker", "__at", "__carried", "__head")


def opened(seen: DataFrame, days: DataFrame, tickers: DataFrame, per_day: int) -> DataFrame:
    """Series of every ticker on every day: a row a ticker-day, with bars of the grid alone."""
    pairs = days.select("date").distinct().crossJoin(F.broadcast(tickers.select("ticker").distinct()))  # a row per day and ticker, not per minute
    on_grid = F.filter("bars", lambda b: (b["m"] >= 0) & (b["m"] < per_day))
    rows = pairs.join(seen.withColumn("bars", on_grid), ["ticker", "date"], "left").withColumn("bars", F.coalesce("bars", F.array().cast(BARS)))
    rows = rows.withColumn("__close", F.get("bars", F.size("bars") - 1)["close"]).withColumn("__head", F.get("bars", F.lit(0))["close"])
    return carried(rows, "__close", "opening").select("ticker", "date", "bars", "opening")


def runs(per_day: int) -> Column:
    """(from, to, close) of a series' row, from the first minute to the last: the close that holds there."""
    bar = lambda m, close: F.struct(m.cast("int").alias("m"), close.alias("close"))
    starts_late = F.coalesce(F.get("bars", F.lit(0))["m"] > 0, F.lit(True))
    headed = F.when(starts_late, F.concat(F.array(bar(F.lit(0), F.col("opening"))), F.col("bars"))).otherwise(F.col("bars"))
    return let(headed, lambda h: F.transform(h, lambda b, i: F.struct(b["m"].alias("from"), (F.coalesce(F.get(h, i + 1)["m"], F.lit(per_day)) - 1).alias("to"), b["close"].alias("close"))))


def filled(series: DataFrame, per_day: int) -> DataFrame:
    """(ticker, date, m, close) of every minute, for those who want it."""
    rows = series.select("ticker", "date", F.explode(runs(per_day)).alias("run"))
    return rows.select("ticker", "date", F.explode(F.sequence("run.from", "run.to")).alias("m"), F.col("run.close").alias("close"))


def price_counts(series: DataFrame, per_day: int) -> DataFrame:
    """Counts of the panel before it is filled: slots without a close, infinite ones, zeros."""
    some = lambda f: F.sum(F.size(F.filter("bars", f))).alias
    c = lambda b: b["close"]
    missing = F.sum(per_day - F.size("bars") + F.size(F.filter("bars", lambda b: F.isnan(c(b)))))
    return series.agg(missing.alias("n_na"), some(lambda b: F.abs(c(b)) == float("inf"))("n_inf"), some(lambda b: c(b) == 0)("n_zero"))


def check_days(series: DataFrame, days: DataFrame) -> DataFrame:
    """series, or ValueError if some ticker has not one row a day: the grid's assertion without the grid."""
    n = days.select("date").distinct().count()
    odd = series.groupBy("ticker").agg(F.count("*").alias("n"), F.count_distinct("date").alias("days")).where((F.col("n") != n) | (F.col("days") != n)).limit(1).collect()
    if odd:
        raise ValueError(f"{odd[0].n} rows of {odd[0].ticker} on {odd[0].days} days, {n} days expected")
    return series


def _log(close: Column) -> Column:
    return F.when(close > 0, F.log(close))


def with_returns(series: DataFrame, per_day: int) -> DataFrame:
    """series with steps: (from, to, r, inside) of each run, r being the return at its first minute and inside that of the others.

    Both are NULL where a log does not exist; r is NULL at the day's first minute.
    """
    logs = F.transform("runs", lambda x: _log(x["close"]))

    def steps(p: Column) -> Column:
        one = lambda x, i: F.struct(x["from"].alias("from"), x["to"].alias("to"), F.when(i > 0, F.get(p, i) - F.get(p, i - 1)).alias("r"), F.when(F.get(p, i).isNotNull(), F.lit(0.0)).alias("inside"))
        return F.transform("runs", one)

    return series.withColumn("runs", runs(per_day)).withColumn("steps", let(logs, steps)).drop("runs")


def long_returns(series: DataFrame, *more: str) -> DataFrame:
    """(ticker, date, more, m, r) of every minute of a series with returns."""
    rows = series.select("ticker", "date", *more, F.explode("steps").alias("x")).select("ticker", "date", *more, F.explode(F.sequence("x.from", "x.to")).alias("m"), "x")
    return rows.select("ticker", "date", *more, "m", F.when(F.col("m") == F.col("x.from"), F.col("x.r")).otherwise(F.col("x.inside")).alias("r"))


def zero_shares(series: DataFrame, per_day: int) -> DataFrame:
    """(date, m, zero_share) over the tickers, from the borders of runs: a few rows a run, and no ticker's minutes.

    What enters and leaves is summed by (date, m) before it is shuffled; a running sum over a day's minutes counts the rest.
    """
    event = lambda m, zero, n: F.struct(m.alias("m"), zero.cast("long").alias("zero"), n.cast("long").alias("n"))
    one = lambda c: c.cast("int")

    def borders(x: Column) -> Column:
        some, inside = x["r"].isNotNull(), x["inside"].isNotNull()
        zero = F.coalesce(x["r"] == 0, F.lit(False))
        return F.array(event(x["from"], one(zero), one(some)), event(x["from"] + 1, one(inside) - one(zero), one(inside) - one(some)), event(x["to"] + 1, -one(inside), -one(inside)))

    events = series.select("date", F.explode(F.flatten(F.transform("steps", borders))).alias("e")).where(F.col("e.m") < per_day)
    # of a run of one minute the second and third border fall together and cancel what is inside
    summed = events.groupBy("date", F.col("e.m").alias("m")).agg(F.sum("e.zero").alias("zero"), F.sum("e.n").alias("n"))
    day = Window.partitionBy("date").orderBy("m").rowsBetween(Window.unboundedPreceding, 0)
    minutes = series.select("date").distinct().select("date", F.explode(F.sequence(F.lit(0), F.lit(per_day - 1))).alias("m"))
    counted = minutes.join(summed, ["date", "m"], "left").select("date", "m", F.sum(F.coalesce("zero", F.lit(0))).over(day).alias("zero"), F.sum(F.coalesce("n", F.lit(0))).over(day).alias("n"))
    return counted.select("date", "m", F.try_divide("zero", "n").alias("zero_share"))


def opened_market(series: DataFrame, per_day: int, most: float = 0.9) -> DataFrame:
    """series with shut: the minutes, by m, in which the market was in effect closed; more than this share of returns is zero."""
    shut = zero_shares(series, per_day).where(F.col("zero_share") > most).groupBy("date").agg(F.array_sort(F.collect_list("m")).alias("shut"))
    return series.join(shut, "date", "left").withColumn("shut", F.coalesce("shut", F.array().cast("array<int>")))


def open_returns(series: DataFrame) -> DataFrame:
    """(ticker, date, m, r, k) of every minute that is not shut; k is its number from 1 among them."""
    rows = long_returns(series, "shut").where(~F.array_contains("shut", F.col("m")))
    return rows.select("ticker", "date", "m", "r", (F.col("m") + 1 - F.size(F.filter("shut", lambda x: x < F.col("m")))).cast("int").alias("k"))


def day_returns(series: DataFrame) -> DataFrame:
    """(ticker, date, rs): the finite returns of a day in order, without shut minutes, in place of its bars."""
    minutes = F.flatten(F.transform("steps", lambda x: F.transform(F.sequence(x["from"], x["to"]), lambda m: F.struct(m.alias("m"), F.when(m == x["from"], x["r"]).otherwise(x["inside"]).alias("r")))))
    left = F.filter(minutes, lambda x: finite(x["r"]) & ~F.array_contains("shut", x["m"]))
    shut = series if "shut" in series.columns else series.withColumn("shut", F.array().cast("array<int>"))
    return shut.select("ticker", "date", F.transform(left, lambda x: x["r"]).alias("rs"))


def interval_variance(days: DataFrame, k: int, partial: bool = True) -> DataFrame:
    """(ticker, date, rv, n_blocks) of day_returns: block sums within the row; days without blocks have NULL and 0."""
    n = F.ceil(F.size("rs") / F.lit(k)) if partial else F.floor(F.size("rs") / F.lit(k))
    rows = days.withColumn("n_blocks", n.cast("long"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    squares = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n_blocks") - 1, F.lit(0))), lambda b: let(total(F.slice("rs", (b * k + 1).cast("int"), F.lit(k))), lambda s: s * s))
    return rows.select("ticker", "date", F.when(F.col("n_blocks") > 0, total(squares)).alias("rv"), "n_blocks")


def daily_log_rv(days: DataFrame, k: int = 30, partial: bool = False, least_blocks: int = 10) -> DataFrame:
    """(ticker, date, log_rv) of day_returns: NULL unless the variance is positive and of enough blocks."""
    ok = finite("rv") & (F.col("rv") > 0) & (F.col("n_blocks") >= least_blocks)
    return interval_variance(days, k, partial).select("ticker", "date", F.when(ok, F.log("rv")).alias("log_rv"))
