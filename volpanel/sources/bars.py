"""Landing of intraday bars, ticker dimensions and calendars; bars are long: (ticker, ts, close) and more columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from volpanel.functions.columns import blank, require
from volpanel.sources.steps import stored

PAYLOAD = "ticker string, results array<struct<t: bigint, c: double>>"

#: The fund of each sector.
SECTOR_FUNDS = [
    ("Industrials", "XLI"),
    ("Health Care", "XLV"),
    ("Information Technology", "XLK"),
    ("Utilities", "XLU"),
    ("Financials", "XLF"),
    ("Materials", "XLB"),
    ("Consumer Discretionary", "XLY"),
    ("Real Estate", "XLRE"),
    ("Communication Services", "XLC"),
    ("Consumer Staples", "XLP"),
    ("Energy", "XLE"),
]


def landed(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, results, broken, delivery) of JSON payloads, a line each: broken holds a line that does not parse.

    delivery orders payloads as they came: by their file's time and name, the place of the part that a task reads, the line in it.
    """
    rows = spark.read.schema(f"{PAYLOAD}, broken string").option("columnNameOfCorruptRecord", "broken").json(path)
    file = lambda c: F.col(f"_metadata.{c}")
    line = F.monotonically_increasing_id()  # grows along a part of a file, wherever it is read
    return rows.select("*", F.struct(file("file_modification_time").alias("time"), file("file_path").alias("path"), file("file_block_start").alias("part"), line.alias("line")).alias("delivery"))


def sound(payloads: DataFrame) -> DataFrame:
    return payloads.where(F.col("broken").isNull() & ~blank("ticker")).drop("broken")


def quarantined(payloads: DataFrame) -> DataFrame:
    """(path, ticker, results, broken) of lines that do not parse or name no ticker; without results among them, a line whose results are none would parse."""
    return payloads.where(F.col("broken").isNotNull() | blank("ticker")).select(F.col("delivery.path").alias("path"), "ticker", "results", "broken")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, t, close, ingest_seq, delivery) of landed JSON payloads; payloads without results give no rows."""
    return exploded(sound(landed(spark, path)))


def exploded(payloads: DataFrame) -> DataFrame:
    """(ticker, t, close, ingest_seq) and the delivery, if known: ingest_seq is the place in its payload."""
    more = [c for c in ["delivery"] if c in payloads.columns]
    return payloads.select("ticker", *more, F.posexplode("results").alias("ingest_seq", "r")).select("ticker", F.col("r.t").alias("t"), F.col("r.c").alias("close"), "ingest_seq", *more)


def in_session(hour: Column, minute: Column, start: tuple[int, int] = (9, 30), end_hour: int = 16) -> Column:
    h, m = start
    return ((hour > h) | ((hour == h) & (minute >= m))) & (hour < end_hour)


def session_bars(raw: DataFrame, zone: str = "America/New_York") -> DataFrame:
    """(ticker, ts, date, close): epoch milliseconds as wall-clock time of the exchange, regular session only."""
    local = F.from_utc_timestamp(F.timestamp_millis("t"), zone)
    bars = raw.withColumn("ts", local).where(in_session(F.hour("ts"), F.minute("ts")))
    return bars.select("ticker", "ts", F.to_date("ts").alias("date"), "close", *(c for c in ["ingest_seq", "delivery"] if c in raw.columns))


def universe(primary: DataFrame, fallback: DataFrame, least: int = 400, symbol: str = "symbol") -> DataFrame:
    """Distinct symbols of the primary list if it has at least `least`, else those of the fallback list."""
    names = primary.select(symbol).where(F.col(symbol).isNotNull()).distinct()
    return names if names.count() >= least else fallback.select(symbol).where(F.col(symbol).isNotNull()).distinct()


def first_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of every key in the given order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def attach_sector(tickers: DataFrame, dimension: DataFrame, order: list[str] | None = None) -> DataFrame:
    """tickers with their sector by the dimension's first row of a ticker, as delivered if it has a delivery, else by sector; unknown tickers keep NULL."""
    order = order or [c for c in ["delivery", "sector"] if c in dimension.columns]
    known = first_rows(require(dimension, ["ticker", "sector"]), ["ticker"], order).select("ticker", "sector")
    return tickers.join(known, "ticker", "left")


def sector_funds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SECTOR_FUNDS, "sector string, sector_etf string")


def add_sector_fund(dimension: DataFrame, funds: DataFrame) -> DataFrame:
    return dimension.join(funds, "sector", "left")


def dimension_of(primary: DataFrame, fallback: DataFrame, sectors: DataFrame, least: int = 400, order: list[str] | None = None) -> DataFrame:
    """(ticker, sector, sector_etf) of the universe's tickers: lists of symbols, sectors of tickers, funds of sectors."""
    names = universe(primary, fallback, least).select(F.col("symbol").alias("ticker"))
    return add_sector_fund(attach_sector(names, sectors, order), sector_funds(primary.sparkSession)).select("ticker", "sector", "sector_etf")


def full_universe(dimension: DataFrame, market: str) -> DataFrame:
    """(ticker): stocks, their distinct funds, and the market."""
    stocks = dimension.select("ticker")
    funds = dimension.select(F.col("sector_etf").alias("ticker")).where("ticker IS NOT NULL")
    return stocks.union(funds).distinct().union(dimension.sparkSession.createDataFrame([(market,)], "ticker string")).distinct()


def trading_days(series: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Distinct dates of an index series inside the bounds."""
    days = series.select(F.to_date("date").alias("date")).where("date IS NOT NULL").distinct()
    if start:
        days = days.where(F.col("date") >= F.lit(start).cast("date"))
    return days.where(F.col("date") <= F.lit(end).cast("date")) if end else days


def on_days(bars: DataFrame, days: DataFrame) -> DataFrame:
    return bars.join(days, "date", "left_semi")


def with_quarter(bars: DataFrame) -> DataFrame:
    return bars.withColumn("quarter", F.concat(F.year("date").cast("string"), F.lit("-Q"), F.quarter("date").cast("string")))


def first_bars(bars: DataFrame, keys: tuple[str, ...] = ("ticker", "ts"), order: tuple[str, ...] = ("delivery", "ingest_seq")) -> DataFrame:
    """One bar per ticker and time: the one that came first; between bars that came at once, the lower close."""
    return first_rows(bars, list(keys), [*(c for c in order if c in bars.columns), "close"])


def stack(chunks: list[DataFrame], keys: tuple[str, ...] = ("ticker", "ts")) -> DataFrame:
    """All chunks with missing columns filled by NULL; of equal keys the earliest chunk's bar stays."""
    parts = [c.withColumn("__chunk", F.lit(i)) for i, c in enumerate(chunks)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return first_rows(out, list(keys), ["__chunk"]).drop("__chunk")


def wide(bars: DataFrame, tickers: list[str], key: str = "ts") -> DataFrame:
    """One column per ticker; the list is given, so no pass over the data looks for it."""
    return bars.groupBy(key).pivot("ticker", tickers).agg(F.first("close", ignorenulls=True))


def bad_ticker_days(bars: DataFrame, tickers: DataFrame, times: DataFrame, least_share: float = 0.90, time: str = "ts") -> DataFrame:
    """(date, ticker, na_share) where at least this share of a day's times has no close. times: (date, time) of the panel."""
    seen = bars.where(F.col("close").isNotNull()).groupBy("date", "ticker").agg(F.count("*").alias("n"))
    total = times.groupBy("date").agg(F.count("*").alias("total"))
    pairs = total.crossJoin(F.broadcast(tickers.select("ticker").distinct()))  # a row per day and ticker, not per time
    share = 1 - F.coalesce("n", F.lit(0)) / F.col("total")
    return pairs.join(seen, ["date", "ticker"], "left").select("date", "ticker", share.alias("na_share")).where(F.col("na_share") >= least_share)


def capped(pairs: DataFrame, most: int = 200) -> DataFrame:
    """The first pairs of every quarter by (date, ticker); the cap is the operator's feature."""
    rank = F.row_number().over(Window.partitionBy("quarter").orderBy("date", "ticker"))
    return with_quarter(pairs).withColumn("__rank", rank).where(F.col("__rank") <= most).drop("__rank", "quarter")


def overlay(bars: DataFrame, times: DataFrame, patch: DataFrame, time: str = "ts") -> DataFrame:
    """Replaces whole days: a (date, ticker) that the patch has gets the patch's closes at the panel's times and no others."""
    pairs = patch.select("date", "ticker").distinct()
    kept = bars.join(pairs, ["date", "ticker"], "left_anti").select("ticker", "date", time, "close")
    fresh = patch.select("ticker", "date", time, "close").join(times.select("date", time).distinct(), ["date", time], "left_semi")
    return kept.unionByName(fresh.select("ticker", "date", time, "close"))


def missing_series(bars: DataFrame, required: DataFrame) -> DataFrame:
    """Required tickers of which the panel has nothing."""
    return required.select("ticker").distinct().join(bars.select("ticker").distinct(), "ticker", "left_anti")


def redelivered(path: str, patch: DataFrame, bad_share: float = 0.90, most: int = 200) -> DataFrame:
    """The stored bars (ticker, date, ts, close) below path with bad ticker-days replaced in place; only touched dates' folders are rewritten.

    A ticker-day is replaced by what patch (ticker, date, ts, close) has of it, if it is among the first bad ones of its quarter.
    """
    spark = patch.sparkSession
    found = spark.read.parquet(path)
    wanted = capped(bad_ticker_days(found, found, found.select("date", "ts").distinct(), bad_share), most)
    patch = stored(patch.join(wanted, ["date", "ticker"], "left_semi").select("ticker", "date", "ts", "close"), "patch")
    touched = found.join(patch.select("date").distinct(), "date", "left_semi")
    fresh = stored(overlay(touched, touched, patch), "fresh")  # read before its folders are replaced
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)
    emptied = patch.select("date").distinct().join(fresh.select("date").distinct(), "date", "left_anti").collect()  # dates of which a patch leaves nothing: a few
    for r in emptied:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/date={r.date}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Bars go by date, loss panels by training_window and model."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def _table_name(path: str) -> str:
    return "t_" + re.sub(r"\W", "_", path)


def write_by_ticker(df: DataFrame, path: str, buckets: int = 64) -> DataFrame:
    """df as a table of buckets by ticker, a file each, sorted by ticker and date: windows and groups by ticker need no shuffle."""
    name = _table_name(path)
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    df.repartition(buckets, "ticker").write.mode("overwrite").bucketBy(buckets, "ticker").sortBy("ticker", "date").option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def read_by_ticker(spark: SparkSession, path: str, buckets: int = 64) -> DataFrame:
    """What write_by_ticker left below path, in another session too."""
    name = _table_name(path)
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{c}` {kind}" for c, kind in spark.read.parquet(path).dtypes)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet OPTIONS (path '{path}') CLUSTERED BY (ticker) SORTED BY (ticker, date) INTO {buckets} BUCKETS")
    return spark.table(name)
