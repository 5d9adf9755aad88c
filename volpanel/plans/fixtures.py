"""Stand-in inputs over the driver's tables, in Spark and in SQL alike: intraday bars of events, log variances of line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volpanel.sources.steps import stored

#: Minutes a bar, bars a day.
STEP, PER_DAY = 60, 24
MARKET = "T0"
#: The stand-in dimension.
DIMENSION = [("T3", "A", "T1"), ("T5", "A", "T1"), ("T7", "A", "T1"), ("T4", "B", "T2"), ("T6", "B", "T2")]
FUNDS = ["T1", "T2"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, ts, date, m, close, ingest_seq): every positive event as a bar of its slot."""
    ts = F.col("ts")
    return read(spark, sf_dir, "events").where("value > 0").select(
        F.concat(F.lit("T"), (F.col("user_id") % 8).cast("string")).alias("ticker"), "ts", ts.cast("date").alias("date"),
        F.floor((F.hour(ts) * 60 + F.minute(ts)) / STEP).cast("int").alias("m"), F.col("value").alias("close"), F.col("event_id").alias("ingest_seq"),
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, date, m, close): the last trade of every slot."""
    return trades(spark, sf_dir).groupBy("ticker", "date", "m").agg(F.max_by("close", "ts").alias("close"))


def days(bars: DataFrame) -> DataFrame:
    return bars.select("date").distinct()


def dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DIMENSION, "ticker string, sector string, sector_etf string")


def log_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, date, log_rv): nations as stocks, regions as funds, all rows as the market; every series at every week."""
    lines = (
        read(spark, sf_dir, "lineitem").select("l_suppkey", "l_extendedprice", "l_shipdate")
        .join(read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(F.broadcast(read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 rows
        .join(F.broadcast(read(spark, sf_dir, "region").select("r_regionkey", "r_name")), F.col("n_regionkey") == F.col("r_regionkey"))  # 5 rows
        .select("n_name", "r_name", F.date_trunc("week", "l_shipdate").cast("date").alias("date"), F.pow(F.col("l_extendedprice") / 10000.0, 2).alias("sq"))
    )
    one = stored(lines.groupBy("n_name", "r_name", "date").agg(F.sum("sq").alias("sq")), "weeks")  # line items are read once; funds and market add up these rows
    series = lambda name: one.select(name.alias("ticker"), "date", "sq").groupBy("ticker", "date").agg(F.log(F.sum("sq")).alias("log_rv"))
    found = series(F.col("n_name")).union(series(F.concat(F.lit("ETF_"), F.col("r_name")))).union(series(F.lit("MKT")))
    full = found.select("date").distinct().crossJoin(F.broadcast(found.select("ticker").distinct()))  # weeks times tickers, the size of the panel
    return stored(full.join(found, ["ticker", "date"], "left").select("ticker", "date", "log_rv"), "panel")


def panel_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("ticker"), F.col("r_name").alias("sector"), F.concat(F.lit("ETF_"), F.col("r_name")).alias("sector_etf")
    )


# ---- the same in SQL, as named common table expressions

_DIM = ", ".join(f"('{t}', '{s}', '{e}')" for t, s, e in DIMENSION)
CTES = {
    "trades": f"""SELECT 'T' || CAST(user_id % 8 AS VARCHAR) AS ticker, ts, CAST(ts AS DATE) AS date,
        CAST((hour(ts) * 60 + minute(ts)) // {STEP} AS INTEGER) AS m, value AS close, event_id AS ingest_seq FROM events WHERE value > 0""",
    "ticks": "SELECT ticker, date, m, max_by(close, ts) AS close FROM trades GROUP BY 1, 2, 3",
    "days": "SELECT DISTINCT date FROM ticks",
    "dim": f"SELECT * FROM (VALUES {_DIM}) t(ticker, sector, sector_etf)",
    "grid": f"SELECT date, CAST(m AS INTEGER) AS m FROM days, range({PER_DAY}) r(m)",
    "full_panel": "SELECT t.ticker, g.date, g.m, b.close FROM grid g CROSS JOIN (SELECT DISTINCT ticker FROM ticks) t LEFT JOIN ticks b USING (ticker, date, m)",
    "filled": """SELECT ticker, date, m, coalesce(
          last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date, m ROWS UNBOUNDED PRECEDING),
          first_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date, m ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS close FROM full_panel""",
    "rets": "SELECT ticker, date, m, ln(close) - lag(ln(close)) OVER (PARTITION BY ticker, date ORDER BY m) AS r FROM filled",
    "lines": """SELECT n_name, r_name, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, power(l_extendedprice / 10000.0, 2) AS sq
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "sparse": """SELECT n_name AS ticker, date, ln(sum(sq)) AS x FROM lines GROUP BY 1, 2
        UNION ALL SELECT 'ETF_' || r_name, date, ln(sum(sq)) FROM lines GROUP BY 1, 2 UNION ALL SELECT 'MKT', date, ln(sum(sq)) FROM lines GROUP BY 1, 2""",
    "panel": "SELECT t.ticker, d.date, s.x FROM (SELECT DISTINCT ticker FROM sparse) t CROSS JOIN (SELECT DISTINCT date FROM sparse) d LEFT JOIN sparse s USING (ticker, date)",
    "pdim": "SELECT n_name AS ticker, r_name AS sector, 'ETF_' || r_name AS sector_etf FROM nation JOIN region ON n_regionkey = r_regionkey",
}
NEEDS = {
    "ticks": ["trades"], "days": ["ticks"], "grid": ["days"], "full_panel": ["grid", "ticks"], "filled": ["full_panel"], "rets": ["filled"],
    "sparse": ["lines"], "panel": ["sparse"],
}


def sql(select: str, *names: str, more: dict[str, str] | None = None) -> str:
    """A query over the named expressions and those that they need, followed by its own."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    parts = [f"{n} AS (SELECT * FROM ({CTES[n]}))" for n in order] + [f"{n} AS ({q})" for n, q in (more or {}).items()]
    return f"WITH {', '.join(parts)} {select}" if parts else select
