"""Queries that return what whole runs leave behind, with their SQL: payload files to bars, bars to panel, panel to losses and diagnosis.

Each run writes its tables to a folder of its own in the shared folder; the query reads the last of them. The payload files come
from events in two deliveries, between which lines are planted that do not parse or name no ticker.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volpanel.functions.columns import rounded
from volpanel.operators import variance
from volpanel.sources import bars as landing
from volpanel.sources.steps import shared_folder, stored

from . import fixtures as fx
from . import flows
from . import queries_panel as panels
from . import queries_ticks as ticks

#: Events of every third number come with the second delivery.
LATE = 3
IMPORT = flows.Run(fx.MARKET, bad_share=0.6, most_patches=60)
PANEL = flows.Run(
    fx.MARKET, fx.PER_DAY, coverage=0.8, big_gap=2, big_gap_share=0.9, gap_limit=8, zero_share=0.3, intervals=(1, 2, 4), plateau=(2, 4), least_days=10, least_stocks=2,
    rv_interval=ticks.K, least_blocks=7, drop_tickers=("T7",), buckets=8,
)
MODELS = flows.Run("MKT", windows=panels.WINDOWS, table_windows=panels.WINDOWS, diagnosis_window=panels.BIG)


def _out(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def delivered(spark: SparkSession, sf: str, out: str) -> str:
    """Writes events as payloads, one a ticker and hour, in two deliveries; returns what names their files."""
    bar = F.struct("ingest_seq", F.unix_millis(F.date_trunc("minute", F.col("ts").cast("timestamp"))).alias("t"), F.col("close").alias("c"))
    trades = fx.trades(spark, sf).withColumn("late", F.col("ingest_seq") % LATE == 0)
    rows = trades.groupBy("late", "ticker", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour")).agg(F.array_sort(F.collect_list(bar)).alias("bars"))
    results = F.transform("bars", lambda b: F.struct(b["t"].alias("t"), b["c"].alias("c"))).alias("results")
    lines = rows.select("late", F.to_json(F.struct("ticker", results)).alias("value"))
    lines.where("NOT late").select("value").write.text(f"{out}/payloads/1-first")
    day = F.col("date").cast("string")
    planted = trades.groupBy("date").count().select(F.explode(F.array(F.concat(F.lit('{"ticker": "T0", "results": ['), day), F.concat(F.lit('{"ticker": " ", "results": [{"t": '), F.col("count"), F.lit("}]}")))).alias("value"))
    lines.where("late").select("value").union(planted).write.text(f"{out}/payloads/2-second")
    return f"{out}/payloads/*"


def run_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """The planted lines and nothing else; one that does not parse has no ticker. With the events that a nameless payload's one result counts."""
    out = _out(spark, "quarantine-run")
    flows.land(spark, delivered(spark, sf, out), out)
    return spark.read.parquet(f"{out}/quarantine").select("ticker", "broken", F.get("results", F.lit(0))["t"].alias("n_events"))


def run_import(spark: SparkSession, sf: str) -> DataFrame:
    """Bars of a whole import; bad ticker-days but those of one ticker get the market's bars of even minutes, ten times as high."""
    out = _out(spark, "import-run")
    payloads = flows.land(spark, delivered(spark, sf, out), out)
    market = landing.first_bars(landing.session_bars(landing.exploded(payloads.where(F.col("ticker") == fx.MARKET)))).where(F.minute("ts") % 2 == 0)
    names = F.explode(F.array(*(F.lit(f"T{i}") for i in range(7)))).alias("ticker")
    patch = market.select(names, "date", "ts", (F.col("close") * 10).alias("close"))
    bars = flows.import_bars(payloads, fx.dimension(spark), out, patch, IMPORT)
    return bars.select("ticker", "date", F.col("m").cast("int").alias("m"), "close").transform(rounded)


def run_panel(spark: SparkSession, sf: str) -> DataFrame:
    """The daily panel of a whole run: filters, fills, early closes, bad benchmark dates, a dropped ticker."""
    panel = flows.bars_to_panel(ticks.ticks(spark, sf), fx.dimension(spark), _out(spark, "panel-run"), PANEL)
    return panel.select("ticker", "date", "log_rv").transform(rounded)


def _modelled(spark: SparkSession, sf: str) -> tuple[DataFrame, str]:
    """The weeks in which every series is there, and where their models are: with holes the models' universes differ, which stops a run."""
    out, every = _out(spark, "model-run"), panels.panel(spark, sf)
    panel = stored(variance.without_bad_dates(every, every), "whole-weeks")
    flows.panel_to_models(panel, fx.panel_dimension(spark, sf), out, MODELS)
    return panel, out


def run_overall_losses(spark: SparkSession, sf: str) -> DataFrame:
    """Losses that a run leaves whose checks have passed."""
    _, out = _modelled(spark, sf)
    return spark.read.parquet(f"{out}/overall_losses").transform(rounded)


def run_error_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The error's decomposition by sector, from the fits that the model run has left."""
    panel, out = _modelled(spark, sf)
    flows.diagnose(panel, out, MODELS)
    return spark.read.parquet(f"{out}/error_summary").withColumn("decomposition_gap", F.round("decomposition_gap", 6)).transform(rounded)


def _whole_weeks(sql: str) -> str:
    """The same SQL over the weeks in which every series is there."""
    panel = f"(SELECT * FROM ({fx.CTES['panel']}))"
    return sql.replace(f"panel AS {panel}", f"weeks AS {panel}, panel AS (SELECT * FROM weeks WHERE date NOT IN (SELECT date FROM weeks GROUP BY 1 HAVING count(x) < count(*)))")


_R = ticks._R
_DROPPED = ", ".join(f"'{t}'" for t in PANEL.drop_tickers)
ORACLE_SQL = {
    "run_quarantine": fx.sql(
        """SELECT CAST(NULL AS VARCHAR) AS ticker, '{"ticker": "T0", "results": [' || CAST(date AS VARCHAR) AS broken, CAST(NULL AS BIGINT) AS n_events FROM trades GROUP BY date
        UNION ALL SELECT ' ', NULL, count(*) FROM trades GROUP BY date""",
        "trades",
    ),
    "run_import": fx.sql(
        f"""SELECT ticker, date, CAST(hour(l) * 60 + minute(l) - 570 AS INTEGER) AS m, {_R('close', 'close')}
            FROM (SELECT * FROM bars WHERE (ticker, date) NOT IN (SELECT (ticker, date) FROM patch) UNION ALL SELECT * FROM patch)""",
        "trades",
        more={
            "local": "SELECT ticker, date_trunc('minute', ts) - INTERVAL 5 HOUR AS l, close, ingest_seq FROM trades",
            "session": f"""SELECT ticker, CAST(l AS DATE) AS date, l, close FROM local WHERE (hour(l) > 9 OR hour(l) = 9 AND minute(l) >= 30) AND hour(l) < 16
                QUALIFY row_number() OVER (PARTITION BY ticker, l ORDER BY ingest_seq % {LATE} = 0, ingest_seq) = 1""",
            "bars": f"SELECT * FROM session WHERE date IN (SELECT date FROM session WHERE ticker = '{fx.MARKET}')",
            "bad": f"""SELECT date, ticker FROM (SELECT date, count(DISTINCT l) AS total FROM bars GROUP BY 1) CROSS JOIN (SELECT DISTINCT ticker FROM bars)
                LEFT JOIN (SELECT date, ticker, count(*) AS n FROM bars GROUP BY 1, 2) USING (date, ticker) WHERE 1 - coalesce(n, 0) / total >= {IMPORT.bad_share}
                QUALIFY row_number() OVER (PARTITION BY year(date), quarter(date) ORDER BY date, ticker) <= {IMPORT.most_patches}""",
            "patch": f"SELECT b.ticker, b.date, m.l, m.close * 10 AS close FROM bad b JOIN bars m ON m.ticker = '{fx.MARKET}' AND m.date = b.date AND minute(m.l) % 2 = 0 WHERE b.ticker <> 'T7'",
        },
    ),
    "run_panel": fx.sql(
        f"SELECT ticker, date, {_R('x', 'log_rv')} FROM rvs WHERE ticker NOT IN ({_DROPPED}) AND date NOT IN (SELECT date FROM bad)",
        "grid", "dim",
        more={
            "kept": f"SELECT * FROM ticks WHERE ticker IN (SELECT ticker FROM ticks GROUP BY 1 HAVING count(*) / ((SELECT count(*) FROM days) * {fx.PER_DAY}) >= {PANEL.coverage})",
            "gaps": ticks._GAPS.format(src="kept"),
            "stats": ticks._STATS,
            "chosen": f"SELECT * FROM kept WHERE ticker IN (SELECT ticker FROM stats WHERE ratio_days_big_gap <= {PANEL.big_gap_share} AND max_gap_any_day < {PANEL.gap_limit})",
            "full_panel": fx.CTES["full_panel"].replace("ticks", "chosen"),
            "filled": fx.CTES["filled"],
            "rets": fx.CTES["rets"],
            "shut": f"SELECT date, m FROM rets GROUP BY 1, 2 HAVING count(r) > 0 AND count(*) FILTER (r = 0) / nullif(count(r), 0) > {PANEL.zero_share}",
            "numbered": ticks._NUMBERED.replace("FROM rets WHERE", "FROM rets WHERE (date, m) NOT IN (SELECT (date, m) FROM shut) AND"),
            "blocks": ticks._BLOCKS,
            "rvs": f"""SELECT ticker, date, CASE WHEN count(block) >= {PANEL.least_blocks} AND sum(r * r) > 0 THEN ln(sum(r * r)) END AS x
                FROM (SELECT DISTINCT ticker, date FROM rets) LEFT JOIN (SELECT * FROM blocks WHERE n = {PANEL.rv_interval}) USING (ticker, date) GROUP BY 1, 2""",
            "marks": f"SELECT DISTINCT ticker FROM rvs WHERE ticker = '{fx.MARKET}' OR ticker IN (SELECT sector_etf FROM dim)",
            "bad": "SELECT date FROM rvs GROUP BY 1 HAVING count(x) FILTER (ticker IN (SELECT ticker FROM marks)) < (SELECT count(*) FROM marks)",
        },
    ),
    "run_overall_losses": _whole_weeks(panels.ORACLE_SQL["overall_losses"]),
    "run_error_summary": _whole_weeks(panels.ORACLE_SQL["error_decomposition_summary"]),
}
QUERIES = {name: globals()[name] for name in ORACLE_SQL}
