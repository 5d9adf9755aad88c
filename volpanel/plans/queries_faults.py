"""Queries of the checks of metadata and universes over forecasts in which every kind of fault is planted, with their SQL.

The forecasts are stand-ins of three models, a row a nation, week and model. One nation each has no sector in one model, two
funds in it, another market and another sector in a second one, and is missing from one; a model lacks the 6th of each month, actual values differ on
the 9th, origins on the 12th. The dimension has a nation twice, lacks one and knows nothing of another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from volpanel.operators import checks

from . import fixtures as fx

MODELS = ["HAR", "HAR-X", "RELATIVE"]
#: The ticker with which something is wrong.
PLANTED = {"no_sector": "NATION_3", "two_funds": "NATION_4", "market": "NATION_5", "sector": "NATION_6", "missing": "NATION_7", "twice": "NATION_8", "absent": "NATION_9", "unknown": "NATION_2"}


def _is(model: str, condition: Column) -> Column:
    return (F.col("model") == model) & condition


def _ticker(fault: str) -> Column:
    return F.col("ticker") == PLANTED[fault]


def forecasts(spark: SparkSession, sf: str) -> DataFrame:
    day, none = F.dayofmonth("date"), F.lit(None).cast("string")
    rows = fx.log_panel(spark, sf).join(fx.panel_dimension(spark, sf), "ticker").withColumn("model", F.explode(F.array(*map(F.lit, MODELS))))
    rows = rows.where(~_is("HAR-X", _ticker("missing")) & ~_is("RELATIVE", day == 6))
    plain = F.col("model") == "HAR"
    return rows.select(
        "model", "ticker", F.col("date").alias("target_date"), F.date_sub("date", F.when(_is("HAR-X", day == 12), 8).otherwise(7)).alias("forecast_origin_date"),
        (F.col("log_rv") + F.when(_is("RELATIVE", day == 9), 1.0).otherwise(0.0)).alias("actual"),
        F.when(plain | _is("HAR-X", _ticker("no_sector")), none).when(_is("RELATIVE", _ticker("sector")), "Z").otherwise(F.col("sector")).alias("sector"),
        F.when(plain, none).when(_is("HAR-X", _ticker("two_funds") & (day < 8)), "ETF_X").otherwise(F.col("sector_etf")).alias("sector_etf"),
        F.when(plain, none).when(_is("RELATIVE", _ticker("market")), "OTHER").otherwise("MKT").alias("market_ticker"),
    )


def dimension(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.panel_dimension(spark, sf).where(~_ticker("absent"))
    known = lambda c: F.when(~_ticker("unknown"), F.col(c)).alias(c)
    return rows.union(rows.where(_ticker("twice"))).select("ticker", known("sector"), known("sector_etf"))


def planted_metadata_checks(spark: SparkSession, sf: str) -> DataFrame:
    return checks.metadata_checks(forecasts(spark, sf), dimension(spark, sf), "MKT")


def planted_metadata_summary(spark: SparkSession, sf: str) -> DataFrame:
    return checks.metadata_summary(forecasts(spark, sf), "MKT")


def planted_metadata_mismatches(spark: SparkSession, sf: str) -> DataFrame:
    return checks.metadata_mismatches(checks.metadata_values(forecasts(spark, sf)))


def planted_reference_mismatches(spark: SparkSession, sf: str) -> DataFrame:
    found = checks.reference_mismatches(checks.metadata_values(forecasts(spark, sf)), dimension(spark, sf))
    return found.select("model", "ticker", "sector", "sector_etf", "ref_sector", "ref_sector_etf")


def _seen(spark: SparkSession, sf: str) -> DataFrame:
    return checks.presence(forecasts(spark, sf), MODELS)


def planted_universe_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Missing and extra tickers, dates and pairs of each model against the first."""
    seen, kinds = _seen(spark, sf), ("ticker", "target_date", "pair")
    one, two, three = (checks.universe_summary(seen, MODELS, "HAR", k).withColumn("kind", F.lit(k)) for k in kinds)
    return one.unionByName(two).unionByName(three)


def planted_common_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of all models, how far they make a balanced panel, and the largest differences on them."""
    return checks.common_panel(_seen(spark, sf), len(MODELS), 1e-6).withColumn("max_actual_difference", F.round("max_actual_difference", 6) + F.lit(0.0))


_FRC = """SELECT model, p.ticker, p.date AS target_date, p.date - CASE WHEN model = 'HAR-X' AND day(p.date) = 12 THEN 8 ELSE 7 END AS forecast_origin_date,
    p.x + CASE WHEN model = 'RELATIVE' AND day(p.date) = 9 THEN 1.0 ELSE 0.0 END AS actual,
    CASE WHEN model = 'HAR' OR (model = 'HAR-X' AND p.ticker = 'NATION_3') THEN NULL WHEN model = 'RELATIVE' AND p.ticker = 'NATION_6' THEN 'Z' ELSE sector END AS sector,
    CASE WHEN model = 'HAR' THEN NULL WHEN model = 'HAR-X' AND p.ticker = 'NATION_4' AND day(p.date) < 8 THEN 'ETF_X' ELSE sector_etf END AS sector_etf,
    CASE WHEN model = 'HAR' THEN NULL WHEN model = 'RELATIVE' AND p.ticker = 'NATION_5' THEN 'OTHER' ELSE 'MKT' END AS market_ticker
  FROM panel p JOIN pdim USING (ticker), (VALUES ('HAR'), ('HAR-X'), ('RELATIVE')) k(model)
  WHERE NOT (model = 'HAR-X' AND p.ticker = 'NATION_7') AND NOT (model = 'RELATIVE' AND day(p.date) = 6)"""
_VALUES = {
    "frc": _FRC,
    "vals": "SELECT DISTINCT model, ticker, sector, sector_etf, market_ticker FROM frc WHERE model <> 'HAR'",
    "known": "SELECT ticker, CASE WHEN ticker <> 'NATION_2' THEN sector END AS sector, CASE WHEN ticker <> 'NATION_2' THEN sector_etf END AS sector_etf FROM pdim WHERE ticker <> 'NATION_9'",
    "across": """SELECT ticker, count(DISTINCT sector) AS n_unique_sector, count(DISTINCT sector_etf) AS n_unique_sector_etf, count(DISTINCT market_ticker) AS n_unique_market_ticker
        FROM vals GROUP BY 1 HAVING greatest(count(DISTINCT sector), count(DISTINCT sector_etf), count(DISTINCT market_ticker)) > 1""",
    "unlike": """SELECT v.model, v.ticker, v.sector, v.sector_etf, k.sector AS ref_sector, k.sector_etf AS ref_sector_etf FROM vals v LEFT JOIN known k ON k.ticker = v.ticker
        WHERE (k.sector IS NULL AND k.sector_etf IS NULL) OR v.sector <> k.sector OR v.sector_etf <> k.sector_etf""",
    "several": "SELECT model, ticker, count(DISTINCT sector) > 1 AS a, count(DISTINCT sector_etf) > 1 AS b, count(DISTINCT market_ticker) > 1 AS c FROM frc GROUP BY 1, 2",
}
_SEEN = {"frc": _FRC, "seen": """SELECT ticker, target_date, bool_or(model = 'HAR') AS i0, bool_or(model = 'HAR-X') AS i1, bool_or(model = 'RELATIVE') AS i2, count(DISTINCT model) AS k,
    max(actual) - min(actual) AS spread, max(forecast_origin_date) - min(forecast_origin_date) AS days FROM frc GROUP BY 1, 2"""}  # fmt: skip
_CHECK = lambda name, ok, bad, severity, details: f"SELECT '{name}' AS check_name, CASE WHEN {ok} THEN 'PASS' ELSE '{bad}' END AS status, '{severity}' AS severity, {details} AS details FROM f"
_UNIVERSE = lambda kind, keys: f"""SELECT model, '{kind}' AS kind, count(*) FILTER (here) AS n, count(*) FILTER (there AND NOT here) AS n_missing, count(*) FILTER (here AND NOT there) AS n_extra
    FROM (SELECT unnest(['HAR', 'HAR-X', 'RELATIVE']) AS model, unnest([i0, i1, i2]) AS here, i0 AS there FROM (SELECT bool_or(i0) AS i0, bool_or(i1) AS i1, bool_or(i2) AS i2 FROM seen GROUP BY {keys})) GROUP BY 1"""  # noqa: E731
ORACLE_SQL = {
    "planted_metadata_checks": fx.sql(
        " UNION ALL ".join([
            _CHECK("Metadata available in at least one model", "models > 0", "WARNING", "warning", "'Models that carry metadata: ' || models"),
            _CHECK("No missing metadata values", "missing = 0", "FAIL", "fatal", "'Values missing: ' || missing"),
            _CHECK("Unique metadata per ticker within each model", "many = 0", "FAIL", "fatal", "'Tickers of several values: ' || many"),
            _CHECK("Expected market ticker", "market", "FAIL", "fatal", "'Market: MKT'"),
            _CHECK("Metadata consistent across models", "across_ = 0", "FAIL", "fatal", "'Tickers on which models differ: ' || across_"),
            _CHECK("Metadata consistent with reference table", "unlike_ = 0 AND double_ = 0", "FAIL", "warning", "'Rows unlike the dimension: ' || unlike_"),
        ]),
        "panel", "pdim",
        more=_VALUES | {"f": """SELECT (SELECT count(DISTINCT model) FROM vals) AS models,
            (SELECT count(*) FILTER (sector IS NULL) + count(*) FILTER (sector_etf IS NULL) + count(*) FILTER (market_ticker IS NULL) FROM frc WHERE model <> 'HAR') AS missing,
            (SELECT count(*) FILTER (a) + count(*) FILTER (b) + count(*) FILTER (c) FROM several) AS many, (SELECT bool_and(market_ticker = 'MKT') FROM vals) AS market,
            (SELECT count(*) FROM across) AS across_, (SELECT count(*) FROM unlike) AS unlike_, (SELECT count(*) FROM known WHERE ticker = 'NATION_8') AS double_"""},
    ),
    "planted_metadata_summary": fx.sql(
        """SELECT model, model <> 'HAR' AS has_metadata, count(*) AS n_rows, count(DISTINCT ticker) AS n_tickers,
            """ + ", ".join(f"CASE WHEN model <> 'HAR' THEN count(*) FILTER ({c} IS NULL) END AS n_missing_{c}" for c in checks.METADATA) + ", "
        + ", ".join(f"CASE WHEN model <> 'HAR' THEN (SELECT count(*) FILTER ({x}) FROM several s WHERE s.model = frc.model) END AS n_tickers_multiple_{c}" for c, x in zip(checks.METADATA, "abc", strict=True))
        + ", CASE WHEN model <> 'HAR' THEN bool_and(market_ticker = 'MKT') END AS market_ticker_expected FROM frc GROUP BY model",
        "panel", "pdim", more=_VALUES,
    ),
    "planted_metadata_mismatches": fx.sql("SELECT * FROM across", "panel", "pdim", more=_VALUES),
    "planted_reference_mismatches": fx.sql("SELECT * FROM unlike", "panel", "pdim", more=_VALUES),
    "planted_universe_summary": fx.sql(" UNION ALL ".join([_UNIVERSE("ticker", "ticker"), _UNIVERSE("target_date", "target_date"), _UNIVERSE("pair", "ticker, target_date")]), "panel", "pdim", more=_SEEN),
    "planted_common_panel": fx.sql(
        """SELECT *, n_common_tickers * n_common_target_dates AS expected_common_pairs, n_common_pairs = n_common_tickers * n_common_target_dates AS common_panel_balanced FROM (
          SELECT count(*) FILTER (k = 3) AS n_common_pairs, count(*) AS n_union_pairs, count(*) FILTER (k = 3 AND spread > 1e-6) AS n_actual_mismatches, round(max(spread) FILTER (k = 3), 6) + 0.0 AS max_actual_difference,
            count(*) FILTER (k = 3 AND days > 0) AS n_origin_mismatches, CAST(max(days) FILTER (k = 3) AS INTEGER) AS max_origin_difference_days,
            (SELECT count(*) FROM (SELECT ticker FROM seen GROUP BY 1 HAVING bool_or(i0) AND bool_or(i1) AND bool_or(i2))) AS n_common_tickers,
            (SELECT count(*) FROM (SELECT target_date FROM seen GROUP BY 1 HAVING bool_or(i0) AND bool_or(i1) AND bool_or(i2))) AS n_common_target_dates FROM seen)""",
        "panel", "pdim", more=_SEEN,
    ),
}
QUERIES = {name: globals()[name] for name in ORACLE_SQL}
