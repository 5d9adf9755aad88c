"""The runs as jobs: payloads to bars, bars to panel, panel to compared models, component diagnostics. Each writes its tables as Parquet.

spark-submit volpanel/plans/flows.py BARS DIMENSION OUT. BARS: Parquet of bars (ticker, date, m, close) or of payloads (ticker, results),
or a folder of JSON payloads, a line each. DIMENSION: Parquet of (ticker, sector, sector_etf), or a folder of three Parquet tables
from which it is built: primary and fallback (symbol), sectors (ticker, sector).
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volpanel.operators import checks, clean, compare, diagnostics, rolling, series, significance, signature, variance
from volpanel.sources import bars as landing
from volpanel.sources.bars import first_bars, write_by_ticker, write_table
from volpanel.sources.steps import stored


@dataclass(frozen=True)
class Run:
    """Parameters of a run; the defaults are those of one-minute bars of a regular session."""

    market: str = "SPY"
    per_day: int = 390
    coverage: float = 0.9
    big_gap: int = 10
    big_gap_share: float = 0.10
    gap_limit: float = 22
    zero_share: float = 0.9
    intervals: tuple[int, ...] = tuple(range(1, 71))
    plateau: tuple[int, int] = (40, 70)
    least_days: int = 50
    least_stocks: int = 10
    rv_interval: int = 30
    least_blocks: int = 10
    windows: tuple[int, ...] = tuple(range(100, 801, 50))
    table_windows: tuple[int, ...] = (100, 400, 800)
    diagnosis_window: int = 800
    first_day: str | None = None
    last_day: str | None = None
    bad_share: float = 0.90
    most_patches: int = 200
    least_universe: int = 400
    drop_tickers: tuple[str, ...] = ()
    buckets: int = 64


def land(spark: SparkSession, path: str, out: str) -> DataFrame:
    """JSON payloads below path with their order of delivery; lines that do not parse or name no ticker go to the table `quarantine`."""
    payloads = landing.landed(spark, path)
    write_table(landing.quarantined(payloads), f"{out}/quarantine")
    return landing.sound(payloads)


def import_bars(payloads: DataFrame, dimension: DataFrame, out: str, patch: DataFrame | None = None, run: Run = Run()) -> DataFrame:
    """Landed payloads (ticker, results, delivery) to bars (ticker, date, ts, m, close) of the session on the market's trading days.

    Of equal times the bar delivered first stays, over all payloads. Bad ticker-days get the days that `patch` (ticker, date,
    ts, close) re-delivers: bars are written once, and of what is stored only the dates touched are written again.
    ValueError if a fund or the market has no bar.
    """
    spark = payloads.sparkSession
    session = landing.session_bars(landing.exploded(payloads))
    days = landing.trading_days(session.where(F.col("ticker") == run.market), run.first_day, run.last_day)
    write_table(first_bars(landing.on_days(session, days)).select("ticker", "date", "ts", "close"), f"{out}/bars", ["date"])
    if patch is not None:
        landing.redelivered(f"{out}/bars", patch, run.bad_share, run.most_patches)
    bars = spark.read.parquet(f"{out}/bars").withColumn("m", F.hour("ts") * 60 + F.minute("ts") - (9 * 60 + 30))
    required = dimension.select(F.col("sector_etf").alias("ticker")).where("ticker IS NOT NULL").union(spark.createDataFrame([(run.market,)], "ticker string"))
    gone = [r.ticker for r in landing.missing_series(bars, required).orderBy("ticker").collect()]  # funds and market: a few
    if gone:
        raise ValueError(f"no bars of {', '.join(gone)}")
    return bars


def bars_to_panel(bars: DataFrame, dimension: DataFrame, out: str, run: Run = Run()) -> DataFrame:
    """Filters, fills, returns, signature and the daily log-variance panel; returns the panel without bad benchmark dates.

    Bars become one row a ticker-day; every later step but the sums over tickers stays within these rows. ValueError if a ticker lacks a day.
    """
    spark, days = bars.sparkSession, stored(bars.select("date").distinct(), "days")
    covered = stored(clean.covered(clean.on_grid(bars, days, run.per_day), days, run.per_day, run.coverage), "covered")
    seen = stored(series.observed(clean.ungapped(covered, days, run.big_gap, run.big_gap_share, run.gap_limit)), "ticker-days")
    whole = stored(series.with_returns(series.opened(seen, days, seen, run.per_day), run.per_day), "series")
    series.check_days(whole, days)
    write_table(series.price_counts(whole, run.per_day), f"{out}/price_counts")
    left = series.opened_market(whole, run.per_day, run.zero_share)
    write_table(series.day_returns(left), f"{out}/returns")
    returns = spark.read.parquet(f"{out}/returns")
    by = signature.signature(returns, list(run.intervals), least_days=run.least_days)
    write_table(by, f"{out}/signature")
    ratios = signature.ratios(spark.read.parquet(f"{out}/signature"), dimension, run.plateau, run.least_days)
    write_table(signature.bands(signature.interval_summary(ratios)), f"{out}/signature_intervals")
    write_table(signature.bands(signature.sector_summary(ratios, least_stocks=run.least_stocks)), f"{out}/signature_sectors")
    benchmarks = dimension.selectExpr("sector_etf AS ticker").where("ticker IS NOT NULL").distinct().union(spark.createDataFrame([(run.market,)], "ticker string"))
    daily = stored(series.daily_log_rv(returns, run.rv_interval, False, run.least_blocks), "daily")
    panel = variance.without_tickers(variance.without_bad_dates(daily, benchmarks), list(run.drop_tickers))
    return write_by_ticker(panel, f"{out}/daily_log_rv", run.buckets)


def panel_to_models(panel: DataFrame, dimension: DataFrame, out: str, run: Run = Run()) -> DataFrame:
    """Three models over all windows, stopped by a fatal check, then losses and tests; returns the loss panel.

    The component model is fitted once for this run and for `diagnose`, which reads its fits. Faulty rows are counted as the
    loss panel is written: such a panel stops the run before anything reads it.
    """
    spark, tickers = panel.sparkSession, variance.eligible(panel, dimension, run.market)
    stocks = panel.join(tickers, "ticker", "left_semi")
    write_table(rolling.component_fits(panel, tickers, (*run.windows, run.diagnosis_window)), f"{out}/component_fits", ["training_window"])
    fits = component_fits(spark, out)
    outputs = {
        "HAR": rolling.har_forecasts(stocks, run.windows), "HAR-X": rolling.harx_forecasts(panel, tickers, run.windows),
        "RELATIVE": rolling.forecasts_of(fits.where(F.col("training_window").isin(list(run.windows)))),
    }
    rows, seen = compare.observed(compare.loss_panel(outputs, dimension, run.rv_interval))
    write_table(rows, f"{out}/loss_panel", ["training_window", "model"])
    checks.raise_if_observed(seen.get)
    losses = compare.checked(spark.read.parquet(f"{out}/loss_panel"), list(outputs), dimension, run.market)
    write_table(compare.ticker_losses(losses), f"{out}/ticker_losses")
    by_ticker = spark.read.parquet(f"{out}/ticker_losses")
    write_table(compare.overall_losses(by_ticker), f"{out}/overall_losses")
    write_table(compare.sector_losses(by_ticker), f"{out}/sector_losses")
    write_table(compare.reduction_table(compare.sector_losses(by_ticker), run.table_windows), f"{out}/loss_reduction")
    write_table(significance.stock_tests(significance.pair_losses(losses, "RELATIVE", ["HAR", "HAR-X"])), f"{out}/tests")
    write_table(significance.summary(spark.read.parquet(f"{out}/tests")), f"{out}/test_summary")
    return losses


def component_fits(spark: SparkSession, out: str) -> DataFrame:
    """The fits that panel_to_models left below out."""
    return spark.read.parquet(f"{out}/component_fits")


def diagnose(panel: DataFrame, out: str, run: Run = Run()) -> None:
    """Forecastability of the components and the decomposition of the component model's error, from the fits below out."""
    spark = panel.sparkSession
    fits = component_fits(spark, out).where(F.col("training_window") == run.diagnosis_window)
    write_table(diagnostics.r2_table(rolling.forecastability_of(fits)), f"{out}/r2")
    r2 = spark.read.parquet(f"{out}/r2")
    write_table(diagnostics.component_summary(r2), f"{out}/r2_components")
    write_table(diagnostics.sector_comparison(diagnostics.paired(r2)), f"{out}/r2_sectors")
    write_table(diagnostics.error_decomposition(rolling.forecasts_of(fits), panel), f"{out}/error_decomposition")
    write_table(diagnostics.decomposition_summary(spark.read.parquet(f"{out}/error_decomposition")), f"{out}/error_summary")


def is_folder_of(spark: SparkSession, path: str, name: str) -> bool:
    """Whether path is a folder in which a file or folder matches name."""
    found = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    return bool(found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(found))


def run_all(spark: SparkSession, bars: str, dimension: str, out: str, run: Run = Run()) -> None:
    """All runs in a row over landed tables."""
    read = lambda path: spark.read.parquet(path)
    if is_folder_of(spark, dimension, "primary*"):
        write_table(landing.dimension_of(read(f"{dimension}/primary"), read(f"{dimension}/fallback"), read(f"{dimension}/sectors"), run.least_universe), f"{out}/dimension")
        dimension = f"{out}/dimension"
    dim = read(dimension)
    raw = land(spark, bars, out) if is_folder_of(spark, bars, "*.json*") else read(bars)
    raw = import_bars(raw, dim, out, None, run) if "results" in raw.columns else raw
    one = first_bars(raw, ("ticker", "date", "m")) if "ingest_seq" in raw.columns else raw
    panel = bars_to_panel(one, dim, out, run)
    panel_to_models(panel, dim, out, run)
    diagnose(panel, out, run)


def main(bars: str, dimension: str, out: str) -> None:
    run_all(SparkSession.builder.appName("volpanel").getOrCreate(), bars, dimension, out)


if __name__ == "__main__":
    main(*sys.argv[1:4])
