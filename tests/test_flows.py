"""The jobs end to end on the stand-ins, with test-sized parameters."""

import datetime as dt
import json
import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from volpanel.operators import rolling
from volpanel.plans import fixtures as fx
from volpanel.plans import flows
from volpanel.sources import bars as landing

SF = "/root/testdata/sf0.1"


def test_bars_to_panel(spark, tmp_path):
    run = flows.Run("T0", fx.PER_DAY, 0.9, 2, 0.5, 4, 0.9, (1, 2, 4), (2, 4), 10, 2, 3, 2)
    panel = flows.bars_to_panel(fx.ticks(spark, SF), fx.dimension(spark), str(tmp_path), run)
    assert panel.select("ticker").distinct().count() == 8 and panel.where("log_rv IS NULL").isEmpty()
    fewer = flows.bars_to_panel(fx.ticks(spark, SF), fx.dimension(spark), str(tmp_path / "fewer"), replace(run, drop_tickers=("T7",)))
    assert fewer.select("ticker").distinct().count() == 7 and fewer.where("ticker = 'T7'").isEmpty()
    assert spark.read.parquet(f"{tmp_path}/signature_sectors").count() == 6


def test_panel_to_models_and_diagnosis(spark, tmp_path):
    run = flows.Run("MKT", windows=(60, 100), table_windows=(60, 100), diagnosis_window=100)
    panel, dimension = fx.log_panel(spark, SF).persist(), fx.panel_dimension(spark, SF)
    losses = flows.panel_to_models(panel, dimension, str(tmp_path), run)
    assert losses.select("model", "training_window").distinct().count() == 6
    assert spark.read.parquet(f"{tmp_path}/tests").count() == 25 * 2 * 2 * 3
    flows.diagnose(panel, str(tmp_path), run)
    assert spark.read.parquet(f"{tmp_path}/error_summary").where("abs(decomposition_gap) < 1e-9").count() == 5


@pytest.mark.parametrize("fault,message", [("nan", "n_nonfinite_rows"), ("twice", "Individual model output checks"), ("market", "Expected market ticker")])
def test_planted_fault_stops_the_run(spark, tmp_path, monkeypatch, fault, message):
    """Rows that are not finite stop it as they are written, repeated pairs and another market before the first table is made."""
    run = flows.Run("MKT", windows=(60,), table_windows=(60,), diagnosis_window=60)
    made, har = rolling.forecasts_of, rolling.har_forecasts

    def forecasts(fits):
        rows = made(fits)
        return rows.withColumn("qlike", F.when(F.col("ticker") == "NATION_7", float("nan")).otherwise(F.col("qlike"))) if fault == "nan" else rows.withColumn("market_ticker", F.lit("X")) if fault == "market" else rows

    monkeypatch.setattr(rolling, "forecasts_of", forecasts)
    monkeypatch.setattr(rolling, "har_forecasts", lambda *a, **k: har(*a, **k).union(har(*a, **k).where("ticker = 'NATION_7'")) if fault == "twice" else har(*a, **k))
    panel = fx.log_panel(spark, "/root/testdata/sf0.1")
    with pytest.raises(ValueError, match=message):
        flows.panel_to_models(panel, fx.panel_dimension(spark, SF), str(tmp_path), run)
    assert not (tmp_path / "ticker_losses").exists()


def test_panel_by_ticker_needs_no_shuffle(spark, tmp_path):
    """Features and models of a panel in buckets: not one exchange between the scan and the forecasts, in a new session too."""
    panel = landing.write_by_ticker(fx.log_panel(spark, "/root/testdata/sf0.01"), str(tmp_path / "panel"), 4)
    spark.sql("DROP TABLE " + landing._table_name(str(tmp_path / "panel")))
    again = landing.read_by_ticker(spark, str(tmp_path / "panel"), 4)
    forecasts = rolling.har_forecasts(again, (60,))
    assert "Exchange" not in forecasts._jdf.queryExecution().executedPlan().toString()
    assert forecasts.count() == rolling.har_forecasts(fx.log_panel(spark, "/root/testdata/sf0.01"), (60,)).count() > 0
    assert panel.dtypes == again.dtypes


def payload(path, name, *lines):
    path.mkdir(exist_ok=True)
    (path / name).write_text("".join(x if isinstance(x, str) else json.dumps({"ticker": x[0], "results": [{"t": t, "c": c} for t, c in x[1]]}) + "\n" for x in lines))


def test_deliveries(spark, tmp_path):
    """Two payloads of one ticker and time in one file and in two, a summer and a winter day, lines that do not parse, one without a ticker."""
    winter = int(dt.datetime(2024, 1, 3, 14, 30, tzinfo=dt.timezone.utc).timestamp() * 1000)
    summer = int(dt.datetime(2024, 7, 3, 13, 30, tzinfo=dt.timezone.utc).timestamp() * 1000)
    early = summer - 60_000
    payload(tmp_path / "in", "b.json", ("M", [(winter, 1.0), (summer, 2.0), (early, 9.0)]), ("S", [(winter, 3.0)]), "{broken\n", ("S", [(winter, 2.0)]))
    payload(tmp_path / "in", "a.json", ("S", [(winter, 1.0), (summer, 5.0)]), '{"ticker": null, "results": []}\n', ("E", []), '{"ticker": "S", "results": 7}\n')
    for name, seconds in (("a.json", 2_000_000), ("b.json", 1_000_000)):
        os.utime(tmp_path / "in" / name, (seconds, seconds))
    rows = flows.land(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    dimension = spark.createDataFrame([("S", "A", None)], "ticker string, sector string, sector_etf string")
    bars = flows.import_bars(rows, dimension, str(tmp_path / "out"), None, flows.Run("M"))
    got = sorted((r.ticker, str(r.date), r.m, r.close) for r in bars.collect())
    assert got == [("M", "2024-01-03", 0, 1.0), ("M", "2024-07-03", 0, 2.0), ("S", "2024-01-03", 0, 3.0), ("S", "2024-07-03", 0, 5.0)]
    bad = spark.read.parquet(str(tmp_path / "out" / "quarantine")).collect()
    assert len(bad) == 3 and {r.path.rsplit("/", 1)[1] for r in bad} == {"a.json", "b.json"} and sum(r.broken is None for r in bad) == 1


def test_redelivery_touches_its_dates_only(spark, tmp_path):
    """The day of the stock that a patch replaces is written anew, other folders keep their files, and a day of which nothing is left goes."""
    day, ts = (lambda d: dt.date(2024, 1, d)), (lambda d, m: dt.datetime(2024, 1, d, 9, m))
    rows = [("M", day(d), ts(d, m), 1.0) for d in (2, 3) for m in (30, 31, 32)] + [("S", day(d), ts(d, 30), 2.0) for d in (2, 3)] + [("Z", day(4), ts(4, 30), 1.0)]
    path = str(tmp_path / "bars")
    landing.write_table(spark.createDataFrame(rows, "ticker string, date date, ts timestamp, close double"), path, ["date"])
    files = lambda d: sorted(f.name for f in (tmp_path / "bars" / f"date=2024-01-0{d}").glob("*.parquet"))
    before = {d: files(d) for d in (2, 3, 4)}
    patch = spark.createDataFrame([("S", day(3), ts(3, 31), 7.0), ("S", day(3), ts(3, 45), 8.0), ("M", day(2), ts(2, 30), 9.0)], "ticker string, date date, ts timestamp, close double")
    found = landing.redelivered(path, patch, 0.5, 200)
    assert files(2) == before[2] and files(4) == before[4] and files(3) != before[3]
    assert sorted((r.ticker, r.date.day, r.ts.minute, r.close) for r in found.where("ticker = 'S'").collect()) == [("S", 2, 30, 2.0), ("S", 3, 31, 7.0)]
    assert found.where("ticker = 'M'").count() == 6
    gone = landing.redelivered(path, spark.createDataFrame([("Z", day(4), ts(4, 59), 1.0)], patch.schema), 0.0, 200)
    assert gone.where("ticker = 'Z'").isEmpty() and gone.where("ticker = 'M'").count() == 6


def test_dimension_of_lists(spark):
    """First delivered sector wins; a short primary list gives way to the fallback; unknown tickers and sectors without a fund stay."""
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "symbol string")
    sectors = spark.createDataFrame([("A", "Energy", 2), ("A", "Utilities", 1), ("B", "Nowhere", 1)], "ticker string, sector string, delivery int")
    found = landing.dimension_of(names("A"), names("A", "B", "B", "C", None), sectors, 2)
    assert sorted(map(tuple, found.collect()), key=repr) == [("A", "Utilities", "XLU"), ("B", "Nowhere", None), ("C", None, None)]
    assert landing.dimension_of(names("A"), names("B"), sectors, 1).count() == 1


def test_import_bars(spark, tmp_path):
    """Two days of three minutes: a bar twice, a bar before the session, a day of the stock alone, and a day that is delivered again."""
    at = lambda day, h, m: int(dt.datetime(2024, 1, day, h + 5, m, tzinfo=dt.timezone.utc).timestamp() * 1000)
    market = [{"t": at(d, 9, m), "c": 10.0 + m} for d in (2, 3) for m in (30, 31, 32)]
    stock = [{"t": at(2, 9, 30), "c": 1.0}, {"t": at(2, 9, 30), "c": 9.0}, {"t": at(2, 9, 29), "c": 7.0}, {"t": at(2, 9, 31), "c": 2.0}, {"t": at(4, 9, 31), "c": 5.0}]
    payloads = spark.createDataFrame([("M", market), ("F", market), ("S", stock), ("E", [])], "ticker string, results array<struct<t: bigint, c: double>>")
    dimension = spark.createDataFrame([("S", "A", "F")], "ticker string, sector string, sector_etf string")
    ts = lambda m: dt.datetime(2024, 1, 2, 9, m)
    patch = spark.createDataFrame([("S", dt.date(2024, 1, 2), ts(31), 3.0), ("S", dt.date(2024, 1, 2), ts(45), 4.0)], "ticker string, date date, ts timestamp, close double")
    run = flows.Run("M", bad_share=0.3)
    bars = flows.import_bars(payloads, dimension, str(tmp_path / "a"), None, run)
    assert [(r.m, r.close) for r in bars.where("ticker = 'S'").orderBy("m").collect()] == [(0, 1.0), (1, 2.0)]
    assert bars.where("ticker = 'M'").count() == 6
    bars = flows.import_bars(payloads, dimension, str(tmp_path / "b"), patch, run)
    assert [(r.m, r.close) for r in bars.where("ticker = 'S'").collect()] == [(1, 3.0)]
    with pytest.raises(ValueError, match="no bars of Z"):
        flows.import_bars(payloads, spark.createDataFrame([("S", "A", "Z")], dimension.schema), str(tmp_path / "c"), None, run)
