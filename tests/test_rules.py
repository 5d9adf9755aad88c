"""Small panels made by hand, each for one rule."""

import datetime as dt
import math

import pytest

from volpanel.functions.columns import INFINITY
from volpanel.operators import checks, clean, features, significance, signature, variance
from volpanel.sources import bars

D1, D2, D3 = (dt.date(2024, 1, d) for d in (2, 3, 4))
BARS = "ticker string, date date, m int, close double"


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_gaps(spark):
    df = spark.createDataFrame([("a", D1, 0, 1.0), ("a", D1, 4, 1.0), ("a", D1, 5, 1.0), ("a", D2, 3, 1.0)], BARS)
    days = spark.createDataFrame([(D1,), (D2,), (D3,)], "date date")
    gaps = clean.day_gaps(df, days)
    assert rows(gaps, "date", "gap") == [(D1, 3.0), (D2, INFINITY), (D3, INFINITY)]
    assert rows(clean.gap_stats(gaps, 3), "n_days", "n_days_big_gap", "max_gap_any_day") == [(3, 3, 3.0)]


def test_fills_cross_days_and_returns_do_not(spark):
    df = spark.createDataFrame([("a", D1, 1, 2.0), ("a", D2, 1, 4.0)], BARS)
    full = clean.aligned(df, clean.check_grid(clean.grid(df, 3), 3), df)
    filled = clean.filled(full)
    assert rows(filled, "date", "m", "close") == [(D1, 0, 2.0), (D1, 1, 2.0), (D1, 2, 2.0), (D2, 0, 2.0), (D2, 1, 4.0), (D2, 2, 4.0)]
    r = rows(clean.log_returns(filled), "date", "m", "r")
    assert [x[2] for x in r if x[1] == 0] == [None, None] and r[4][2] == pytest.approx(math.log(2))


def test_early_close_keeps_the_threshold_and_empty_bars(spark):
    r = [("a", D1, 0, None), ("b", D1, 0, None), ("a", D1, 1, 0.0), ("b", D1, 1, 0.1), ("a", D1, 2, 0.0), ("b", D1, 2, 0.0)]
    kept = clean.renumbered(clean.open_bars(spark.createDataFrame(r, "ticker string, date date, m int, r double"), 0.5))
    assert rows(kept, "ticker", "m", "k") == [("a", 0, 1), ("a", 1, 2), ("b", 0, 1), ("b", 1, 2)]


def test_blocks_count_finite_returns(spark):
    values = [1.0, None, 2.0, 3.0, float("nan"), 4.0, 5.0, 6.0, 7.0]
    r = spark.createDataFrame([("a", D1, i, v) for i, v in enumerate(values)] + [("a", D2, 0, None)], "ticker string, date date, m int, r double")
    assert rows(variance.interval_returns(r, 3, True), "block", "r") == [(0, 6.0), (1, 15.0), (2, 7.0)]
    assert rows(variance.interval_variance(r, 3, False), "date", "rv", "n_blocks") == [(D1, 261.0, 2), (D2, None, 0)]
    flat = spark.createDataFrame([("a", D1, i, 0.0) for i in range(6)], "ticker string, date date, m int, r double")
    assert rows(variance.daily_log_rv(flat, 3, False, 1), "log_rv") == [(None,)]


@pytest.mark.parametrize("partial", [True, False])
def test_signature_helper_equals_built_in(spark, partial):
    r = spark.createDataFrame([("a", D1, i, math.sin(i) if i % 5 else None) for i in range(29)] + [("b", D1, 0, 1.0), ("b", D2, 0, None)], "ticker string, date date, m int, r double")
    shown = lambda df: [(*x[:3], round(x[3], 9) if x[3] is not None else None, x[4]) for x in rows(df, "ticker", "date", "interval_minutes", "rv", "n_blocks")]
    assert shown(signature.daily_signature(r, [1, 2, 7], partial)) == shown(signature.daily_signature_built_in(r, [1, 2, 7], partial))


def test_first_bar_wins_and_patches_replace_days(spark):
    raw = spark.createDataFrame([("a", 1, 5.0, 1), ("a", 1, 6.0, 0)], "ticker string, ts int, close double, ingest_seq int")
    assert rows(bars.first_bars(raw), "close") == [(6.0,)]
    df = spark.createDataFrame([("a", D1, 0, 1.0), ("a", D1, 1, 2.0), ("b", D1, 2, 3.0)], BARS)
    patch = spark.createDataFrame([("a", D1, 1, 9.0), ("a", D1, 7, 9.0)], BARS)
    assert rows(bars.overlay(df, df, patch, "m"), "ticker", "m", "close") == [("a", 1, 9.0), ("b", 2, 3.0)]


def test_payloads_and_session(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"ticker":"a","results":[{"t":1704205800000,"c":1.5},{"t":1704205740000,"c":1.0}]}\n{"ticker":"b"}\n')
    got = bars.session_bars(bars.read_payloads(spark, str(tmp_path)))  # 09:30 and 09:29 in New York
    assert [(r.ticker, r.date, r.close) for r in got.collect()] == [("a", D1, 1.5)]


def test_dimension(spark):
    dim = spark.createDataFrame([("a", "Energy"), ("a", "Utilities"), ("c", "Nowhere")], "ticker string, sector string")
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "ticker string")
    out = bars.add_sector_fund(bars.attach_sector(names, dim), bars.sector_funds(spark))
    assert rows(out, "ticker", "sector", "sector_etf") == [("a", "Energy", "XLE"), ("b", None, None), ("c", "Nowhere", None)]
    assert rows(bars.full_universe(out, "SPY"), "ticker") == [("SPY",), ("XLE",), ("a",), ("b",), ("c",)]
    assert rows(bars.universe(names.withColumnRenamed("ticker", "symbol"), dim.withColumnRenamed("ticker", "symbol"), 4), "symbol") == [("a",), ("c",)]


def test_gap_rules_differ(spark):
    """One missing day takes up to 23 feature rows, and one row of the component panel."""
    days = [dt.date(2024, 1, 1) + dt.timedelta(i) for i in range(80)]
    data = [(t, d, None if t == "a" and i == 40 else float(i % 7) + len(t)) for t in ("a", "bb", "m") for i, d in enumerate(days)]
    panel = spark.createDataFrame(data, "ticker string, date date, log_rv double")
    n = {r.ticker: r.n for r in features.har_rows(panel).groupBy("ticker").count().withColumnRenamed("count", "n").collect()}
    assert n["bb"] - n["a"] == 23
    who = spark.createDataFrame([("a", "s", "bb", "m")], "ticker string, sector string, sector_etf string, market_ticker string")
    assert features.component_rows(panel, who).count() == 79


GOOD = dict(ticker="a", forecast_origin_date=D1, target_date=D2, actual=1.0, forecast=0.5, error=0.5, squared_error=0.25, absolute_error=0.5, qlike=math.exp(0.5) - 1.5)
SCHEMA = "model string, ticker string, forecast_origin_date date, target_date date, actual double, forecast double, error double, squared_error double, absolute_error double, qlike double"


def forecasts(spark, *changes):
    return spark.createDataFrame([{"model": "HAR"} | GOOD | c for c in changes], SCHEMA)


def test_each_check_counts_one(spark):
    df = forecasts(spark, {}, {"target_date": D3}, {"target_date": D3}, {"ticker": ""}, {"ticker": "n", "forecast": float("nan")}, {"ticker": "o", "forecast_origin_date": D3}, {"ticker": "q", "qlike": 9.0})
    s = checks.model_summary(df).first()
    assert (s.n_duplicate_pairs, s.n_missing_key_rows, s.n_nonfinite_rows, s.n_invalid_date_order, s.n_inconsistent_rows) == (1, 1, 1, 1, 2)
    assert s.n_qlike_mismatch == 2 and s.n_rows == 7
    with pytest.raises(ValueError, match="QLIKE"):
        checks.raise_if_fatal(checks.model_checks(checks.model_summary(df)))
    with pytest.raises(ValueError):
        checks.standard(df.drop("qlike"))


def test_alignment_severities(spark):
    df = forecasts(spark, {}, {"model": "B"}, {"target_date": D3}, {"model": "B", "target_date": D3, "forecast_origin_date": D2})
    status = {r.check_name: r.status for r in checks.alignment_checks(df, ["HAR", "B"], "HAR").collect()}
    assert status["Forecast origins identical on common pairs"] == "WARNING" and "FAIL" not in status.values()
    other = forecasts(spark, {}, {"model": "B", "actual": 2.0, "error": 1.5, "squared_error": 2.25, "absolute_error": 1.5, "qlike": math.exp(1.5) - 2.5}, {"model": "B", "ticker": "z"})
    failed = {r.check_name for r in checks.alignment_checks(other, ["HAR", "B"], "HAR").where("status = 'FAIL'").collect()}
    assert failed == {"Same ticker universe", "Same ticker-date universe", "Actual values identical on common pairs"}
    assert rows(checks.universe_differences(checks.presence(other, ["HAR", "B"]), ["HAR", "B"], "HAR", "ticker"), "model", "ticker", "kind") == [("B", "z", "extra")]


def test_constant_and_single_differences_are_invalid(spark):
    data = [(100, "B", "R", "mse", "squared_error", t, "s", D1 + dt.timedelta(i), 2.0, 1.0, 1.0) for t, n in (("one", 1), ("flat", 9)) for i in range(n)]
    cols = "training_window int, benchmark_model string, relative_model string, metric string, metric_column string, ticker string, sector string, target_date date, benchmark_loss double, relative_loss double, difference double"
    out = significance.stock_tests(spark.createDataFrame(data, cols))
    assert rows(out, "ticker", "test_result", "test_status", "dmw_stat") == [("flat", "invalid_variance", "invalid", None), ("one", "invalid_variance", "invalid", None)]


def test_planted_metadata_faults_are_seen(spark):
    """Every check that a fault is planted for fails, and only these."""
    from volpanel.plans import queries_faults

    status = {r.check_name: r.status for r in queries_faults.planted_metadata_checks(spark, "/root/testdata/sf0.01").collect()}
    assert status.pop("Metadata available in at least one model") == "PASS" and set(status.values()) == {"FAIL"}
