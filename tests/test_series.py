"""Run-length ticker-days against the panel that has every minute, and the carry over blocks."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from volpanel.functions.columns import rounded
from volpanel.operators import clean, series, variance

PER_DAY = 12
BARS = "ticker string, date date, m int, close double"


def days_of(n, step=1, start=dt.date(2024, 1, 2)):
    return [start + dt.timedelta(days=step * i) for i in range(n)]


@pytest.fixture(scope="module")
def bars(spark):
    """Thin bars with null, zero and negative closes, bars off the grid, equal closes, a ticker without any close; 40 days over four months."""
    rng = random.Random(3)
    rows = [(t, d, m, rng.choice([None, 0.0, -1.0, 5.0, 5.0, rng.uniform(1, 9)])) for t in "ABC" for d in days_of(40, 3) for m in range(-1, PER_DAY + 1) if rng.random() < {"A": 0.9, "B": 0.3, "C": 0.03}[t]]
    return spark.createDataFrame([*rows, ("D", days_of(1)[0], 3, None)], BARS).persist()


def same(a, b, *keys):
    rows = lambda df: sorted(map(tuple, df.select(*sorted(df.columns)).transform(rounded, 9).collect()), key=repr)
    assert sorted(a.columns) == sorted(b.columns) and rows(a) == rows(b)


def both(bars):
    days = bars.select("date").distinct()
    seen = series.observed(bars)
    return series.opened(seen, days, bars, PER_DAY), clean.filled(clean.aligned(bars, clean.grid(days, PER_DAY), bars))


def test_fills_returns_and_variances(bars):
    days, full = both(bars)
    same(series.filled(days, PER_DAY), full)
    returned, long = series.with_returns(days, PER_DAY), clean.log_returns(full)
    same(series.long_returns(returned), long)
    same(series.zero_shares(returned, PER_DAY), clean.zero_shares(long))
    shut = series.opened_market(returned, PER_DAY, 0.4)
    left = clean.open_bars(long, 0.4)
    assert 0 < left.count() < long.count()
    same(series.open_returns(shut), clean.renumbered(left))
    for k, partial in ((3, False), (5, True), (1, True)):
        got = series.interval_variance(series.day_returns(shut), k, partial).where("n_blocks > 0")
        same(got, variance.interval_variance(left, k, partial).where("n_blocks > 0"))
    same(series.daily_log_rv(series.day_returns(shut), 3, False, 2).where("log_rv IS NOT NULL"), variance.daily_log_rv(left, 3, False, 2).where("log_rv IS NOT NULL"))
    same(series.price_counts(days, PER_DAY), clean.price_counts(clean.aligned(bars, clean.grid(bars, PER_DAY), bars)))


def test_hole_over_three_blocks(spark):
    """A close in January holds until May; before its first close a ticker has that one, whichever month it comes in."""
    days = days_of(6, 25)
    rows = [("A", days[0], 5, 2.0), ("A", days[5], 3, 4.0), ("B", days[4], 6, 7.0), ("C", days[0], 0, 1.0)]
    found, full = both(spark.createDataFrame(rows + [("X", d, 0, 1.0) for d in days], BARS))
    assert {d.month for d in days[1:5]} == {1, 2, 3, 4}
    close = {(r.ticker, r.date, r.m): r.close for r in series.filled(found, PER_DAY).collect()}
    assert all(close["A", d, m] == 2.0 for d in days[:5] for m in range(PER_DAY)) and close["A", days[5], 2] == 2.0 and close["A", days[5], 3] == 4.0
    assert {close["B", d, m] for d in days for m in range(PER_DAY)} == {7.0}
    same(series.filled(found, PER_DAY), full)


def test_days_are_checked(spark, bars):
    days, _ = both(bars)
    assert series.check_days(days, bars) is days
    with pytest.raises(ValueError, match="days expected"):
        series.check_days(days.where(F.col("date") != days_of(1)[0]), bars)


def test_plan_has_no_minutes_by_ticker(bars):
    """No window is keyed by the ticker alone but that over a row a month, and nothing is joined with the grid."""
    plan = series.daily_log_rv(series.day_returns(series.with_returns(both(bars)[0], PER_DAY)), 3)._jdf.queryExecution().optimizedPlan().toString()
    alone = [line for line in plan.splitlines() if "Window" in line and "[ticker#" in line and "__block#" not in line.split("[ticker#")[1].split("]")[0] and "__last" not in line]
    assert not alone and "explode(sequence" not in plan


def test_empty(spark):
    found, full = both(spark.createDataFrame([], BARS))
    assert found.isEmpty() and full.isEmpty() and series.filled(found, PER_DAY).isEmpty()
