"""Operator 11 against a plain scan of all pairs."""

import math

import numpy as np
import pytest

from volpanel.llm import hard_negatives as hn


def plain(rows):
    """All pairs, by Python's whole numbers."""
    v = {}
    for i, label, e in rows:
        if i is not None and label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            v[i] = min(v.get(i, (label, list(e))), (label, list(e)))
    v = {i: ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in e]) for i, (label, e) in v.items()}
    out = []
    for a in (i for i in v if i % 100 == 0):
        score = {i: sum(x * y for x, y in zip(v[a][1], e, strict=True)) for i, (_, e) in v.items() if i != a and len(e) == len(v[a][1])}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if v[i][0] == v[a][0]][:5]:
            some = [i for i in order if v[i][0] != v[a][0] and 80 * score[p] <= 100 * score[i] <= 100 * score[p]][:5]
            out += [(a, p, k, i, score[p], score[i]) for k, i in enumerate(some, 1)]
    return sorted(out)


SCHEMA = "vec_id long, label int, embedding array<float>, data string, n int"


def mined(spark, rows):
    found = hn.mine(hn.relabelled(hn.taking_part(spark.createDataFrame([(i, label, e, "x", 1) for i, label, e in rows], SCHEMA))))
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, found.collect()))


def vectors(seed, n, dim, spread):
    """Clusters, so that bounds settle many rows; labels of which one has a third of all rows."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim)) + 2 * rng.normal(size=(6, 1))
    x = (centres[rng.integers(0, 6, n)] + spread * rng.normal(size=(n, dim))).astype(np.float32)
    return [(i, int(rng.choice([3, rng.integers(0, 10)])), x[i].tolist()) for i in range(n)]


@pytest.mark.parametrize("dim,spread", [(16, 0.3), (5, 1.0), (1, 1.0)])
def test_equals_plain_scan(spark, monkeypatch, dim, spread):
    monkeypatch.setattr(hn, "PART", 150)
    monkeypatch.setattr(hn, "GROUP", 4)
    rows = vectors(dim, 900, dim, spread)
    assert mined(spark, rows) == plain(rows)


def test_odd_rows(spark):
    """Nulls, non-finite numbers, other lengths, ties, repeated ids, zero vectors, no components."""
    rows = vectors(3, 250, 8, 0.2)
    rows += [(1000, None, [1.0] * 8), (1001, 2, None), (1002, 2, [1.0, None] * 4), (1003, 2, [float("nan")] * 8), (1100, 2, [float("inf")] * 8), (None, 3, [1.0] * 8)]
    rows += [(2000 + i, i % 2, [1.0, 2.0]) for i in range(12)] + [(3000 + i, i % 3, [0.0] * 8) for i in range(8)] + [(4000 + i, i % 3, []) for i in range(5)]
    rows += [(100, 3, [0.5] * 8), (100, 3, [0.25] * 8), (5, 1, [0.5] * 8), (5, 1, [0.5] * 8)]
    assert mined(spark, rows) == plain(rows)


def test_empty(spark):
    assert mined(spark, []) == [] and mined(spark, [(100, 1, [1.0])]) == []


def test_bounds_hold_and_settle_rows():
    rng = np.random.default_rng(2)
    x = np.floor(256 * (rng.normal(size=(300, 24)) * 0.05 + rng.normal(size=(300, 1))))
    m, d = hn.summary(x)
    s = hn.scores(x, x)
    widths = []
    for means, deviations in hn.levels(m, d):
        middle, reach = means @ means.T, deviations @ deviations.T
        assert (np.abs(s - middle) <= reach + 1e-6 * np.abs(s) + 1e-3).all()
        widths.append(reach.mean())
    assert widths == sorted(widths, reverse=True)
    block = hn.Block([{"ids": np.arange(300), "labels": np.zeros(300, np.int32), "values": x, "means": m, "deviations": d}])
    best = np.sort(s[:10], 1)[:, -5].astype(float)
    columns, alive = hn.needed(block, slice(0, 10), block, best, np.full(10, np.inf))
    assert alive.sum() < 1000 and all((s[i] >= best[i]).sum() == ((s[i, columns] >= best[i]) & alive[i]).sum() for i in range(10))


def test_large_components():
    x = np.array([[2.0**40, 3.0], [2.0**40, -5.0]])
    assert hn.scores(x, x).tolist() == [[hn.MOST] * 2] * 2 and hn.scores(x[:, 1:], x[:, 1:]).tolist() == [[9, -15], [-15, 25]]
