"""Peaks and earlier peaks of several series, three of them with NULL keys, in many small pieces."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions import kernels as N
from tickloom.operators import blocks as B
from tickloom.operators import peaks as P
from tickloom.operators.layout import POS, mark_bars

START = dt.datetime(2024, 1, 1)
KEYS = [("x", "A"), ("y", "A"), (None, "A"), ("x", None), (None, None)]


def prices(k, n=400):
    rng = np.random.default_rng(k)
    if k == 1:  # falls for long: peaks look far back, and many at one piece
        return np.where(np.arange(n) == 3, 500.0, 300 - 0.5 * np.arange(n)) + np.arange(n) % 7
    if k == 2:  # rises for long
        return 100 + 0.3 * np.arange(n) + 3 * np.sin(np.arange(n))
    return 100 + rng.normal(0, 1, n).cumsum()


@pytest.fixture(params=[(64, 32), (20, 3)])
def small(request, monkeypatch):
    monkeypatch.setattr(P, "ROWS", request.param[0])
    monkeypatch.setattr(P, "ASKS", 8)
    monkeypatch.setattr(B, "RADIX", request.param[1])


@pytest.fixture(scope="module")
def bars(spark):
    rows = []
    for k, (c, t) in enumerate(KEYS):
        rows += [(c, t, START + dt.timedelta(hours=i), float(x) + 0.2, float(x) - 0.2, float(x)) for i, x in enumerate(prices(k))]
    df = spark.createDataFrame(rows, "connector string, trading_pair string, ts timestamp_ntz, high double, low double, close double")
    return mark_bars(df, 3600)


def own(rows, c, t):
    return [r for r in rows if r.connector == c and r.trading_pair == t]


def test_series_peaks_of_every_series(bars, small):
    got = P.series_peaks(bars, 0.1, 7).collect()
    for k, (c, t) in enumerate(KEYS):
        high, low = prices(k) + 0.2, prices(k) - 0.2
        nominal = 0.1 * (high.max() - low.min())
        for kind, x in (("high", high), ("low", -low)):
            assert sorted(r[POS] for r in own(got, c, t) if r.kind == kind) == N.find_peaks(x, nominal, 7).tolist()


@pytest.mark.parametrize("above", [True, False])
def test_earlier_peak_of_every_series(bars, small, above):
    rows, want = [], {}
    for k, (c, t) in enumerate(KEYS):
        x = prices(k)
        at = [i for i in range(1, len(x) - 1) if (x[i - 1] < x[i] > x[i + 1] if above else x[i - 1] > x[i] < x[i + 1])]
        rows += [(c, t, i, float(x[i])) for i in at]
        for i, px in enumerate(x):
            beyond = [x[j] for j in at if j < i and (x[j] > px if above else x[j] < px)]
            want[c, t, i] = float(beyond[-1]) if beyond else -1.0
    peaks = bars.sparkSession.createDataFrame(rows, f"connector string, trading_pair string, {POS} long, price double")
    out = P.earlier_peak(bars, peaks, "found", above, F.lit(-1.0)).collect()
    assert {(r.connector, r.trading_pair, r[POS]): r.found for r in out} == want and len(out) == 400 * len(KEYS)


def test_level_windows_of_every_series(bars):
    w = P.level_windows(bars).collect()
    assert {(r.connector, r.trading_pair) for r in w} == set(KEYS)
    levels = P.nearest_levels(P.level_windows(bars), bars).collect()
    assert len(levels) == len(KEYS) and all(r.high_clusters is not None for r in levels)
