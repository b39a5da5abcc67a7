"""Windows put together from parts, features calculated once, pieces sorted once: results and plans."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from tickloom.operators import recursive as C
from tickloom.operators import rolling as R
from tickloom.operators.layout import own_rows, segmented
from tickloom.plans import features as P

BARS = "connector string, trading_pair string, ts timestamp_ntz, open double, high double, low double, close double, volume double, taker_buy_base_volume double"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def bars(spark):
    rng = np.random.default_rng(3)
    rows = []
    for pair, n in (("A", 260), ("B", 70), (None, 40)):
        for i in range(n):
            close = 7.1 if pair == "B" else float(100 + rng.normal())
            volume = None if pair == "A" and i % 37 == 5 else float(rng.integers(0, 4))
            rows.append(("x", pair, dt.datetime(2024, 1, 1) + dt.timedelta(days=i), close, close + 1, close - 1, close, volume, 1.0))
    return spark.createDataFrame(rows, BARS)


def one(rows, pair, column):
    found = rows[rows.trading_pair.isna() if pair is None else rows.trading_pair == pair].sort_values("ts")
    return found[column].to_numpy(dtype=float)


@pytest.mark.parametrize("n, rows", [(100, 130), (30, 8192), (7, 130)])
def test_windows_from_parts(bars, n, rows):
    df, p = segmented(bars, 110, rows=rows)
    df = own_rows(R.moments(R.means(df, p, n, {"m": "volume"}), p, n, "close", "volume")).toPandas()
    for pair in ("A", "B", None):
        volume, close = (pd.Series(one(df, pair, c)) for c in ("volume", "close"))
        np.testing.assert_allclose(one(df, pair, "m"), volume.rolling(n, min_periods=1).mean(), rtol=1e-12, atol=1e-12)
        for x, c in ((close, "close"), (volume, "volume")):
            full = x.rolling(n, min_periods=n)
            np.testing.assert_allclose(one(df, pair, f"_mean_{c}"), full.mean(), rtol=1e-12, atol=1e-12)
            np.testing.assert_allclose(one(df, pair, f"_m2_{c}"), full.apply(lambda v: ((v - v.mean()) ** 2).sum(), raw=True), rtol=1e-9, atol=1e-11)
    if n <= 70:
        assert set(one(df, "B", "_m2_close")[n - 1:]) == {0.0}


def test_a_long_window_takes_short_frames(bars):
    assert [R.part_rows(n) for n in (7, 30, 100, 101)] == [7, 5, 10, 101]
    assert "-99" not in plan(P.Volume().calculate(bars))
    assert "var_pop" in plan(P.Volatility(30).calculate(bars)) and "stddev_samp" not in plan(P.Volatility(30).calculate(bars))


def test_a_summary_feature_is_calculated_once(bars):
    f = P.Volatility(30)
    rows = P.feature_rows(f.calculate(bars), f)
    assert plan(rows).count("Join") == plan(f.calculate(bars)).count("Join")
    whole = f.calculate(bars).toPandas()
    got = {r.trading_pair: r for r in rows.collect()}
    assert set(got) == {"A", "B", None}
    for pair, r in got.items():
        v = one(whole, pair, "volatility")
        kept = v[~np.isnan(v)]
        assert r.value_map["mean_volatility"] == pytest.approx(kept.mean())
        assert r.value_map["current_volatility"] == pytest.approx(v[-1])
        assert r.ts == dt.datetime(2024, 1, 1) + dt.timedelta(days=len(v) - 1)


def test_a_channel_sorts_its_pieces_once(spark, bars):
    channel = P.MeanReversionChannel(length=40)
    out = channel.calculate(bars)
    assert "_b#" not in plan(out)  # no second block, which sorts every piece again
    assert C.one_block_rows(500, C.supersmoother_rate(40)) + 500 < C.SAFE_EXPONENT / C.supersmoother_rate(40)
    c1, c2, c3 = C.supersmoother_coefficients(40)
    out = out.toPandas()
    x = one(out, "A", "close")
    y = x.copy()
    for i in range(2, len(x)):
        y[i] = c1 * x[i] + c2 * y[i - 1] + c3 * y[i - 2]
    np.testing.assert_allclose(one(out, "A", "meanline"), y, rtol=1e-10)
