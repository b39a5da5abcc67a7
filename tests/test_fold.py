"""State machines in pieces equal one pass, for resetting and never-resetting series and NULL keys."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom.operators.fold import ResetSum, SuperTrendBands, fold_series, reset_cumsum, supertrend
from tickloom.operators.layout import mark_bars, own_rows, segmented

START = dt.datetime(2024, 1, 1)


def in_pieces(machine, pdf, cuts):
    """Effects first, then starts, then runs, as on Spark."""
    edges = [0, *sorted(cuts), len(pdf)]
    parts = [pdf.iloc[a:b] for a, b in zip(edges, edges[1:])]
    state, out = machine.initial, []
    for part in parts:
        out.append(pd.DataFrame(machine.run(part, state)))
        state = machine.apply(machine.effect(part), state)
    return pd.concat(out, ignore_index=True)


def random_bars(rng, n, kind):
    step = {"walk": 1.0, "rise": 0.01, "coarse": 2.0}[kind]
    close = 100 + rng.normal(0.5 if kind == "rise" else 0, step, n).cumsum()
    if kind == "coarse":
        close = np.round(close)
    high, low = close + rng.random(n) * step, close - rng.random(n) * step
    atr = rng.random(n) * step
    atr[rng.random(n) < 0.1] = np.nan
    return pd.DataFrame({"high": high, "low": low, "close": close, "_atr": atr})


@pytest.mark.parametrize("kind", ["walk", "rise", "coarse"])
def test_supertrend_in_pieces_bit_by_bit(kind):
    rng = np.random.default_rng(5)
    for _ in range(150):
        n = int(rng.integers(1, 120))
        pdf, m = random_bars(rng, n, kind), SuperTrendBands(float(rng.choice([0.2, 1.0, 3.0])))
        whole = pd.DataFrame(m.run(pdf, m.initial))
        cuts = rng.choice(np.arange(1, n + 1), int(rng.integers(0, min(n, 12) + 1)), replace=True)
        pd.testing.assert_frame_equal(in_pieces(m, pdf, cuts), whole, check_exact=True)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(-6, 6), st.none()), min_size=1, max_size=60), st.lists(st.integers(0, 60), max_size=8),
       st.sampled_from([0.25, 0.5]))
def test_reset_sum_in_pieces(changes, cuts, sensitivity):
    # eighths and powers of two: sums and shares are exact, so ties are ties in both
    pdf = pd.DataFrame({"chg": [np.nan if c is None else c / 8 for c in changes]})
    m = ResetSum("cum", "chg", sensitivity)
    whole = pd.DataFrame(m.run(pdf, m.initial))
    pd.testing.assert_frame_equal(in_pieces(m, pdf, [min(c, len(changes)) for c in cuts]), whole, check_exact=True)


@pytest.mark.parametrize("scale", [0.0, 0.2, 2.0])
def test_reset_sum_of_walks_in_pieces(scale):
    rng = np.random.default_rng(8)
    for _ in range(100):
        n = int(rng.integers(1, 200))
        pdf, m = pd.DataFrame({"chg": rng.normal(scale * 0.1, 1, n) * rng.choice([1, -1])}), ResetSum("cum", "chg", 0.3)
        cuts = rng.choice(np.arange(1, n + 1), int(rng.integers(0, min(n, 15) + 1)), replace=True)
        got, whole = in_pieces(m, pdf, cuts), pd.DataFrame(m.run(pdf, m.initial))
        np.testing.assert_allclose(got["cum"], whole["cum"], atol=1e-9)


def test_effects_of_quiet_pieces_are_small():
    rng = np.random.default_rng(2)
    rise = pd.DataFrame({"high": np.arange(8192) + 1.0, "low": np.arange(8192) - 1.0, "close": np.arange(8192.0), "_atr": np.full(8192, 50.0)})
    assert len(SuperTrendBands(2.0).effect(rise)) < 12
    walk = random_bars(rng, 4000, "walk")
    assert len(SuperTrendBands(2.0).effect(walk)) < 40
    assert len(ResetSum("cum", "chg", 0.3).effect(pd.DataFrame({"chg": rng.normal(size=4000)}))) < 600


KEYS = [("x", "A"), ("y", "A"), (None, "A"), ("x", None), (None, None)]


@pytest.mark.parametrize("rows, halo", [(30, 0), (30, 5), (8192, 0)])
def test_fold_series_on_spark(spark, rows, halo):
    """Five series, three of them with NULL keys; one never resets over all its pieces."""
    rng = np.random.default_rng(4)
    parts = []
    for k, (c, t) in enumerate(KEYS):
        d = random_bars(rng, 200, "rise" if k == 2 else "walk").assign(connector=c, trading_pair=t, chg=rng.normal(0.5 if k == 2 else 0, 1, 200))
        if k == 2:
            d["_atr"], d["chg"] = 500.0, np.abs(d["chg"])
        parts.append(d)
    names = ["connector", "trading_pair", "high", "low", "close", "_atr", "chg"]
    data = [(START + dt.timedelta(hours=i), *(None if v != v else v for v in row)) for d in parts
            for i, row in enumerate(d[names].itertuples(index=False, name=None))]
    df = spark.createDataFrame(data, "ts timestamp_ntz, connector string, trading_pair string, high double, low double, "
                               "close double, _atr double, chg double")
    d, p = segmented(mark_bars(df, 3600), halo, rows=rows)
    for machine in (supertrend(2.0), reset_cumsum("cum", "chg", 0.3)):
        got = own_rows(fold_series(d, p, machine)).toPandas()
        assert len(got) == 1000
        for (c, t), part in zip(KEYS, parts):
            mine = got[[(a == c or (a is None and c is None)) and (b == t or (b is None and t is None))
                        for a, b in zip(got.connector, got.trading_pair)]].sort_values("ts")
            want = machine.run(part, machine.initial)
            for column in machine.columns:
                np.testing.assert_allclose(mine[column].to_numpy(dtype=float), want[column], atol=1e-9)
