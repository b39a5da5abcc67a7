"""First crossings and band sums from block summaries equal a look at every bar, whatever the block size."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import blocks as B
from tickloom.operators import labels as L

START = dt.datetime(2024, 1, 1)
KEYS = (("x", "A"), ("y", "A"), (None, "A"), ("x", None), (None, None))


def minute(i):
    return START + dt.timedelta(minutes=int(i))


def series(seed, n=150):
    """Bars with gaps, repeated times, NULL prices and times on five series, three of them with NULL keys."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in KEYS:
        at = np.sort(rng.choice(np.arange(3 * n), n, replace=bool(seed % 2)))
        price = 100 * np.exp(rng.normal(0, 0.01, n).cumsum())
        rows += [(*k, minute(i), None if rng.random() < 0.03 else float(p)) for i, p in zip(at, price)]
        rows.append((*k, None, 100.0))
    return rows


@pytest.fixture(params=[32, 3])
def radix(request, monkeypatch):
    monkeypatch.setattr(B, "RADIX", request.param)
    return request.param


@pytest.mark.parametrize("seed, limit", [(1, 40), (2, 7), (3, 200)])
def test_first_touch_against_every_bar(spark, radix, seed, limit):
    rows = series(seed)
    bars = spark.createDataFrame(rows, "connector string, trading_pair string, ts timestamp_ntz, close double")
    # events at bars, between bars, before the first and after the last one
    events, want = [], {}
    for n, k in enumerate(KEYS):
        for j, i in enumerate([-300, -5, 0, 3, 50, 51, 52, 200, 333, 420, 449, 460, 5000]):
            events.append((*k, 100 * n + j, minute(i), 100.0, (-1, 1, 1, 0)[j % 4], 0.01 + 0.01 * (j % 3), 0.015))
        events.append((*k, 100 * n + 99, None, 100.0, 1, 0.01, 0.01))
    for c, p, number, t0, close, side, tp, sl in events:
        own = sorted((t, v) for a, b, t, v in rows if (a, b) == (c, p) and t is not None and v is not None and t0 is not None
                     and t0 <= t <= t0 + dt.timedelta(minutes=limit if side else 0))
        ret = [(t, (v / close - 1) * side) for t, v in own]
        up, down = ([t for t, r in ret if r > tp], [t for t, r in ret if r < -sl])
        want[number] = (min(up, default=None), min(down, default=None))
    e = spark.createDataFrame(events, "connector string, trading_pair string, number long, ts timestamp_ntz, close double, side int, tp double, sl double")
    out = L.first_touch(e, bars, F.col("tp"), F.col("sl"), limit * 60).collect()
    assert {r.number: (r.take_profit_time, r.stop_loss_time) for r in out} == want and len(out) == len(events)
    for r in out:
        ends = [x for x in (r.tl, *want[r.number]) if x is not None]
        assert r.close_time == (min(ends) if ends else None)


@pytest.mark.parametrize("seed, limit", [(1, 40), (2, 300), (4, 3)])
def test_band_sums_against_every_bar(spark, radix, seed, limit):
    rows = series(seed)
    bars = spark.createDataFrame(rows, "connector string, trading_pair string, ts timestamp_ntz, close double")
    spans = [(*k, 100 * n + j, minute(i), minute(i + w)) for n, k in enumerate(KEYS)
             for j, (i, w) in enumerate([(-20, 10), (0, limit), (17, limit // 2), (100, limit), (444, limit), (30, -2), (9000, 5)])]
    e = spark.createDataFrame(spans, "connector string, trading_pair string, number long, a timestamp_ntz, b timestamp_ntz")
    got = {r.number: r for r in B.band_aggregates(e, bars, "close", "a", "b", limit * 60, ["number"]).collect()}
    assert len(got) == len(spans)
    for c, p, number, a, b in spans:
        own = [v for x, y, t, v in rows if (x, y) == (c, p) and t is not None and a <= t <= b]
        known = [v for v in own if v is not None]
        r = got[number]
        assert (r.n, r["count"], r.lowest, r.highest) == (len(own), len(known), min(known, default=None), max(known, default=None))
        assert r["sum"] is None if not known else abs(r["sum"] - sum(known)) < 1e-6


def test_a_wrong_bar_length_is_no_silent_cut(spark, monkeypatch):
    from tickloom.operators.layout import mark_bars
    monkeypatch.setattr(B, "RADIX", 4)
    rows = [("x", "A", START + dt.timedelta(seconds=i), 100.0) for i in range(200)]
    bars = mark_bars(spark.createDataFrame(rows, "connector string, trading_pair string, ts timestamp_ntz, close double"), 60)
    e = bars.limit(1).withColumns({"side": F.lit(1)})
    with pytest.raises(Exception, match="holds more than"):
        L.first_touch(e, bars, F.lit(1.0), F.lit(1.0), 120).collect()
