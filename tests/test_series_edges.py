"""Rows with NULL keys or times, two venues with the same pair, and series longer than any look-back."""

from __future__ import annotations

import datetime as dt
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions import kernels as N
from tickloom.operators import pairs as Q
from tickloom.operators.ingest import fill_forward
from tickloom.operators.layout import magnitude_slice, number_rows, prefix_scan
from tickloom.operators.quantiles import exact_quantiles
from tickloom.plans import portfolio as Po
from tickloom.plans import screeners as Sc

START = dt.datetime(2024, 1, 1)
BARS = "connector string, trading_pair string, ts timestamp_ntz, close double"


def hour(i):
    return START + dt.timedelta(hours=i)


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [("x", "A", hour(0), 1.0), ("x", "A", hour(5000), 2.0), (None, "A", hour(1), 3.0), (None, "A", hour(2), None),
            ("x", None, hour(1), 5.0), ("x", "A", None, 7.0), (None, None, None, 8.0), ("y", "A", hour(0), 9.0)]
    return spark.createDataFrame(rows, BARS)


def test_null_keys_and_times_stay(awkward):
    out = number_rows(awkward).collect()
    at = defaultdict(list)
    for r in out:
        at[(r.connector, r.trading_pair)].append(r._pos)
    assert {k: sorted(v) for k, v in at.items()} == {
        ("x", "A"): [0, 1, 2], (None, "A"): [0, 1], ("x", None): [0], (None, None): [0], ("y", "A"): [0]}
    filled = fill_forward(awkward, ["close"]).collect()
    assert len(filled) == 8 and [r.close for r in filled if r.connector is None and r.ts == hour(2)] == [3.0]
    q = exact_quantiles(awkward, {"m": (F.col("close"), 0.5)}).collect()
    assert {(r.connector, r.trading_pair): r.m for r in q} == {("x", "A"): 2.0, (None, "A"): 3.0, ("x", None): 5.0, (None, None): 8.0, ("y", "A"): 9.0}


def test_slices_follow_the_order_and_fit_any_magnitude(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=200) * 10.0 ** rng.integers(-12, 12, 200), [0.0, -1e-300, 1e300]])
    d = spark.createDataFrame([(float(v),) for v in x], "v double").withColumn("s", magnitude_slice("v"))
    out = sorted((r.v, r.s) for r in d.collect())
    assert [s for _, s in out] == sorted(s for _, s in out) and len({s for _, s in out}) > 150
    run = prefix_scan(d.withColumn("k", F.lit(1)), {"n": ("count", F.lit(1))}, ["k"], ["v"], segment=F.col("s")).collect()
    assert [r.n for r in sorted(run, key=lambda r: r.v)] == list(range(1, len(x) + 1))


@pytest.fixture(scope="module")
def long_series(spark):
    """3,000 hourly bars of three symbols on two venues, with gaps; b follows a by two bars on the first venue."""
    rng = np.random.default_rng(7)
    rows = []
    for venue in ("x", "y"):
        a = rng.normal(size=3003)
        b = np.roll(a, 2) * (1 if venue == "x" else -1) + rng.normal(size=3003) * 0.5
        c = rng.normal(size=3003)
        for name, v in (("A", a), ("B", b), ("C", c)):
            rows += [(venue, name, hour(i), float(v[i])) for i in range(3000) if not (name == "C" and i % 17 == 0)]
    return rows, spark.createDataFrame(rows, BARS)


def joined(rows, venue, p, q):
    left, right = ({t: v for c, n, t, v in rows if c == venue and n == s} for s in (p, q))
    times = sorted(left.keys() & right.keys())
    return np.array([left[t] for t in times]), np.array([right[t] for t in times])


PAIRS = [(v, p, q) for v in "xy" for p, q in (("A", "B"), ("A", "C"), ("B", "C"))]


def test_lead_lag_over_the_whole_history(long_series, monkeypatch):
    rows, values = long_series
    out = {(r.connector, r.pair1, r.pair2): r for r in Q.lead_lag(values, "close").collect()}
    assert set(out) == set(PAIRS)
    for key, r in out.items():
        assert np.allclose(r.correlations, N.lagged_correlations(*joined(rows, *key), 6))
    assert out[("x", "A", "B")].best_lag == -2 and out[("x", "A", "B")].dominant == "B"


def test_granger_over_the_whole_history(long_series, monkeypatch):
    monkeypatch.setattr("tickloom.operators.layout.SEGMENT_ROWS", 500)  # several pieces
    rows, values = long_series
    out = {(r.connector, r.predictor, r.response): r for r in Q.granger(values, "close").collect()}
    for venue, p, q in PAIRS:
        x1, x2 = joined(rows, venue, p, q)
        for predictor, response, x, y in ((p, q, x1, x2), (q, p, x2, x1)):
            want = [round(v, 4) for v in N.granger_p(y, x, 6)]
            assert np.allclose(out[(venue, predictor, response)].p_values, want, atol=2e-4)
    assert out[("x", "A", "B")].causal and out[("x", "A", "B")].dominant == "A"


def test_transfer_entropy_over_the_whole_history(long_series, monkeypatch):
    monkeypatch.setattr("tickloom.operators.layout.SEGMENT_ROWS", 700)
    rows, values = long_series
    out = {(r.connector, r.predictor, r.response): r.transfer_entropy for r in Q.information_flow(values, "close").collect()}
    for venue, p, q in PAIRS:
        x1, x2 = joined(rows, venue, p, q)
        assert out[(venue, p, q)] == pytest.approx(N.transfer_entropy(x1, x2), abs=2e-6)
        assert out[(venue, q, p)] == pytest.approx(N.transfer_entropy(x2, x1), abs=2e-6)


def test_correlation_keeps_venues_apart(long_series):
    rows, values = long_series
    out = {(r.connector, r.pair1, r.pair2): (r.points, r.correlation) for r in Q.pair_correlations(values, "close", slice_rows=300).collect()}
    for key in PAIRS:
        x1, x2 = joined(rows, *key)
        assert out[key][0] == len(x1) and out[key][1] == pytest.approx(np.corrcoef(x1, x2)[0, 1])


def test_pairs_of_two_venues_are_accepted_separately(spark):
    rows = [(v, b, q, 0.01) for v in "xy" for b, q in (("A", "B"), ("B", "A"))] + [("y", "A", "C", 0.01), ("y", "C", "A", 0.2)]
    out = Sc.accepted_pairs(spark.createDataFrame(rows, "connector string, base string, quote string, p_value double")).collect()
    assert {(r.connector, r.pair1, r.pair2) for r in out} == {("x", "A", "B"), ("y", "A", "B")}


def test_all_winners_and_losers(spark):
    rows = [(i, float(i - 30)) for i in range(80)]
    out = Po.winners_and_losers(spark.createDataFrame(rows, "controller_id long, global_pnl_quote double")).collect()
    for side, want in (("winner", list(range(79, 30, -1))), ("loser", list(range(30)))):
        assert [r.controller_id for r in sorted((r for r in out if r.outcome == side), key=lambda r: r["rank"])] == want


def test_top_rows_of_a_hot_key(spark):
    d = spark.range(5000).select((F.col("id") % 2).alias("k"), "id")
    for n in (3, 1500):
        out = Sc.top_per_group(d, ["k"], [F.desc("id")], n).collect()
        assert sorted((r.k, r["rank"], r.id) for r in out) == [(k, i + 1, 4998 + k - 2 * i) for k in (0, 1) for i in range(n)]
