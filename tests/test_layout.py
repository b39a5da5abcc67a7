"""The segmented layout gives the same answers as one pass over the series, whatever the piece size."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tickloom.functions import kernels as N
from tickloom.operators import peaks as P
from tickloom.operators import recursive as C
from tickloom.operators import rolling as R
from tickloom.operators.layout import mark_bars, own_rows, prefix_scan, segmented
from tickloom.operators.quantiles import exact_quantiles


def bars(spark, n=400, seed=1, pairs=("A-B", "C-D")):
    rng = np.random.default_rng(seed)
    parts = []
    for p in pairs:
        close = 100 + rng.normal(0, 1, n).cumsum()
        parts.append(pd.DataFrame({
            "connector": "x", "trading_pair": p, "ts": pd.date_range("2024-01-01", periods=n, freq="h"), "open": close, "close": close,
            "high": close + rng.random(n), "low": close - rng.random(n), "volume": rng.random(n), "quote_asset_volume": rng.random(n) + 1}))
    pdf = pd.concat(parts)
    df = spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return pdf, mark_bars(df, 3600)


def in_order(df, column, pair="A-B"):
    return df.filter(F.col("trading_pair") == pair).orderBy("ts").toPandas()[column].to_numpy(dtype=float)


def test_ema_same_for_small_pieces(spark):
    pdf, df = bars(spark)
    x = pdf[pdf.trading_pair == "A-B"].close.to_numpy()
    want = np.full(len(x), np.nan)
    want[7] = x[:8].mean()
    for i in range(8, len(x)):
        want[i] = 2 / 9 * x[i] + 7 / 9 * want[i - 1]
    for rows in (40, 8192):
        d, p = segmented(df, C.ema_memory(8), rows=rows)
        np.testing.assert_allclose(in_order(own_rows(C.ema(d, p, "e", "close", 8)), "e"), want, rtol=1e-11)


def test_blocks_inside_a_piece(spark, monkeypatch):
    _, df = bars(spark, 300)
    d, p = segmented(df, 0)
    whole = in_order(own_rows(C.averages(d, p, C.ema_of("a", n=3), C.ema_of("b", n=20))), "a")
    monkeypatch.setattr(C, "SAFE_EXPONENT", 60.0)
    cut = own_rows(C.averages(d, p, C.ema_of("a", n=3), C.ema_of("b", n=20)))
    np.testing.assert_allclose(in_order(cut, "a"), whole, rtol=1e-11)


def test_supersmoother_sequential(spark):
    pdf, df = bars(spark)
    x = pdf[pdf.trading_pair == "C-D"].close.to_numpy()
    c1, c2, c3 = C.supersmoother_coefficients(20)
    y = x.copy()
    for i in range(2, len(x)):
        y[i] = c1 * x[i] + c2 * y[i - 1] + c3 * y[i - 2]
    d, p = segmented(df, C.smoothing_memory("SuperSmoother", 20) + 2, rows=300)
    np.testing.assert_allclose(in_order(own_rows(C.supersmoother(d, p, "s", "close", 20)), "s", "C-D"), y, rtol=1e-10)


def test_rolling_with_halo(spark):
    pdf, df = bars(spark)
    s = pdf[pdf.trading_pair == "A-B"].close.reset_index(drop=True)
    d, p = segmented(df, 20, rows=50)
    out = own_rows(R.rolling_rank(d.withColumn("sd", R.std("close", 20, p)), p, {"rk": "close"}, 20))
    np.testing.assert_allclose(in_order(out, "sd"), s.rolling(20).std(), rtol=1e-8)
    np.testing.assert_allclose(in_order(out, "rk"), s.rolling(20).rank(pct=True))


def test_prefix_scan_small_segments(spark):
    pdf, df = bars(spark)
    x = pdf[pdf.trading_pair == "A-B"].volume.reset_index(drop=True)
    out = prefix_scan(df, {"s": ("sum", "volume"), "m": ("max", "volume"), "f": ("first", "volume"), "p": ("prev", "volume"),
                           "k": ("sum_peak", F.col("volume") - 0.5), "t": ("series_sum", "volume")}, segment_seconds=5 * 3600)
    np.testing.assert_allclose(in_order(out, "s"), x.cumsum())
    np.testing.assert_allclose(in_order(out, "m"), x.cummax())
    np.testing.assert_allclose(in_order(out, "f"), np.full(len(x), x[0]))
    np.testing.assert_allclose(in_order(out, "p"), x.shift(1))
    np.testing.assert_allclose(in_order(out, "k"), (x - 0.5).cumsum().cummax())
    np.testing.assert_allclose(in_order(out, "t"), np.full(len(x), x.sum()))


def test_exact_quantiles_with_repeats(spark):
    pdf, df = bars(spark)
    q = exact_quantiles(df.withColumn("v", F.round("volume", 1)), {"a": (F.col("v"), 0.4), "b": (F.col("close"), 0.9)}).toPandas().set_index("trading_pair")
    for pair, g in pdf.groupby("trading_pair"):
        assert abs(q.loc[pair, "a"] - g.volume.round(1).quantile(0.4)) < 1e-9
        assert abs(q.loc[pair, "b"] - g.close.quantile(0.9)) < 1e-9


def test_single_row_and_short_series(spark):
    _, df = bars(spark, 1)
    d, p = segmented(df, C.ema_memory(8))
    out = own_rows(C.ema(d.withColumn("sd", R.std("close", 5, p)), p, "e", "close", 8)).toPandas()
    assert len(out) == 2 and out["e"].isna().all() and out["sd"].isna().all()


def test_series_peaks_against_one_pass(spark, monkeypatch):
    from tickloom.operators import peaks as K
    monkeypatch.setattr(K, "ROWS", 64)
    pdf, df = bars(spark, 300, seed=3, pairs=("A-B",))
    got = K.series_peaks(df, 0.1, 7).toPandas()
    nominal = 0.1 * (pdf.high.max() - pdf.low.min())
    for kind, x in (("high", pdf.high.to_numpy()), ("low", -pdf.low.to_numpy())):
        assert sorted(got[got.kind == kind]["_pos"]) == N.find_peaks(x, nominal, 7).tolist()


def test_thin_ends_in_few_rounds_on_rising_chains(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [("x", "up", "high", float(i), 3 * i) for i in range(10_000)] + [("x", "down", "high", float(-i), 3 * i) for i in range(3000)]
    rows += [(None, "any", "high", float(v), int(p)) for p, v in zip(np.cumsum(rng.integers(1, 9, 4000)), rng.integers(0, 50, 4000))]
    d = spark.createDataFrame(rows, "connector string, trading_pair string, kind string, x double, p long")
    monkeypatch.setattr(P, "ROWS", 8000)
    got = {(r.trading_pair, r.p) for r in P.thin(d, 7).collect()}
    want = set()
    for name in ("up", "down", "any"):
        own = [(x, p) for _, n, _, x, p in rows if n == name]
        open_ = sorted(own, reverse=True)
        gone = set()
        at = {p for _, p in own}
        for _, p in open_:
            if p not in gone:
                want.add((name, p))
                gone |= {q for q in range(p - 6, p + 7) if q in at and q != p}
    assert got == want
