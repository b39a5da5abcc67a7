"""Pair statistics of many symbols: whole results, and nothing per pair is shuffled or stored on the way."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import pairs as Q
from tickloom.session import ensure_checkpoint_dir


def folder_bytes(spark):
    ensure_checkpoint_dir(spark)
    root = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(root) for f in files)


def daily(spark, symbols, days, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(symbols, days)) + rng.normal(size=days) * 0.7 + 5
    here = rng.random((symbols, days)) < 0.8
    rows = [(v, f"S{i}", d, float(x[i, d])) for v in (None, "x") for i in range(symbols) for d in range(days) if here[i, d]]
    frame = spark.createDataFrame(rows, "connector string, trading_pair string, d int, close double")
    return x, here, frame.select("connector", "trading_pair", F.timestamp_seconds(F.col("d") * 86400).alias("ts"), "close")


@pytest.mark.parametrize("per_block, whole", [(1, True), (64, False)])
def test_correlations_of_many_blocks_and_slices(spark, per_block, whole):
    x, here, values = daily(spark, 40, 130)
    got = Q.pair_correlations(values, "close", 50, slice_rows=1200, per_block=per_block)  # 6-hour slices: about 27 here
    if whole:  # enough blocks to keep a cluster busy: the sums of a pair are ready where they are made
        exchanges = [line for line in got._jdf.queryExecution().toString().splitlines() if "Exchange" in line]
        assert exchanges and not any("pair1" in line for line in exchanges)
    out = {(r.connector, r.pair1, r.pair2): (r.points, r.correlation) for r in got.collect()}
    want = {}
    for i in range(40):
        for j in range(40):
            if f"S{i}" < f"S{j}":
                both = here[i] & here[j]
                for v in (None, "x"):
                    want[v, f"S{i}", f"S{j}"] = both.sum(), np.corrcoef(x[i, both], x[j, both])[0, 1]
    want = {k: v for k, v in want.items() if v[0] >= 50}
    assert set(out) == set(want)
    assert all(out[k][0] == n and out[k][1] == pytest.approx(c, abs=1e-9) for k, (n, c) in want.items())


def test_blocks_grow_so_that_a_series_is_copied_few_times(spark):
    _, _, values = daily(spark, 120, 3)
    got = Q.pair_correlations(values, "close", 2, per_block=1)
    copies = got._jdf.queryExecution().toString().count("sequence(0, 15")
    assert copies >= 1 and got.count() > 2 * 100


def test_far_pairs_are_not_stored_by_clusters(spark):
    n = 500
    ids = spark.range(n)
    pairs = ids.select(F.concat(F.lit("S"), "id").alias("pair1"), F.col("id").alias("i")).join(
        ids.select(F.concat(F.lit("S"), "id").alias("pair2"), F.col("id").alias("j")), F.col("i") < F.col("j"))
    # chains of four: 0-1-2-3, 4-5-6-7, ...; the rest is far apart or without a distance
    near = (F.col("j") == F.col("i") + 1) & (F.col("j") % 4 != 0)
    edges = pairs.select(F.lit("x").alias("connector"), "pair1", "pair2", F.when(near, 0.1).when(F.col("i") % 2 == 0, 0.9).alias("distance"))
    before = folder_bytes(spark)
    out = {r.trading_pair: r.label for r in Q.clusters_at(edges, 0.75).collect()}
    assert out == {f"S{i}": min(f"S{k}" for k in range(i - i % 4, i - i % 4 + 4)) for i in range(n)}
    assert folder_bytes(spark) - before < 2_000_000  # 124,750 pairs take more


def test_funding_pairs_in_both_orders_are_made_once(spark):
    from tickloom.catalog.joins import j02

    rows = [(v, f"S{i}", (i * 7 % 11) / 10 + (v == "b") * (i % 3)) for v in ("a", "b") for i in range(9)]
    rows += [("a", "S1", 0.35), (None, "S2", 0.1), ("a", None, 0.2), ("b", "S9", None)]
    out = j02(lambda _: spark.createDataFrame(rows, "connector string, trading_pair string, rate double"))
    exchanges = [line for line in out._jdf.queryExecution().toString().splitlines() if "Exchange" in line]
    assert exchanges and not any("pair1" in line for line in exchanges)
    d = [(p, q, None if x is None or y is None else x - y) for v, p, x in rows for w, q, y in rows if v and v == w and p and q and p < q]
    want = [(p, q, None if c is None else round(abs(c), 9), None if f is None else round(f, 9)) for p, q, c in d for r, s, f in d if (p, q) == (r, s)]
    got = [(r.pair1, r.pair2, *(None if x is None else round(x, 9) for x in (r.coint_value, r.rate_difference))) for r in out.collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) > 2 * 36


def test_correlations_take_every_market(spark):
    """Markets of little volume are paired like the others, in the query and in its statement."""
    import duckdb

    from tickloom.catalog.pairs import qj
    from tickloom.catalog.registry import all_queries

    rng = np.random.default_rng(8)
    close = rng.random((8, 70)) + 10
    rows = [("x", f"S{i}", d, float(close[i, d]), 10.0 ** i) for i in range(8) for d in range(70)]
    frame = spark.createDataFrame(rows, "connector string, trading_pair string, d int, close double, quote_asset_volume double")
    bars = frame.select("connector", "trading_pair", F.timestamp_seconds(F.col("d") * 86400).alias("ts"), "close", "quote_asset_volume")
    got = {(r.pair1, r.pair2): (r.points, r.correlation) for r in qj(lambda _: bars).collect()}
    ret = close[:, 1:] / close[:, :-1] - 1
    assert set(got) == {(f"S{i}", f"S{j}") for i in range(8) for j in range(i + 1, 8)}
    for (a, b), (n, c) in got.items():
        assert n == 69 and c == pytest.approx(np.corrcoef(ret[int(a[1])], ret[int(b[1])])[0, 1], abs=1e-9)

    # the same markets as line items of one supplier each
    con = duckdb.connect()
    con.execute("""CREATE VIEW lineitem AS SELECT i AS l_suppkey, DATE '2020-01-01' + d::INT AS l_shipdate, i * 100 + d AS l_orderkey, 1 AS l_linenumber, 1 AS l_partkey,
        10.0 ** i AS l_quantity, (10 + (hash(i * 1000 + d) % 1000)::DOUBLE / 1000) * 10.0 ** i AS l_extendedprice, 0.0 AS l_discount, 0.0 AS l_tax, 'O' AS l_linestatus
        FROM range(8) a(i), range(70) b(d)""")
    assert con.execute(f"SELECT count(*) FROM ({all_queries()['qj_correlation'].sql})").fetchone() == (28,)


def test_blocks_of_many_values_meet_where_they_are_read(spark, monkeypatch):
    """The same correlations as from copies, several slices a block, with venues, and nothing copied in a shuffle."""
    x, here, values = daily(spark, 40, 130)
    copied = {(r.connector, r.pair1, r.pair2): (r.points, r.correlation) for r in Q.pair_correlations(values, "close", 50, slice_rows=1200, per_block=1).collect()}
    monkeypatch.setattr(Q, "COPIES", 0, raising=False)
    got = Q.pair_correlations(values, "close", 50, slice_rows=1200, per_block=1)
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan and "Generate" not in plan
    out = {(r.connector, r.pair1, r.pair2): (r.points, r.correlation) for r in got.collect()}
    assert set(out) == set(copied) and len(out) > 1000 and {v for v, _, _ in out} == {None, "x"}
    assert all(out[k] == (n, pytest.approx(c, abs=1e-12)) for k, (n, c) in copied.items())
    # far pairs may be left out, their symbols not
    near = {(r.connector, r.pair1, r.pair2) for r in Q.pair_correlations(values, "close", 50, slice_rows=1200, per_block=1, within=0.4).collect()}
    assert near == {k for k, (_, c) in copied.items() if 1 - c < 0.4} | {(v, a, a) for v, *pair in copied for a in pair}


def test_constant_series_and_lone_symbols_in_place(spark, monkeypatch):
    rows = [("x", s, d, v) for d in range(60) for s, v in (("A", 1.0), ("B", float(d)), ("C", float(-d)), ("D", float(d * d)))]
    rows += [("x", "E", d, float(d)) for d in range(10)] + [("x", None, 1, 2.0), ("y", "A", 1, 2.0), ("x", "A", None, 2.0), ("x", "A", 1, None)]
    frame = spark.createDataFrame([(v, s, d, c) for v, s, d, c in rows], "connector string, trading_pair string, d int, close double")
    values = frame.select("connector", "trading_pair", F.timestamp_seconds(F.col("d") * 86400).alias("ts"), "close")
    want = {(r.pair1, r.pair2): (r.points, r.correlation and round(r.correlation, 9)) for r in Q.pair_correlations(values, "close", 20).collect()}
    monkeypatch.setattr(Q, "COPIES", 0, raising=False)
    got = {(r.pair1, r.pair2): (r.points, r.correlation and round(r.correlation, 9)) for r in Q.pair_correlations(values, "close", 20).collect()}
    assert got == want and got["A", "B"] == (60, None) and got["B", "C"] == (60, -1.0) and len(got) == 6
    assert Q.pair_correlations(values.limit(0), "close", 20).collect() == []
    clusters = lambda within: sorted(Q.clusters_at(
        Q.pair_correlations(values, "close", 20, within=within).select("connector", "pair1", "pair2", (1 - F.col("correlation")).alias("distance")), 0.75).collect())
    assert clusters(0.75) == clusters(None) == [("x", "A", "A"), ("x", "B", "B"), ("x", "C", "C"), ("x", "D", "B")]


def test_tasks_send_on_a_star_per_component(spark):
    """All 4,950 pairs of 100 symbols are near; what is kept of them follows the symbols."""
    names = [f"S{i:03d}" for i in range(100)]
    edges = spark.createDataFrame([(v, a, b, 0.1) for v in ("x", None) for a in names for b in names if a < b], "connector string, pair1 string, pair2 string, distance double").coalesce(1)
    before = folder_bytes(spark)
    out = {(r.connector, r.trading_pair): r.label for r in Q.clusters_at(edges, 0.75).collect()}
    assert {k: v for k, v in out.items() if k[0]} == {("x", n): "S000" for n in names} and len(out) == 200
    assert folder_bytes(spark) - before < 150_000
