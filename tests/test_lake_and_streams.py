"""Lake tables written and read back, pruning, streamed state over several batches, user functions on pieces."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import user as U
from tickloom.operators.ingest import merge_bars
from tickloom.session import ensure_checkpoint_dir
from tickloom.sources import lake as L
from tickloom.streaming import live

START = dt.datetime(2024, 3, 1)
SCHEMA = ("connector string, trading_pair string, interval string, ts timestamp_ntz, open double, high double, low double, close double, "
          "volume double, n_trades long")


def bar(venue, pair, i, close):
    return (venue, pair, "1h", START + dt.timedelta(hours=i), close, close + 1, close - 1, close, 1.0, 1)


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame([bar(v, p, i, float(i % 7)) for v in "xy" for p in ("A", "B") for i in range(100)], SCHEMA)


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))


def test_bars_round_trip_with_pruning(spark, bars, tmp_path):
    L.write_bars(bars, f"{tmp_path}/bars")
    same(bars, L.read_bars(spark, f"{tmp_path}/bars"))
    one = L.read_bars(spark, f"{tmp_path}/bars", "x", "A", "1h")
    same(bars.filter("connector = 'x' and trading_pair = 'A'"), one)
    text = plan(one)
    assert "PartitionFilters: [isnotnull(connector" in text and "EqualTo(trading_pair,A)" in text


def test_bar_files_are_picked_by_name(spark, bars, tmp_path):
    for v, p in (("x", "A"), ("x", "B"), ("y", "A")):
        part = bars.filter((F.col("connector") == v) & (F.col("trading_pair") == p)).drop("connector", "trading_pair", "interval")
        part.coalesce(1).toPandas().to_parquet(f"{tmp_path}/{v}|{p}|1h.parquet", index=False, coerce_timestamps="us")
    got = L.read_bar_files(spark, str(tmp_path), connector="x", pair="B")
    assert got.count() == 100 and {(r.connector, r.trading_pair, r.interval) for r in got.collect()} == {("x", "B", "1h")}


def test_daily_tables_round_trip_and_have_many_writers(spark, bars, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # few rows would go to one task
    try:
        L.write_daily(bars, f"{tmp_path}/trades")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = L.read_daily(spark, f"{tmp_path}/trades", "2024-03-02", "2024-03-03")
    assert got.count() == 4 * 48 and "PartitionFilters: [isnotnull(day" in plan(got)
    assert len(list((tmp_path / "trades" / "connector=x" / "day=2024-03-02").glob("part-*"))) > 1
    features = bars.select("ts", F.lit("f").alias("feature_name"), "trading_pair", F.col("close").alias("value"))
    L.write_features(features, f"{tmp_path}/features")
    same(features, L.read_daily(spark, f"{tmp_path}/features"))
    L.write_learning_set(bars, f"{tmp_path}/learn")
    L.write_learning_set(bars, f"{tmp_path}/learn")  # replaces
    same(bars, L.read_daily(spark, f"{tmp_path}/learn"))


def test_newest_version_wins_within_a_batch(spark):
    rows = [("x", "A", START, 9.0, 1), ("x", "A", START, 2.0, 3), ("x", "A", START, 5.0, 2)]
    fresh = spark.createDataFrame(rows, "connector string, trading_pair string, ts timestamp_ntz, open double, version int")
    assert [r.open for r in merge_bars(fresh.limit(0), fresh, version="version").collect()] == [2.0]


def stream_of(spark, parts, folder):
    for p in parts:
        p.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_first_batch_of_the_lake_is_merged(spark, bars, tmp_path):
    ten = bars.filter("connector = 'x' and trading_pair = 'A'").limit(10)
    twice = ten.unionByName(ten)
    other = ten.withColumn("connector", F.lit("y"))
    live.refresh_lake(stream_of(spark, [twice, other, ten], f"{tmp_path}/in"), f"{tmp_path}/lake", f"{tmp_path}/state").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/lake")
    assert got.count() == 20 and got.select("connector", "ts").distinct().count() == 20


def test_late_bars_leave_the_average_alone(spark, tmp_path):
    rows = [("x", "A", START + dt.timedelta(hours=i), float(i)) for i in range(30)]
    make = lambda r: spark.createDataFrame(r, "connector string, trading_pair string, ts timestamp_ntz, close double")
    stream = stream_of(spark, [make(rows[:10]), make(rows[10:20]), make([("x", "A", START, 999.0)]), make(rows[20:])], f"{tmp_path}/in")
    emas = live.live_emas(stream, (3,))
    emas.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(
        availableNow=True).start().awaitTermination()
    got = {r.ts: r.ema_3 for r in spark.read.schema(emas.schema).parquet(f"{tmp_path}/out").filter("close < 900").collect()}
    want, value = {}, 0.0
    for i, (_, _, ts, c) in enumerate(rows):
        value = value + c / 3 if i < 3 else value + (c - value) / 2
        want[ts] = value if i >= 2 else None
    assert got == {k: pytest.approx(v) if v is not None else None for k, v in want.items()}


def test_user_functions_do_not_depend_on_pieces(spark, monkeypatch):
    monkeypatch.setattr("tickloom.operators.layout.SEGMENT_ROWS", 40)
    x = np.random.default_rng(1).normal(size=300)
    d = spark.createDataFrame([("x", "A", START + dt.timedelta(hours=i), float(v)) for i, v in enumerate(x)],
                              "connector string, trading_pair string, ts timestamp_ntz, close double")
    out = U.rolling_apply(d, "close", 15, lambda w: w.max(axis=1), "top").orderBy("ts").collect()
    assert [r.top for r in out[:14]] == [None] * 14 and [r.top for r in out[14:]] == [x[i - 14:i + 1].max() for i in range(14, 300)]
    rows = U.table_apply(d, lambda p: p[p["_own"]][["close"]].iloc[::1], "close double", halo=3, ahead=2).collect()
    assert sorted(r.close for r in rows) == sorted(x.tolist())
    assert d.select(U.row_apply(["close"], lambda c: c * 2).alias("v")).agg(F.sum("v")).first()[0] == pytest.approx(2 * x.sum())


def test_a_cluster_needs_a_shared_checkpoint_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": lambda self, k, d=None: d})()

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())
