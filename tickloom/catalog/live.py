"""ST*: the stream transforms, driven to completion over the given tables and compared with batch SQL.

Streams read the tables as files, write to Parquet in the checkpoint folder, and the result is the
written table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from tickloom.catalog import oracle as O
from tickloom.catalog.ingest import as_of, bars_sql
from tickloom.catalog.registry import query
from tickloom.operators.layout import SERIES
from tickloom.plans.features import LearningSet
from tickloom.plans.learning import train_forest
from tickloom.session import ensure_checkpoint_dir
from tickloom.sources.fixtures import ORDERS_AS_OF
from tickloom.streaming import live as L


def work_folder(spark) -> str:
    """A fresh folder next to the checkpoints (shared storage on a cluster)."""
    ensure_checkpoint_dir(spark)
    base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{base}/stream-{uuid.uuid4().hex}"


def as_stream(df: DataFrame, folder: str) -> DataFrame:
    """The view as a file stream of 12 files, read back four at a time: three batches carry state over."""
    df.repartition(12).write.parquet(folder)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 4).parquet(folder)


def as_ordered_stream(df: DataFrame, folder: str, parts: int = 3) -> DataFrame:
    """The view as a file stream whose batches follow each other in time: one write per time range."""
    cuts = df.select(F.percentile_approx("ts", [i / parts for i in range(1, parts)])).first()[0] or []
    part = sum((F.when(F.col("ts") > F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0))
    for i in range(parts):
        df.filter(part == i).repartition(4).write.mode("append").parquet(folder)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 4).parquet(folder)


def finish(stream: DataFrame, folder: str) -> DataFrame:
    q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(
        availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def trade_stream(view, folder: str, duplicated: bool = False) -> DataFrame:
    t = view("trades")
    if duplicated:
        t = t.unionByName(t.filter(F.col("id") % 3 == 0))
    return as_ordered_stream(t, f"{folder}/trades")


@query("st1_live_bars", "trading_pair ts open close high:4 volume:4 n_trades:i", "trades",
       ctes={"b": bars_sql("date_trunc('hour', ts)")},
       sql="SELECT * FROM b WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM trades)")
def st1(view):
    f = work_folder(view("trades").sparkSession)
    return finish(L.live_bars(trade_stream(view, f), dedupe=False), f)


@query("st2_dedupe", "id:i trading_pair price:4", "trades", sql="SELECT * FROM trades")
def st2(view):
    f = work_folder(view("trades").sparkSession)
    return finish(L.unique_trades(trade_stream(view, f, True), "40 days").drop("ts"), f)


@query("st3_live_emas", "connector trading_pair ts ema_8:6 ema_29:6", "bars_1h", ctes={"nb": O.numbered(), **O.ema("ema_8", 8), **O.ema("ema_29", 29)},
       sql=O.joined("nb", "ema_8", "ema_29"))
def st3(view):
    bars = view("bars_1h")
    f = work_folder(bars.sparkSession)
    return finish(L.live_emas(as_ordered_stream(bars.select("connector", "trading_pair", "ts", "close"), f"{f}/bars"), (8, 29)), f)


@query("st4_live_stops", "controller_id:i stop_reason", "bot_performance",
       sql="""SELECT * FROM (SELECT *, CASE WHEN global_pnl_pct / 100 >= 5e-2 THEN 'take_profit' WHEN global_pnl_pct / 100 <= -8e-2 THEN 'stop_loss' END AS stop_reason
FROM bot_performance) WHERE stop_reason IS NOT NULL""")
def st4(view):
    perf = view("bot_performance")
    f = work_folder(perf.sparkSession)
    updates = as_stream(perf.select("controller_id", "bot_name", "global_pnl_pct"), f"{f}/updates")
    started = perf.select("controller_id", "started_at")
    return finish(L.live_stops(updates, started, as_of(ORDERS_AS_OF), max_drawdown=0.08, max_profit=0.05), f)


@query("st5_refresh_lake", "trading_pair ts close:4 n_trades:i", "bars_1h", sql="SELECT * FROM bars_1h")
def st5(view):
    bars = view("bars_1h").drop("_pos")
    spark = bars.sparkSession
    f = work_folder(spark)
    stream = as_stream(bars.unionByName(bars.filter(F.hour("ts") % 2 == 0)), f"{f}/bars")
    L.refresh_lake(stream, f"{f}/lake", f"{f}/state").awaitTermination()
    return spark.read.parquet(f"{f}/lake")


@query("m06_online_scores", "connector trading_pair ts target_pct:6", "bars_1h", ctes={
    "s": """SELECT *, CASE WHEN count(close) OVER w = 200 THEN stddev_samp(close) OVER w / close END AS target FROM bars_1h
WINDOW w AS (PARTITION BY connector, trading_pair ORDER BY ts ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)""",
    "m": """SELECT *, CASE WHEN count(target) OVER w = 100 THEN avg(target) OVER w END AS target_pct FROM s
WINDOW w AS (PARTITION BY connector, trading_pair ORDER BY ts ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)"""},
       sql="SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY connector, trading_pair ORDER BY ts DESC) = 1")
def m06(view):
    """Batches of bars are scored with a model fitted on the bars before; each message holds the class chances and
    the mean target, and the newest message per market is the result."""
    bars = view("bars_1h").drop("_pos")
    f = work_folder(bars.sparkSession)
    d = LearningSet().calculate(bars).na.drop(subset=LearningSet.columns())
    d = d.withColumn("label", F.signum(F.round(F.col("close_ret"), 1)).cast("int"))
    model = train_forest(d.select(*SERIES, "ts", "label", *LearningSet.columns()), LearningSet.columns(), trees=50)
    stream = as_stream(bars, f"{f}/bars")
    L.live_scores(stream, model, lambda: bars, lambda df: df.write.mode("append").parquet(f"{f}/messages"), f"{f}/state").awaitTermination()
    messages = bars.sparkSession.read.schema("key string, value string").parquet(f"{f}/messages").distinct()
    body = F.from_json("value", "trading_pair string, ts string, probabilities array<double>, target_pct double")
    out = messages.select(body.alias("m")).select("m.*").filter(F.abs(F.aggregate("probabilities", F.lit(0.0), lambda a, x: a + x) - 1) < 1e-9)
    return out.select(F.lit("sim").alias("connector"), "trading_pair", F.col("ts").cast("timestamp_ntz").alias("ts"), "target_pct")
