"""Structured Streaming versions (ST1-ST5, M06). The batch transforms are reused where state allows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickloom.functions.columns import interval_seconds, ratio
from tickloom.operators.ingest import bar_aggregates, merge_bars
from tickloom.operators.joins import latest_rows
from tickloom.operators.layout import SERIES, own_rows, segmented
from tickloom.plans.features import LearningSet
from tickloom.plans.learning import prediction_messages, score
from tickloom.plans.portfolio import pnl_stops


def event_time(trades: DataFrame, late: str) -> DataFrame:
    """Watermarks need TIMESTAMP; naive times are taken as UTC."""
    return trades.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def unique_trades(trades: DataFrame, late: str = "10 minutes") -> DataFrame:
    """ST2: one row per trade id while the watermark keeps it in state."""
    return event_time(trades, late).dropDuplicatesWithinWatermark([*SERIES, "id"])


def live_bars(trades: DataFrame, interval: str = "1h", late: str = "10 minutes", dedupe: bool = True) -> DataFrame:
    """ST1: closed bars in append mode; a bar is emitted once the watermark passes its end."""
    t = unique_trades(trades, late) if dedupe else event_time(trades, late)
    window = F.window("ts", f"{interval_seconds(interval)} seconds", startTime="4 days" if interval == "1w" else "0 seconds")
    bars = t.groupBy(*SERIES, window.alias("_w")).agg(*bar_aggregates())
    return bars.select(*SERIES, F.col("_w.start").cast("timestamp_ntz").alias("ts"), *[c for c in bars.columns if c not in (*SERIES, "_w")])


def live_emas(bars: DataFrame, lengths: tuple[int, ...] = (8, 29, 31)) -> DataFrame:
    """ST3: EMA state per series instead of recomputing the last bars: a running seed sum, then the
    recursion. State is a number per length and the newest time, whatever the history. Bars must come in
    time order between batches: one that is not newer than the series' last is late, leaves the state as it
    is and is returned with NULL averages."""
    schema = "connector string, trading_pair string, ts timestamp_ntz, close double, " + ", ".join(f"ema_{n} double" for n in lengths)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, values, newest = (state.get[0], list(state.get[1]), state.get[2]) if state.exists else (0, [0.0] * len(lengths), None)
        rows = pd.concat(list(batches)).sort_values("ts", ignore_index=True)
        out = {n: [] for n in lengths}
        micros = rows["ts"].astype("datetime64[us]").astype("int64")
        for at, close in zip(micros.tolist(), rows["close"].tolist()):
            if newest is not None and at <= newest:
                for n in lengths:
                    out[n].append(None)
                continue
            newest = at
            seen += 1
            for j, n in enumerate(lengths):
                if seen <= n:
                    values[j] += close / n          # seed: mean of the first n
                else:
                    values[j] += 2 / (n + 1) * (close - values[j])
                out[n].append(values[j] if seen >= n else None)
        state.update((seen, values, newest))
        rows = rows[["ts", "close"]].assign(connector=key[0], trading_pair=key[1], **{f"ema_{n}": pd.Series(v, index=rows.index, dtype=float) for n, v in out.items()})
        yield rows[["connector", "trading_pair", "ts", "close", *[f"ema_{n}" for n in lengths]]]

    return bars.select(*SERIES, "ts", "close").groupBy(*SERIES).applyInPandasWithState(
        step, schema, "seen long, values array<double>, newest long", "append", GroupStateTimeout.NoTimeout)


def live_stops(updates: DataFrame, started: DataFrame, as_of, **limits) -> DataFrame:
    """ST4: stop rule on a stream of performance updates, joined with static start times."""
    return pnl_stops(updates.join(started, "controller_id"), as_of, **limits)


def refresh_lake(bars_stream: DataFrame, folder: str, checkpoint: str, version: str | None = None):
    """ST5: process what is new, then stop. Only the days of the venues that a batch touches are read, merged by key
    and replaced (dynamic partition overwrite), so the cost follows the batch, not the lake. A
    repeated batch merges to the same rows."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.withColumn("day", F.to_date("ts"))
        held = fresh.limit(0)
        if path_exists(spark, folder):
            held = spark.read.parquet(folder).join(fresh.select("connector", "day").distinct(), ["connector", "day"], "left_semi").select(*fresh.columns)
        # the first batch is merged as well: it may hold a bar twice
        merged = merge_bars(held, fresh, mode="key", keys=(*SERIES, "ts", "day"), version=version)
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("connector", "day").parquet(folder)

    return bars_stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def path_exists(spark, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def with_target(bars: DataFrame, spread: int = 200, mean: int = 100) -> DataFrame:
    """``target_pct``: mean over ``mean`` bars of the close's sample deviation over ``spread`` bars, relative to the close."""
    d, p = segmented(bars, spread + mean)
    full = F.count("close").over(p.last(spread)) == spread
    d = d.withColumn("_target", F.when(full, ratio(F.stddev_samp("close").over(p.last(spread)), "close")))
    held = F.count("_target").over(p.last(mean)) == mean
    return own_rows(d.withColumn("target_pct", F.when(held, F.avg("_target").over(p.last(mean))))).drop("_target")


def live_scores(bars_stream: DataFrame, model: PipelineModel, history, sink, checkpoint: str):
    """Each batch scores the newest bar per series on features over ``history()`` (a table that
    contains the batch, bounded to the look-back) and hands messages to ``sink(df)``."""

    def step(batch: DataFrame, batch_id: int) -> None:
        touched = batch.select(*SERIES).distinct()
        bars = history().join(touched, [*SERIES], "left_semi")
        scored = score(model, latest_rows(with_target(LearningSet().calculate(bars))).na.drop(subset=LearningSet.columns()))
        sink(prediction_messages(scored))

    return bars_stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
