"""Trades to bars, alignment and merging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions.columns import bucket, epoch_micros, interval_seconds
from tickloom.operators.layout import BAR_SECONDS, SERIES, join_series, mark_bars, own_rows, prefix_scan, renumber, segmented
from tickloom.operators.rolling import shift

GRID_SLICE = 4096


def bar_aggregates() -> list[Column]:
    """OHLC, volume and taker columns of one bucket of trades; ties on ts are split by id."""
    at = F.struct("ts", "id")
    bought = ~F.col("sell_taker")
    quote = F.col("price") * F.col("volume")
    return [
        F.min_by("price", at).alias("open"), F.max("price").alias("high"),
        F.min("price").alias("low"), F.max_by("price", at).alias("close"),
        F.sum("volume").alias("volume"), F.sum(quote).alias("quote_asset_volume"),
        F.count(F.lit(1)).alias("n_trades"),
        F.sum(F.when(bought, F.col("volume")).otherwise(0.0)).alias("taker_buy_base_volume"),
        F.sum(F.when(bought, quote).otherwise(0.0)).alias("taker_buy_quote_volume"),
    ]


def trades_to_bars(trades: DataFrame, interval: str) -> DataFrame:
    """Bars of the buckets that hold trades (T02); every aggregate combines map-side, so a hot
    symbol is reduced before the shuffle."""
    return trades.groupBy(*SERIES, bucket("ts", interval).alias("bar")).agg(*bar_aggregates()).select(
        *SERIES, F.col("bar").alias("ts", metadata={BAR_SECONDS: interval_seconds(interval)}), "open", "high", "low", "close", "volume",
        "quote_asset_volume", "n_trades", "taker_buy_base_volume", "taker_buy_quote_volume",
    )


def fill_forward(df: DataFrame, columns: list[str], **kw) -> DataFrame:
    """Last known value of each column."""
    order = df.columns
    out = prefix_scan(df, {f"_f_{c}": ("last", c) for c in columns}, **kw)
    return out.select(*[F.col(f"_f_{c}").alias(c) if c in columns else F.col(c) for c in order])


def resample_ohlcv(trades: DataFrame, interval: str) -> DataFrame:
    """Bars on the dense grid; an empty bucket has volume 0 and each price column carries its
    own previous value (open from open, close from close).

    Every bar fills the gap before it, from the values and the time one scan brings it; a long gap is
    cut in slices first, so no row holds all of it. A bar without a time stays as it is.
    """
    step, prices = interval_seconds(interval), ["open", "high", "low", "close"]
    bars = trades_to_bars(trades, interval).select(*SERIES, "ts", *prices, "volume")
    d = prefix_scan(bars, {"_at": ("last", "ts")} | {f"_f_{c}": ("last", c) for c in prices}, inclusive=False)
    gap = ((epoch_micros("ts") - epoch_micros("_at")) / (step * 1_000_000)).cast("bigint")
    d = d.withColumn("_gap", F.coalesce(gap, F.lit(1)))
    d = d.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.floor((F.col("_gap") - 1) / GRID_SLICE))))
    first = F.col("_slice") * GRID_SLICE
    d = d.withColumn("_k", F.explode(F.sequence(first, F.least(F.col("_gap") - 1, first + GRID_SLICE - 1))))
    own = F.col("_k") == 0
    back = F.make_dt_interval(secs=(F.col("_k") * step).cast("double"))
    dense = d.select(*SERIES, (F.col("ts") - back).alias("ts"),
                     *[F.when(own, F.coalesce(c, f"_f_{c}")).otherwise(F.col(f"_f_{c}")).alias(c) for c in prices],
                     F.when(own, F.coalesce("volume", F.lit(0.0))).otherwise(0.0).alias("volume"))
    return mark_bars(dense, step)


def coarser_bars(bars: DataFrame, interval: str) -> DataFrame:
    """Roll bars up to a longer interval."""
    rolled = bars.groupBy(*SERIES, bucket("ts", interval).alias("bar")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"),
        F.min("low").alias("low"), F.max_by("close", "ts").alias("close"),
        F.sum("volume").alias("volume"), F.sum("quote_asset_volume").alias("quote_asset_volume"),
        F.sum("n_trades").alias("n_trades"),
        F.sum("taker_buy_base_volume").alias("taker_buy_base_volume"),
        F.sum("taker_buy_quote_volume").alias("taker_buy_quote_volume"),
    ).withColumnRenamed("bar", "ts")
    return mark_bars(rolled, interval_seconds(interval))


def multi_interval_bars(trades: DataFrame, intervals: list[str]) -> DataFrame:
    """One pass over the trades at the shortest interval, longer ones rolled up from it where
    they are multiples of it."""
    by_length = sorted(intervals, key=interval_seconds)
    base = trades_to_bars(trades, by_length[0])
    step = interval_seconds(by_length[0])
    parts = [
        (base if iv == by_length[0] else coarser_bars(base, iv)
         if interval_seconds(iv) % step == 0 else trades_to_bars(trades, iv))
        .withColumn("interval", F.lit(iv))
        for iv in by_length
    ]
    return reduce(DataFrame.unionByName, parts)


def daily_volume(bars: DataFrame) -> DataFrame:
    """Daily OHLCV with buy and sell volume."""
    day = coarser_bars(bars, "1d")
    return day.withColumn("buy_volume", F.col("taker_buy_base_volume")).withColumn(
        "sell_volume", F.col("volume") - F.col("taker_buy_base_volume"))


def between(df: DataFrame, start, end, ts: str = "ts") -> DataFrame:
    """Both ends inclusive."""
    return renumber(df.filter(F.col(ts).between(start, end)))


def recent(df: DataFrame, as_of, days: float, ts: str = "ts") -> DataFrame:
    """Rows of the last ``days`` days before ``as_of``."""
    return renumber(df).filter(F.col(ts) >= as_of - F.make_dt_interval(secs=F.lit(days * 86400.0)))


def missing_ranges(requests: DataFrame, bars: DataFrame) -> DataFrame:
    """What of each request [start, end] is not covered by [first, last] cached bar.

    One row per gap: ``side`` is all, left or right. Only one row per series reaches the join.
    """
    one = F.make_dt_interval(secs=F.lit(1.0))
    have = bars.groupBy(*SERIES).agg(F.min("ts").alias("_lo"), F.max("ts").alias("_hi"))
    r = join_series(requests, have, how="left")
    gap = lambda side, a, b: F.struct(F.lit(side).alias("side"), a.alias("gap_start"), b.alias("gap_end"))
    start, end, lo, hi = (F.col(c) for c in ("start", "end", "_lo", "_hi"))
    gaps = F.array(
        F.when(lo.isNull(), gap("all", start, end)),
        F.when(start < lo, gap("left", start, F.least(lo - one, end))),
        F.when(end > hi, gap("right", F.greatest(hi + one, start), end)),
    )
    out = r.withColumn("_g", F.explode(F.filter(gaps, lambda g: g.isNotNull())))
    return out.select(*requests.columns, "_g.*")


def interior_gaps(bars: DataFrame, interval: str) -> DataFrame:
    """Holes between consecutive bars that are further apart than the interval."""
    step = interval_seconds(interval)
    df, p = segmented(bars.select(*SERIES, "ts"), 1)
    df = renumber(own_rows(df.withColumn("prev_ts", shift("ts", 1, p))))
    apart = epoch_micros("ts") - epoch_micros("prev_ts")
    return df.filter(apart > step * 1_000_000).withColumn(
        "missing_bars", (apart / (step * 1_000_000)).cast("bigint") - 1)


def merge_bars(cached: DataFrame, fresh: DataFrame, mode: str = "key",
               keys: tuple[str, ...] = (*SERIES, "ts"), version: str | None = None) -> DataFrame:
    """``row`` drops exact duplicate rows (a revised bar keeps both versions); ``key`` keeps the
    newest version per key: fresh before cached, then the highest ``version`` (an arrival time or number).
    Without one, revisions within a batch have no order, and the largest values win, so that a rerun
    gives the same rows. Both combine map-side."""
    if mode == "row":
        return cached.unionByName(fresh).dropDuplicates()
    if mode != "key":
        raise ValueError(f"unknown merge mode {mode!r}")
    rest = [c for c in cached.columns if c not in keys]
    both = cached.withColumn("_batch", F.lit(0)).unionByName(fresh.withColumn("_batch", F.lit(1)))
    newest = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("_batch", *([version] if version else []), *rest)).alias("_v"))
    return newest.select(*keys, "_v.*").select(*cached.columns)
