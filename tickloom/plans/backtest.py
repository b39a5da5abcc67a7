"""Backtest analytics and parameter sweeps."""

from __future__ import annotations

import itertools
import random
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions.columns import direction, ratio
from tickloom.operators import recursive as C
from tickloom.operators import rolling as R
from tickloom.operators.labels import first_touch
from tickloom.operators.layout import POS, SERIES, join_series, own_rows, prefix_scan, segmented

CLOSE_TYPES = {1: "TAKE_PROFIT", -1: "STOP_LOSS", 0: "TIME_LIMIT"}


def equity_curve(trades: DataFrame, keys: Sequence[str], order: Sequence[str] = ("ts_close", "trade_id"),
                 segment_seconds: int | None = None) -> DataFrame:
    """Running PnL of each run by close time, its running maximum and the drawdown."""
    d = prefix_scan(trades, {"equity": ("sum", "pnl_quote"), "peak": ("sum_peak", "pnl_quote"),
                             "total_volume": ("series_sum", "amount")}, keys, order, segment_seconds)
    return d.withColumns({"drawdown": F.col("equity") - F.col("peak"), "profitable": F.col("pnl_quote") > 0})


def backtest_summary(trades: DataFrame, keys: Sequence[str], order: Sequence[str] = ("ts_close", "trade_id")) -> DataFrame:
    """One row per run.

    ``trades``: keys, trade_id, ts_close, side (1/-1), pnl_quote, amount, close_type (text).
    Net PnL is relative to the summed amount, drawdown to amount + running peak, Sharpe = mean / std
    of per-trade returns x sqrt(n).
    """
    d = equity_curve(trades, keys, order)
    win, ret = F.col("pnl_quote") > 0, ratio("pnl_quote", "amount")
    long, short = F.col("side") > 0, F.col("side") < 0
    share = lambda side: ratio(F.count_if(win & side), F.count_if(side))
    out = d.groupBy(*keys).agg(
        F.sum("pnl_quote").alias("net_pnl_quote"), F.first("total_volume").alias("total_volume"),
        F.min("drawdown").alias("max_drawdown_usd"),
        F.min(ratio("drawdown", F.col("total_volume") + F.col("peak"))).alias("max_drawdown_pct"),
        (ratio(F.avg(ret), F.stddev_samp(ret)) * F.sqrt(F.count(F.lit(1)))).alias("sharpe_ratio"),
        ratio(F.sum(F.when(win, F.col("pnl_quote"))), F.abs(F.sum(F.when(~win, F.col("pnl_quote"))))).alias("profit_factor"),
        F.count(F.lit(1)).alias("total_executors"), share(long).alias("accuracy_long"), share(short).alias("accuracy_short"),
        F.count_if(long).alias("total_long"), F.count_if(short).alias("total_short"),
        *[F.count_if(F.col("close_type") == c).alias(c.lower()) for c in CLOSE_TYPES.values()])
    counts = F.map_from_arrays(F.array(*[F.lit(c) for c in CLOSE_TYPES.values()]), F.array(*[c.lower() for c in CLOSE_TYPES.values()]))
    return out.withColumns({"net_pnl": ratio("net_pnl_quote", "total_volume"), "close_types": counts})


def executor_sides(executors: DataFrame) -> DataFrame:
    """Side lifted out of the nested config."""
    return executors.withColumn("side", F.col("config.side"))


def live_versus_backtest(live: DataFrame, backtest: DataFrame, keys: Sequence[str], buffer_seconds: float = 3600.0) -> DataFrame:
    """Both summaries side by side, the backtest cut to the live period +- a buffer."""
    pad = F.make_dt_interval(secs=F.lit(buffer_seconds))
    period = live.groupBy(*keys).agg(F.min("ts_close").alias("_a"), F.max("ts_close").alias("_b"))
    cut = join_series(backtest, period, keys).filter(F.col("ts_close").between(F.col("_a") - pad, F.col("_b") + pad)).drop("_a", "_b")
    a = backtest_summary(live, keys).withColumn("source", F.lit("live"))
    return a.unionByName(backtest_summary(cut, keys).withColumn("source", F.lit("backtest")))


@dataclass(frozen=True)
class MacdBollingerTrial:
    """One configuration of the sweep; sizes and times are fixed across trials."""
    trial: int
    fast: int = 21
    slow: int = 42
    signal: int = 9
    length: int = 100
    width: float = 2.0
    take_profit: float = 0.04
    stop_loss: float = 0.03


@dataclass(frozen=True)
class TripleEmaTrial:
    trial: int
    short: int = 9
    medium: int = 20
    long: int = 50
    take_profit: float = 0.04
    stop_loss: float = 0.03


def parameter_grid(make, **choices) -> list:
    """Every combination of the choices, numbered."""
    names = list(choices)
    return [make(trial=i, **dict(zip(names, v))) for i, v in enumerate(itertools.product(*choices.values()))]


def parameter_sample(make, n: int, seed: int, **choices) -> list:
    """n seeded draws; the sweep's replacement for a sequential sampler."""
    rng = random.Random(seed)
    return [make(trial=i, **{k: rng.choice(list(v)) for k, v in choices.items()}) for i in range(n)]


def macd_bollinger_signals(bars: DataFrame, trials: Sequence[MacdBollingerTrial]) -> DataFrame:
    """Signals of all trials in one pass: every distinct indicator once, then one row per trial that
    has a signal. The trials travel inside the expression, no join is needed."""
    macds = sorted({(t.fast, t.slow, t.signal) for t in trials})
    bands = sorted({(t.length, t.width) for t in trials})
    halo = max(max(C.macd_memory(*m) for m in macds), max(b[0] for b in bands))
    df, p = segmented(bars, halo)
    df = df.withColumns({f"_bbp_{i}": R.bollinger(p, n, k)["bbp"] for i, (n, k) in enumerate(bands)})
    df = own_rows(C.indicators(df, p, *[C.Macd(*m, names=(f"m{i}_line", f"m{i}_signal", f"m{i}_hist")) for i, m in enumerate(macds)]))
    entries = []
    for t in trials:
        i = macds.index((t.fast, t.slow, t.signal))
        bbp, line, hist = F.col(f"_bbp_{bands.index((t.length, t.width))}"), F.col(f"m{i}_line"), F.col(f"m{i}_hist")
        entries.append(_entry(t, direction((bbp < 0.2) & (hist > 0) & (line < 0), (bbp > 0.8) & (hist < 0) & (line > 0))))
    return _explode_trials(df, entries)


def triple_ema_signals(bars: DataFrame, trials: Sequence[TripleEmaTrial]) -> DataFrame:
    lengths = sorted({n for t in trials for n in (t.short, t.medium, t.long)})
    df, p = segmented(bars, C.ema_memory(max(lengths)))
    df = own_rows(C.averages(df, p, *[C.ema_of(f"ema_{n}", "close", n) for n in lengths]))
    entries = []
    for t in trials:
        a, b, c = (F.col(f"ema_{n}") for n in (t.short, t.medium, t.long))
        entries.append(_entry(t, direction((a > b) & (b > c), (a < b) & (b < c))))
    return _explode_trials(df, entries)


def _entry(t, signal: Column) -> Column:
    return F.struct(F.lit(t.trial).alias("trial"), signal.alias("side"), F.lit(t.take_profit).alias("take_profit"),
                    F.lit(t.stop_loss).alias("stop_loss"))


def _explode_trials(df: DataFrame, entries: list[Column]) -> DataFrame:
    live = F.filter(F.array(*entries), lambda e: e["side"] != 0)
    # the place among all bars goes along: first touches start from it
    return df.withColumn("_t", F.explode(live)).select(*SERIES, "ts", "close", POS, "_t.*")


def sweep(signals: DataFrame, bars: DataFrame, limit_seconds: int, amount: float = 1000.0, cost: float = 0.0006) -> DataFrame:
    """Barrier trades of every signalled bar per trial and series, summarised per (trial, series)."""
    hits = first_touch(signals, bars, F.col("take_profit"), F.col("stop_loss"), limit_seconds, event_keys=["trial"])
    names = F.create_map(*[F.lit(x) for kv in CLOSE_TYPES.items() for x in kv])
    trades = hits.select(
        "trial", *SERIES, F.col("ts").alias("trade_id"), F.col("close_time").alias("ts_close"), "side",
        ((F.col("ret") - cost) * amount).alias("pnl_quote"), F.lit(amount).alias("amount"), names[F.col("close_type")].alias("close_type"))
    return backtest_summary(trades, ["trial", *SERIES])


def objective(summary: DataFrame, measure: str = "sharpe_ratio") -> DataFrame:
    """A run without a measure (no trades, no variance) counts as -infinity."""
    return summary.withColumn("value", F.coalesce(F.col(measure), F.lit(float("-inf"))))


def study_names(summary: DataFrame, base: str, day: Column) -> DataFrame:
    """One study per base name, day and pair."""
    return summary.withColumn("study", F.concat_ws("_", F.lit(base), F.date_format(day, "yyyy-MM-dd"), "trading_pair"))
