"""Strategy signals (G01-G13): long 1, short -1, else 0, for every bar of every series.

A strategy is a config dataclass with ``calculate``; the registry makes it available by name (U04).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions.columns import clip, direction, ratio
from tickloom.operators import recursive as C
from tickloom.operators import rolling as R
from tickloom.operators.fold import fold_series, supertrend
from tickloom.operators.joins import asof_join, latest_rows
from tickloom.operators.layout import POS, SERIES, join_series, own_rows, prefix_scan, segmented
from tickloom.plans.features import MeanReversionChannel
from tickloom.session import ensure_checkpoint_dir


@dataclass(frozen=True)
class Bollinger:
    """G01"""
    length: int = 100
    width: float = 2.0
    long_threshold: float = 0.0
    short_threshold: float = 1.0

    def calculate(self, bars: DataFrame) -> DataFrame:
        df, p = segmented(bars, self.length)
        bb = R.bollinger(p, self.length, self.width)
        df = own_rows(df.withColumns({"bbb": bb["bbb"], "bbp": bb["bbp"]}))
        return df.withColumn("signal", direction(F.col("bbp") < self.long_threshold, F.col("bbp") > self.short_threshold))


@dataclass(frozen=True)
class MacdBollinger:
    """G03"""
    length: int = 100
    width: float = 2.0
    fast: int = 21
    slow: int = 42
    smooth: int = 9
    long_threshold: float = 0.0
    short_threshold: float = 1.0

    def calculate(self, bars: DataFrame) -> DataFrame:
        df, p = segmented(bars, max(self.length, C.macd_memory(self.fast, self.slow, self.smooth)))
        df = df.withColumn("bbp", R.bollinger(p, self.length, self.width)["bbp"])
        df = own_rows(C.macd(df, p, self.fast, self.slow, self.smooth))
        bbp, line, hist = F.col("bbp"), F.col("macd"), F.col("macd_hist")
        return df.withColumn("signal", direction(
            (bbp < self.long_threshold) & (hist > 0) & (line < 0),
            (bbp > self.short_threshold) & (hist < 0) & (line > 0)))


@dataclass(frozen=True)
class OpeningRangeFade:
    """Band-2 touch between 12:00 and 15:00 that closes outside the morning's hourly opens."""
    channel: MeanReversionChannel = MeanReversionChannel()

    def calculate(self, bars: DataFrame) -> DataFrame:
        df = self.channel.calculate(bars)
        df = df.withColumns({"day": F.to_date("ts"), "_h": F.hour("ts"),
                             "_sec": F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")})
        # first open of each morning hour, then the day's range: both combine before the shuffle
        morning = bars.filter(F.hour("ts").between(8, 11)).groupBy(
            *SERIES, F.to_date("ts").alias("day"), F.hour("ts").alias("_h")).agg(F.min_by("open", "ts").alias("_o"))
        facts = morning.groupBy(*SERIES, "day").agg(F.min("_o").alias("min_open"), F.max("_o").alias("max_open"))
        df = join_series(df, facts, [*SERIES, "day"], "left")
        trading = F.col("_sec").between(12 * 3600, 15 * 3600)
        buy = (F.col("low") <= F.col("loband2")) & (F.col("close") < F.col("min_open"))
        sell = (F.col("high") >= F.col("upband2")) & (F.col("close") > F.col("max_open"))
        return df.withColumn("signal", direction(trading & buy, trading & sell)).drop("_h", "_sec", "day")


@dataclass(frozen=True)
class RajReversion:
    """G05. The pivots look ``pivot_right`` bars ahead, as in the strategy's own definition."""
    alma_length: int = 80
    alma_offset: float = 0.85
    alma_sigma: float = 16.0
    diff_length: int = 9
    diff_offset: float = 0.85
    diff_sigma: float = 16.0
    pivot_left: int = 7
    pivot_right: int = 7
    percentile: float = 86.0
    window: int = 100

    def calculate(self, bars: DataFrame) -> DataFrame:
        reach = self.alma_length + self.diff_length + self.window + self.pivot_left + 2
        df, p = segmented(bars, reach, ahead=self.pivot_right)
        df = df.withColumn("alma", R.alma("close", self.alma_length, self.alma_offset, self.alma_sigma, p))
        o, h, l, a = (F.col(c) for c in ("open", "high", "low", "alma"))
        df = df.withColumn("src", F.when((h - a > F.abs(l - a)) & (h - o > F.abs(l - o)), h)
                           .when((h - a < F.abs(l - a)) & (h - o < F.abs(l - o)), l).otherwise(F.col("close")))
        df = df.withColumn("diff", ratio(100 * (F.col("src") - a), a))
        df = df.withColumn("alma_over_mean", R.alma("diff", self.diff_length, self.diff_offset, self.diff_sigma, p))
        high, low = R.pivot_flags("diff", self.pivot_left, self.pivot_right, p)
        df = df.withColumn("pivot", F.when(high | low, F.col("diff")))
        df = df.withColumns({"_pct": R.quantile("pivot", self.percentile / 100, self.window, p),
                             "crossed_over": R.crossed_over("diff", "alma_over_mean", p),
                             "crossed_under": R.crossed_under("diff", "alma_over_mean", p)})
        df = prefix_scan(own_rows(df), {"pct_rank": ("last", "_pct")}).drop("_pct")
        return df.withColumn("signal", direction(
            F.col("crossed_over") & (F.col("diff") < -F.col("pct_rank")),
            F.col("crossed_under") & (F.col("diff") > F.col("pct_rank"))))


@dataclass(frozen=True)
class RsiTwoFrames:
    """The slower frame enters with its last completed bar, joined as of the faster bar."""
    length: int = 14
    oversold: float = 20.0
    overbought: float = 80.0

    def calculate(self, fast_bars: DataFrame, slow_bars: DataFrame) -> DataFrame:
        f, pf = segmented(fast_bars, C.rma_memory(self.length))
        fast = own_rows(C.rsi(f, pf, "rsi_fast", self.length))
        s, ps = segmented(slow_bars, C.rma_memory(self.length) + 1)
        s = C.rsi(s, ps, "rsi_now", self.length)
        slow = own_rows(s.withColumn("rsi_slow", R.shift("rsi_now", 1, ps)))
        out = asof_join(fast, slow, ["rsi_slow"]).na.drop(subset=["rsi_fast", "rsi_slow"])
        a, b = F.col("rsi_fast"), F.col("rsi_slow")
        return out.withColumn("signal", direction((a < self.oversold) & (b < self.oversold),
                                                  (a > self.overbought) & (b > self.overbought)))


@dataclass(frozen=True)
class SmugPlug:
    """G07"""
    fast: int = 21
    slow: int = 42
    smooth: int = 9
    emas: tuple[int, int, int] = (8, 29, 31)
    atr_length: int = 11
    atr_multiplier: float = 1.5

    def calculate(self, bars: DataFrame) -> DataFrame:
        df, p = segmented(bars, C.macd_memory(self.fast, self.slow, self.smooth) + 1)
        df = C.indicators(df, p, C.Macd(self.fast, self.slow, self.smooth), extra=(
            C.rma_of("atr", "_tr", self.atr_length, 1), *[C.ema_of(f"ema_{n}", "close", n) for n in self.emas]))
        prev = R.shift("close", 1, p)
        reach = F.col("atr") * self.atr_multiplier
        df = own_rows(df.withColumns({"long_atr_support": prev - reach, "short_atr_resistance": prev + reach}))
        a, b, c = (F.col(f"ema_{n}") for n in self.emas)
        close, hist = F.col("close"), F.col("macd_hist")
        return df.withColumn("signal", direction(
            (a > b) & (b > c) & (close > a) & (close > F.col("long_atr_support")) & (hist > 0),
            (a < b) & (b < c) & (close < a) & (close < F.col("short_atr_resistance")) & (hist < 0)))


def supertrend_columns(bars: DataFrame, length: int, multiplier: float) -> DataFrame:
    df, p = segmented(bars, C.rma_memory(length) + 200)
    df = C.atr(df, p, "_atr", length)
    return own_rows(fold_series(df, p, supertrend(multiplier))).drop("_atr")


@dataclass(frozen=True)
class SuperTrend:
    """G08"""
    length: int = 20
    multiplier: float = 4.0
    max_distance: float = 0.01

    def calculate(self, bars: DataFrame) -> DataFrame:
        df = supertrend_columns(bars, self.length, self.multiplier)
        df = df.withColumn("percentage_distance", ratio(F.abs(F.col("close") - F.col("supertrend")), "close"))
        near = F.col("percentage_distance") < self.max_distance
        return df.withColumn("signal", direction((F.col("supertrend_way") == 1) & near,
                                                 (F.col("supertrend_way") == -1) & near))


@dataclass(frozen=True)
class TripleEma:
    """G09"""
    emas: tuple[int, int, int] = (8, 29, 31)

    def calculate(self, bars: DataFrame) -> DataFrame:
        df, p = segmented(bars, C.ema_memory(max(self.emas)))
        df = C.averages(df, p, *[C.ema_of(f"ema_{n}", "close", n) for n in self.emas])
        a, b, c = (F.col(f"ema_{n}") for n in self.emas)
        return own_rows(df).withColumn("signal", direction((a > b) & (b > c) & (a > c), (a < b) & (b < c) & (a < c)))


@dataclass(frozen=True)
class PmmDynamic:
    """G13. The last bar's price multiplier applies to all rows of the series; z-score over the whole
    history by default, over the past only with ``causal``."""
    fast: int = 21
    slow: int = 42
    smooth: int = 9
    natr_length: int = 14
    causal: bool = False

    def calculate(self, bars: DataFrame) -> DataFrame:
        df, p = segmented(bars, max(C.macd_memory(self.fast, self.slow, self.smooth), C.rma_memory(self.natr_length)))
        df = own_rows(C.indicators(df, p, C.Macd(self.fast, self.slow, self.smooth),
                                   extra=(C.rma_of("natr", "_tr", self.natr_length, 1),)))
        df = df.withColumn("natr", ratio("natr", "close"))
        if self.causal:
            m = F.col("macd")
            df = prefix_scan(df, {"_n": ("count", m), "_s": ("sum", m), "_q": ("sum", m * m)})
            mean = ratio("_s", "_n")
            sd = F.sqrt(F.greatest(ratio(F.col("_q") - F.col("_s") * mean, F.col("_n") - 1), F.lit(0.0)))
            df = df.withColumns({"_mean": mean, "_sd": sd}).drop("_n", "_s", "_q")
        else:
            stats = df.groupBy(*SERIES).agg(F.avg("macd").alias("_mean"), F.stddev_samp("macd").alias("_sd"))
            df = join_series(df, stats)
        z = ratio(F.col("macd") - F.col("_mean"), "_sd")
        turn = F.when(F.col("macd_hist") > 0, 1).otherwise(-1)
        df = df.withColumn("_shift", (-0.5 * z + 0.5 * turn) * F.col("natr") / 2)
        if self.causal:
            return df.withColumn("reference_price", F.col("close") * (1 + F.col("_shift"))).withColumn(
                "spread_multiplier", F.col("natr")).drop("_mean", "_sd", "_shift")
        last = df.groupBy(*SERIES).agg(F.max_by(F.struct("_shift"), "ts").alias("_m"))
        df = join_series(df.drop("_shift"), last)
        return df.withColumn("reference_price", F.col("close") * (1 + F.col("_m._shift"))).withColumn(
            "spread_multiplier", F.col("natr")).drop("_mean", "_sd", "_m")


STRATEGIES: dict[str, Callable] = {
    "bollinger": Bollinger, "macd_bollinger": MacdBollinger, "opening_range_fade": OpeningRangeFade,
    "raj_reversion": RajReversion, "smug_plug": SmugPlug, "supertrend": SuperTrend, "triple_ema": TripleEma,
}


def register_strategy(name: str, factory: Callable) -> None:
    """A user strategy is a factory of objects with ``calculate(bars) -> bars + signal``."""
    STRATEGIES[name] = factory


def last_signals(calculated: DataFrame) -> DataFrame:
    """Newest signal per series."""
    return latest_rows(calculated.select(*SERIES, "ts", "close", "signal"))


def opposite_positions(signals: DataFrame, positions: DataFrame) -> DataFrame:
    """Active positions (side BUY/SELL) against the newest signal of their market."""
    s = signals.filter(F.col("signal") != 0).select(
        *SERIES, F.when(F.col("signal") == 1, "SELL").otherwise("BUY").alias("side"))
    return join_series(positions, s, [*SERIES, "side"], "left_semi")


def allowed_entries(signals: DataFrame, closed: DataFrame) -> DataFrame:
    """No new entry on the side of a stop-loss if that was the last closed position."""
    last = closed.groupBy(*SERIES).agg(
        F.max_by(F.struct("close_type", "side"), F.struct("close_ts", "executor_id")).alias("_last"))
    s = join_series(signals, last, how="left")
    side = F.when(F.col("signal") > 0, "BUY").when(F.col("signal") < 0, "SELL")
    barred = (F.col("_last.close_type") == "STOP_LOSS") & (F.col("_last.side") == side)
    return s.withColumn("can_create", (F.col("signal") != 0) & ~F.coalesce(barred, F.lit(False))).drop("_last")


SPREADS = (0.001, 0.018, 0.15, 0.25)


def dca_ladder(signals: DataFrame, amount_quote: float, spreads=SPREADS, weights=None, dynamic: bool = True,
               stop_loss: float = 0.03, activation: float = 0.015, delta: float = 0.003,
               stop_bounds: tuple[float, float] | None = None,
               trailing_bounds: tuple[float, float] | None = None) -> DataFrame:
    """One row per ladder level of each signalled bar.

    Prices p(1 -+ spread*m), amounts by normalised weight, m = band width / 200. With bounds the
    stop and the trailing activation are clamped and ``delta`` is a share of the activation.
    """
    weights = list(weights or [1.0] * len(spreads))
    m = F.col("bbb") / 200 if dynamic else F.lit(1.0)
    side = F.when(F.col("signal") > 0, -1.0).otherwise(1.0)
    stop = F.lit(stop_loss) * m
    act = F.lit(activation) * m
    if stop_bounds:
        stop = clip(stop, *stop_bounds)
    if trailing_bounds:
        act = clip(act, *trailing_bounds)
    trail = act * delta if trailing_bounds else F.lit(delta) * m
    levels = F.array(*[F.struct(F.lit(i).alias("level"), F.lit(s).alias("spread"),
                                F.lit(w / sum(weights)).alias("share"))
                       for i, (s, w) in enumerate(zip(spreads, weights))])
    df = signals.filter(F.col("signal") != 0).withColumn("_l", F.explode(levels))
    return df.select(
        *SERIES, "ts", "signal", F.col("_l.level").alias("level"),
        (F.col("close") * (1 + side * F.col("_l.spread") * m)).alias("price"),
        (F.col("_l.share") * amount_quote).alias("amount_quote"),
        stop.alias("stop_loss"), act.alias("activation_price"), trail.alias("trailing_delta"))



@dataclass(frozen=True)
class XGrid:
    """Triple EMA; take profit from the last peak beyond the bar, else an earlier one beyond the
    close, else the default; stop and limit from Donchian and NATR."""
    emas: tuple[int, int, int] = (8, 29, 31)
    donchian: int = 50
    natr_length: int = 100
    natr_multiplier: float = 2.0
    tp_default: float = 0.05
    prominence: float = 0.05
    distance: int = 100

    def calculate(self, bars: DataFrame) -> DataFrame:
        from tickloom.operators.peaks import earlier_peak, series_peaks
        df, p = segmented(bars, max(C.ema_memory(max(self.emas)), C.rma_memory(self.natr_length), self.donchian))
        df = df.withColumns({"sl_long": R.lowest("low", self.donchian, p), "sl_short": R.highest("high", self.donchian, p)})
        df = own_rows(C.indicators(df, p, extra=(C.rma_of("natr", "_tr", self.natr_length, 1),
                                                 *[C.ema_of(f"ema_{n}", "close", n) for n in self.emas])))
        df = df.withColumn("natr", ratio(100 * F.col("natr"), "close"))
        a, b, c = (F.col(f"ema_{n}") for n in self.emas)
        df = df.withColumn("signal", direction((a > b) & (b > c) & (a > c), (a < b) & (b < c) & (a < c)))
        df = df.withColumns({"limit_long": F.col("sl_long") * (1 + self.natr_multiplier * F.col("natr")),
                             "limit_short": F.col("sl_short") * (1 - self.natr_multiplier * F.col("natr"))})
        peaks = series_peaks(bars, self.prominence, self.distance)
        ensure_checkpoint_dir(df.sparkSession)
        for kind, side, edge, way in (("high", "long", "high", 1), ("low", "short", "low", -1)):
            mine = peaks.filter(F.col("kind") == kind)
            df = df.checkpoint()  # the steps below read the bars several times
            df = earlier_peak(df, mine, "_open", way > 0, F.col("close") * (1 + way * self.tp_default))
            df = join_series(df, mine.select(*SERIES, POS, F.col("price").alias("_peak")), [*SERIES, POS], "left").checkpoint()
            df = prefix_scan(df, {"_last": ("last", "_peak")})
            beyond = F.col("_last") > F.col(edge) if way > 0 else F.col("_last") < F.col(edge)
            df = df.withColumn(f"tp_{side}", F.when(beyond, F.col("_last")).otherwise(F.col("_open"))).drop("_peak", "_last", "_open")
        return df


def xgrid_targets(df: DataFrame) -> DataFrame:
    """Take-profit and stop fractions and the trailing stop of the newest bar's side."""
    long = F.col("signal") > 0
    tp = ratio(F.abs(F.when(long, F.col("tp_long")).otherwise(F.col("tp_short")) - F.col("close")), "close")
    sl = ratio(F.abs(F.when(long, F.col("sl_long")).otherwise(F.col("sl_short")) - F.col("close")), "close")
    return df.withColumns({"tp_pct": tp, "sl_pct": sl, "trailing_activation": tp * 0.5, "trailing_delta": tp * 0.5 * 0.2})
