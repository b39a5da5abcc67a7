"""Composite features (F01-F12): typed config + DataFrame transform, kept in a registry.

``calculate`` adds columns for all series at once. ``feature_rows`` keeps the newest row per series
as a value map (F10), ``signal_rows`` the thresholded signal in [-1, 1] (F11).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions.columns import clip, direction, ratio, truthy
from tickloom.operators import recursive as C
from tickloom.operators import rolling as R
from tickloom.operators.fold import fold_series, reset_cumsum
from tickloom.operators.joins import latest_rows
from tickloom.operators.layout import POS, SERIES, join_series, own_rows, prefix_scan, segmented
from tickloom.operators.quantiles import exact_quantiles


def need(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"bars lack the columns {missing}")


def run_age(df: DataFrame, changed: str, decay: int, floor: float = 0.2) -> DataFrame:
    """Rows since the last change, and a freshness of 1 at the change falling to ``floor``."""
    df = prefix_scan(df, {"_start": ("max", F.when(F.col(changed) == 1, F.col(POS)))})
    df = df.withColumn("periods_since_cross", F.col(POS) - F.col("_start")).drop("_start")
    k = F.col("periods_since_cross")
    return df.withColumn("freshness_factor",
                         F.when(k == 0, 1.0).otherwise(F.greatest(F.lit(floor), 1 - k / decay)))


@dataclass(frozen=True)
class EmaTrend:
    """F01"""
    ema_lengths: tuple[int, int, int] = (20, 200, 500)
    rolling_window: int = 500
    momentum_window: int = 5
    decay_periods: int = 50
    min_intensity: float = 0.7
    min_range_pct: float = 0.01
    name: str = "ema_trend"
    category: str = "tf"

    @property
    def signal_name(self) -> str:
        return "ema_trend_" + "_".join(map(str, self.ema_lengths))

    def calculate(self, df: DataFrame) -> DataFrame:
        need(df, "close", "high", "low")
        short, mid, long = self.ema_lengths
        n, m = self.rolling_window, self.momentum_window
        df, p = segmented(df, C.ema_memory(max(self.ema_lengths)) + n + 2 * m)
        df = C.averages(df, p, *[C.ema_of(f"ema_{n_}", "close", n_) for n_ in self.ema_lengths])
        s, a, b = (F.col(f"ema_{x}") for x in (short, mid, long))
        df = df.withColumns({
            "signal": direction((s > a) & (s > b), (s < a) & (s < b)),
            "ema_divergence": s - (a + b) / 2,
            "price_range": R.highest("high", n, p) - R.lowest("low", n, p),
        })
        df = df.withColumn("divergence_momentum", R.diff("ema_divergence", m, p) / m)
        df = df.withColumns({
            "divergence_acceleration": R.diff("divergence_momentum", m, p),
            "signal_changed": (~F.col("signal").eqNullSafe(R.shift("signal", 1, p))).cast("int"),
        })
        df = R.rolling_rank(df, p, {"ema_divergence_pct": "ema_divergence",
                                    "momentum_normalized": "divergence_momentum",
                                    "acceleration_normalized": "divergence_acceleration"}, n)
        df = run_age(own_rows(df), "signal_changed", self.decay_periods)
        mag, mom, acc, fresh = (F.col(c) for c in ("ema_divergence_pct", "momentum_normalized",
                                                   "acceleration_normalized", "freshness_factor"))
        strength = lambda x, y, z: 0.20 * x + 0.30 * y + 0.10 * z + 0.40 * fresh
        return df.withColumns({
            "signal_intensity": F.when(F.col("signal") == 1, strength(mag, mom, acc))
            .when(F.col("signal") == -1, strength(1 - mag, 1 - mom, 1 - acc)).otherwise(0.0),
            "range_pct": ratio("price_range", "close"),
        })

    def values(self) -> dict[str, Column]:
        out = {f"ema_{x}": F.col(f"ema_{x}") for x in self.ema_lengths}
        return out | {"direction": F.col("signal"), "intensity": F.col("signal_intensity"),
                      "divergence": F.col("ema_divergence"), "range_pct": F.col("range_pct"), "price": F.col("close")}

    def signal(self) -> Column:
        ok = (F.abs("signal") == 1) & (F.col("signal_intensity") > self.min_intensity) & (
            F.col("range_pct") > self.min_range_pct)
        return F.when(ok, F.col("signal") * F.col("signal_intensity"))


@dataclass(frozen=True)
class MeanReversionChannel:
    """F02. Code -4 needs close above meanline + meanrange while below meanline, so it only occurs
    for a negative range; the branch is kept."""
    length: int = 200
    inner_mult: float = 1.0
    outer_mult: float = 2.415
    source: str = "hlc3"
    filter_type: str = "SuperSmoother"
    name: str = "mean_reversion_channel"
    category: str = "mr"

    @property
    def signal_name(self) -> str:
        return f"mean_reversion_{self.length}_{self.filter_type}"

    def calculate(self, df: DataFrame) -> DataFrame:
        need(df, "high", "low", "close")
        halo = max(C.smoothing_memory(self.filter_type, self.length),
                   C.smoothing_memory("SuperSmoother", self.length)) + self.length + 3
        df, p = segmented(df, halo, rows=C.one_block_rows(halo, C.supersmoother_rate(self.length)))
        hlc3 = (F.col("high") + F.col("low") + F.col("close")) / 3
        df = df.withColumn("source", hlc3 if self.source == "hlc3" else F.col(self.source))
        df = C.smoothing(df, p, "meanline", "source", self.length, self.filter_type)
        df = df.withColumn("tr", R.true_range(p))
        df = own_rows(C.supersmoother(df, p, "meanrange", "tr", self.length, start=1))
        reach = F.col("meanrange") * math.pi
        mean = F.col("meanline")
        df = df.withColumns({
            "upband1": mean + reach * self.inner_mult, "loband1": mean - reach * self.inner_mult,
            "upband2": mean + reach * self.outer_mult, "loband2": mean - reach * self.outer_mult,
        })
        return df.withColumn("condition", self._condition())

    @staticmethod
    def _condition() -> Column:
        """-5..5: how far the bar reached beyond the outer band (1-3) or where it closed (4, 5).

        Without a mean range no band exists and every band test fails.
        """
        close, high, low, mean, reach = (F.col(c) for c in ("close", "high", "low", "meanline", "meanrange"))
        up, lo = F.col("upband2"), F.col("loband2")
        above = (
            F.when(truthy((high >= up - 2 * reach) & (high < up)), 1)
            .when(truthy((high >= up) & (high < up + 2 * reach)), 2)
            .when(truthy(high >= up + 2 * reach), 3)
            .when(truthy(close <= mean + reach), 4).otherwise(5))
        below = (
            F.when(truthy((low <= lo + 2 * reach) & (low > lo)), -1)
            .when(truthy((low <= lo) & (low > lo - 2 * reach)), -2)
            .when(truthy(low <= lo - 2 * reach), -3)
            .when(truthy(close >= mean + reach), -4).otherwise(-5))
        return F.when(truthy(close > mean), above).when(truthy(close < mean), below).otherwise(0)

    def values(self) -> dict[str, Column]:
        return {c: F.col(c) for c in ("meanline", "upband1", "loband1", "upband2", "loband2", "meanrange", "condition")}

    def signal(self) -> Column:
        c = F.col("condition")
        return F.when(c.between(1, 3) | c.between(-3, -1), -c / 3.0)


@dataclass(frozen=True)
class Trend:
    """F05"""
    short_window: int = 50
    long_window: int = 200
    min_score: float = 0.5
    name: str = "trend"
    category: str = "tf"

    @property
    def signal_name(self) -> str:
        return f"trend_{self.short_window}_{self.long_window}"

    def calculate(self, df: DataFrame) -> DataFrame:
        need(df, "close")
        df, p = segmented(df, 2 * self.long_window)
        df = df.withColumns({"_ms": R.mean("close", self.short_window, p, partial=True),
                             "_ml": R.mean("close", self.long_window, p, partial=True)})
        df = own_rows(df.withColumns({
            "short_slope": R.slope("_ms", self.short_window, p, partial=True),
            "long_slope": R.slope("_ml", self.long_window, p, partial=True)})).drop("_ms", "_ml")
        s, l = F.col("short_slope"), F.col("long_slope")
        return df.withColumn("trend_score", (s - l) / (F.abs(s) + F.abs(l) + 1e-8))

    def values(self) -> dict[str, Column]:
        return {c: F.col(c) for c in ("trend_score", "short_slope", "long_slope")}

    def signal(self) -> Column:
        return F.when(F.abs("trend_score") > self.min_score, clip("trend_score", -1.0, 1.0))


@dataclass(frozen=True)
class TrendFury:
    """F06. The short rule always applies the VWAP filter, the long rule only when enabled."""
    window: int = 50
    vwap_window: int = 50
    use_returns: bool = False
    use_ema: bool = False
    use_volume_weighting: bool = False
    volume_normalization_window: int = 50
    cum_diff_quantile_threshold: float = 0.5
    reversal_sensitivity: float = 0.3
    slope_quantile_threshold: float = 0.4
    use_vwap_filter: bool = False
    use_slope_filter: bool = False
    name: str = "trend_fury"
    category: str = "tf"

    @property
    def signal_name(self) -> str:
        return f"trend_fury_{self.window}"

    def calculate(self, df: DataFrame) -> DataFrame:
        need(df, "close", "quote_asset_volume", "taker_buy_quote_volume")
        quote, paid = F.col("quote_asset_volume"), F.col("close") * F.col("quote_asset_volume")
        halo = self.window + max(self.vwap_window, self.volume_normalization_window) + 2
        halo += C.ema_memory(self.window) if self.use_ema else 0
        df, p = segmented(df, halo)
        if self.use_returns:
            df = df.withColumn("price_series", R.log_return("close", p))
        elif self.use_ema:
            df = C.ewm(df, p, "price_series", "close", self.window)
        else:
            df = df.withColumn("price_series", F.col("close"))
        df = df.withColumns({
            "taker_sell_quote_volume": quote - F.col("taker_buy_quote_volume"),
            "volume_weight": ratio(quote, R.mean(quote, self.volume_normalization_window, p, True))
            if self.use_volume_weighting else F.lit(1.0),
            "rolling_cum_volume": R.total(quote, self.vwap_window, p),
            "rolling_cum_volume_price": R.total(paid, self.vwap_window, p),
        })
        df = df.withColumn("slope", R.weighted_slope("price_series", "volume_weight", self.window, p)
                           if self.use_volume_weighting else R.slope("price_series", self.window, p))
        df = df.withColumn("slope_diff", R.diff("slope", 1, p))
        df = own_rows(fold_series(df, p, reset_cumsum("cumulative_slope_diff", "slope_diff", self.reversal_sensitivity)))
        df = prefix_scan(df, {"cum_volume": ("sum", quote), "cum_volume_price": ("sum", paid),
                              "_prev_cum": ("prev", "cumulative_slope_diff")})
        df = df.withColumns({
            "taker_buy_volume_ratio": ratio("taker_buy_quote_volume", quote),
            "vwap": ratio("cum_volume_price", "cum_volume"),
            "rolling_vwap": ratio("rolling_cum_volume_price", "rolling_cum_volume"),
        })
        slope, total = F.col("slope"), F.col("cumulative_slope_diff")
        cuts = exact_quantiles(df, {
            "_slope_up": (F.when(slope > 0, slope), self.slope_quantile_threshold),
            "_slope_down": (F.when(slope < 0, slope), self.slope_quantile_threshold),
            "_cum_up": (F.when(total > 0, total), self.cum_diff_quantile_threshold),
            "_cum_down": (F.when(total < 0, total), 1 - self.cum_diff_quantile_threshold),
        })
        df = join_series(df, cuts, how="left")
        jump = total - F.col("_prev_cum")
        yes = F.lit(True)
        long_rule = (total == 0) & (jump > F.col("_cum_up")) & (
            F.col("close") < F.col("rolling_vwap") if self.use_vwap_filter else yes) & (
            slope < F.col("_slope_down") if self.use_slope_filter else yes)
        short_rule = (total == 0) & (jump < F.col("_cum_down")) & (F.col("close") > F.col("rolling_vwap")) & (
            slope > F.col("_slope_up") if self.use_slope_filter else yes)
        df = df.withColumn("signal", direction(long_rule, short_rule))
        return df.drop("_prev_cum", "_slope_up", "_slope_down", "_cum_up", "_cum_down")

    def values(self) -> dict[str, Column]:
        return {"slope": F.col("slope"), "slope_diff": F.col("slope_diff"),
                "cumulative_slope_diff": F.col("cumulative_slope_diff"), "rolling_vwap": F.col("rolling_vwap"),
                "taker_buy_ratio": F.col("taker_buy_volume_ratio"), "signal": F.col("signal")}

    def signal(self) -> Column:
        return F.when(F.col("signal") != 0, F.col("signal").cast("double"))


@dataclass(frozen=True)
class Volatility:
    """F07"""
    window: int = 100
    name: str = "volatility"
    category: str = "tf"
    columns: tuple[str, ...] = field(default=("volatility", "natr", "bb_width"), repr=False)

    @property
    def signal_name(self) -> str:
        return f"volatility_{self.window}"

    def calculate(self, df: DataFrame) -> DataFrame:
        need(df, "high", "low", "close")
        df, p = segmented(df, C.rma_memory(self.window) + 1)
        df = df.withColumn("_ret", R.pct_change("close", p))
        n = self.window
        df = R.moments(df, p, n, "_ret", "close")
        df = df.withColumns({
            "volatility": F.sqrt(ratio("_m2__ret", F.lit(n - 1))),
            "bb_width": ratio(100 * 2 * 2.0 * F.sqrt(F.col("_m2_close") / n), "_mean_close"),
        }).drop("_mean__ret", "_m2__ret", "_mean_close", "_m2_close")
        df = C.natr(df, p, "natr", n)
        return own_rows(df.withColumn("natr", F.col("natr") / 100)).drop("_ret")

    def values(self) -> dict[str, Column]:
        return {f"current_{c}": F.col(c) for c in self.columns}

    def summary(self) -> list[Column]:
        """Mean, max and min over the history, stored next to the current values."""
        return [fn(c).alias(f"{n}_{c}") for c in self.columns
                for n, fn in (("mean", F.avg), ("max", F.max), ("min", F.min))]

    def signal(self) -> Column:
        return F.lit(None).cast("double")


@dataclass(frozen=True)
class Volume:
    """F08"""
    short_term_window: int = 5
    long_term_window: int = 100
    min_score: float = 0.6
    name: str = "volume"
    category: str = "tf"

    @property
    def signal_name(self) -> str:
        return f"volume_{self.short_term_window}_{self.long_term_window}"

    def calculate(self, df: DataFrame) -> DataFrame:
        need(df, "volume", "close", "taker_buy_base_volume")
        s, l = self.short_term_window, self.long_term_window
        df, p = segmented(df, l + 1)
        df = df.withColumns({"volume_usd": F.col("volume") * F.col("close"),
                             "buy_volume_usd": F.col("taker_buy_base_volume") * F.col("close")})
        df = df.withColumns({
            "sell_volume_usd": F.col("volume_usd") - F.col("buy_volume_usd"),
            "buy_percentage": F.coalesce(ratio("buy_volume_usd", "volume_usd"), F.lit(0.5))})
        df = df.withColumns({
            "buy_sell_imbalance": (F.col("buy_percentage") - 0.5) * 2,
            "buy_pressure_short_term": R.mean("buy_percentage", s, p, True),
            "volume_ma_short_term": R.mean("volume_usd", s, p, True),
            "trend_consistency": F.coalesce(1 - R.std("buy_percentage", s, p, True), F.lit(0.5))})
        df = R.means(df, p, l, {"buy_pressure_long_term": "buy_percentage", "volume_ma_long_term": "volume_usd"})
        df = own_rows(df.withColumn("buy_momentum", R.diff("buy_pressure_short_term", 1, p)))
        long_p = F.col("buy_pressure_long_term")
        df = df.withColumns({
            "buy_pressure_divergence": F.col("buy_pressure_short_term") - long_p,
            "volume_surge": F.coalesce(ratio("volume_usd", "volume_ma_long_term"), F.lit(1.0))})
        weight = F.col("volume_surge") * F.col("trend_consistency")
        return df.withColumns({
            "volume_buy_signal": F.col("volume_surge") * F.col("buy_pressure_divergence"),
            "accumulation_score": long_p * weight, "distribution_score": (1 - long_p) * weight})

    def values(self) -> dict[str, Column]:
        return {c: F.col(c) for c in (
            "buy_pressure_short_term", "buy_pressure_long_term", "buy_pressure_divergence", "volume_surge",
            "volume_buy_signal", "accumulation_score", "distribution_score", "buy_sell_imbalance")}

    def signal(self) -> Column:
        acc, dist = F.col("accumulation_score"), F.col("distribution_score")
        return F.when((acc > dist) & (acc > self.min_score), F.least(acc, F.lit(1.0))).when(
            (dist > acc) & (dist > self.min_score), -F.least(dist, F.lit(1.0)))


REGISTRY: dict[str, Callable] = {}


def register_feature(name: str, factory: Callable) -> None:
    """Make a user feature (config with ``calculate``, ``values``, ``signal``) known by name."""
    REGISTRY[name] = factory


for _f in (EmaTrend, MeanReversionChannel, Trend, TrendFury, Volatility, Volume):
    register_feature(_f().name, _f)


def add_features(df: DataFrame, *features) -> DataFrame:
    """chain several features over the same bars."""
    for f in features:
        df = df.transform(f.calculate)
    return df


def feature_rows(calculated: DataFrame, feature) -> DataFrame:
    """newest row per series as a feature record with a value map and its configuration."""
    values = {k: v.cast("double") for k, v in feature.values().items()}
    names = list(values)
    if hasattr(feature, "summary"):
        # one aggregate for the newest row and the history, so that the feature is calculated once
        newest = F.max_by(F.struct("ts", *[v.alias(k) for k, v in values.items()]), "ts").alias("_v")
        whole = calculated.groupBy(*SERIES).agg(newest, *feature.summary())
        last = whole.select("*", "_v.*").drop("_v")
        names += [c for c in whole.columns if c not in (*SERIES, "_v")]
    else:
        last = latest_rows(calculated.select(*SERIES, "ts", *[v.alias(k) for k, v in values.items()]))
    info = {k: str(v) for k, v in asdict(feature).items() if k not in ("name", "category", "columns")}
    return last.select(
        "ts", F.lit(feature.name).alias("feature_name"), "trading_pair", F.col("connector").alias("connector_name"),
        F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*names)).alias("value_map"),
        F.create_map(*[F.lit(x) for kv in info.items() for x in kv]).alias("info"))


def signal_rows(calculated: DataFrame, feature) -> DataFrame:
    """the newest bar's signal per series, only where one is given."""
    rows = calculated.select(*SERIES, "ts", feature.signal().alias("value"))
    return latest_rows(rows).filter(F.col("value").isNotNull()).select(
        "ts", F.lit(feature.signal_name).alias("signal_name"), "trading_pair",
        F.lit(feature.category).alias("category"), "value")


@dataclass(frozen=True)
class LearningSet:
    """indicator columns for the classifier."""
    name: str = "learning_set"

    def calculate(self, df: DataFrame) -> DataFrame:
        df, p = segmented(df, max(C.ema_memory(50), C.macd_memory(12, 26, 9), C.adx_memory(14), C.rma_memory(21)))
        wide = {}
        for n in (20, 50):
            wide |= {f"bb_{k}_{n}": v for k, v in R.bollinger(p, n, 2.0).items()}
            wide[f"sma_{n}"] = R.mean("close", n, p)
        wide |= {f"{c}_ret": R.pct_change(c, p) for c in ("open", "high", "low", "close")}
        wide["buy_volume_ratio"] = ratio("taker_buy_quote_volume", "quote_asset_volume")
        df = C.stochastic(df.withColumns(wide), p)
        df = C.indicators(
            df, p,
            *[C.Macd(f, s, g, names=(f"macd_{f}", f"macd_signal_{f}", f"macd_hist_{f}"))
              for f, s, g in ((12, 26, 9), (8, 21, 5))],
            C.Rsi("rsi_14", 14), C.Rsi("rsi_21", 21), C.Adx(14),
            extra=(C.ema_of("ema_20", "close", 20), C.ema_of("ema_50", "close", 50), C.rma_of("atr_14", "_tr", 14, 1)))
        return own_rows(df)

    @staticmethod
    def columns() -> list[str]:
        out = ["quote_asset_volume", "n_trades"]
        for n in (20, 50):
            out += [f"bb_{k}_{n}" for k in ("mid", "upper", "lower", "bbb", "bbp")] + [f"sma_{n}", f"ema_{n}"]
        for f in (12, 8):
            out += [f"macd_{f}", f"macd_signal_{f}", f"macd_hist_{f}"]
        return out + ["rsi_14", "rsi_21", "atr_14", "stoch_k", "stoch_d", "adx", "di_plus", "di_minus",
                      "open_ret", "high_ret", "low_ret", "close_ret", "buy_volume_ratio"]
