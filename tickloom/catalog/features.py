"""F*, R08, R09: composite features and state machines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.catalog import oracle as O
from tickloom.catalog.recursive import NB, adx_ctes, macd_ctes, rsi_ctes, two_pole_ctes
from tickloom.catalog.registry import query
from tickloom.catalog.rolling import stoch_ctes
from tickloom.operators import recursive as C
from tickloom.operators import rolling as R
from tickloom.operators.fold import fold_series, reset_cumsum, supertrend
from tickloom.operators.layout import own_rows, segmented
from tickloom.plans import features as P

K = "connector trading_pair ts "
S = O.SERIES_W
ON = "a.connector = b.connector AND a.trading_pair = b.trading_pair"


def rank_cte(src: str, x: str, n: int) -> str:
    return f"""SELECT a.connector, a.trading_pair, a.i, CASE WHEN count(b.{x}) = {n} THEN
(count(*) FILTER (WHERE b.{x} < a.{x}) + (count(*) FILTER (WHERE b.{x} = a.{x}) + 1) / 2.0) / {n}.0 END AS v
FROM {src} a JOIN {src} b ON {ON} AND b.i BETWEEN a.i - {n - 1} AND a.i GROUP BY a.connector, a.trading_pair, a.i"""


EMA_TREND = P.EmaTrend(ema_lengths=(8, 20, 50), rolling_window=50)
EMA_TREND_CTES = {
    **NB, **O.ema("ema_8", 8), **O.ema("ema_20", 20), **O.ema("ema_50", 50),
    "et1": "SELECT *, CASE WHEN ema_8 < ema_20 AND ema_8 < ema_50 THEN -1 WHEN ema_8 > ema_20 AND ema_8 > ema_50 THEN 1 "
           "ELSE 0 END AS signal, ema_8 - (ema_20 + ema_50) / 2 AS ema_divergence FROM ("
           + O.joined("nb", "ema_8", "ema_20", "ema_50") + ")",
    "et2": f"""SELECT *, (ema_divergence - lag(ema_divergence, 5) OVER {S}) / 5 AS divergence_momentum,
CASE WHEN signal IS DISTINCT FROM lag(signal) OVER {S} THEN 1 ELSE 0 END AS changed,
CASE WHEN i >= 49 THEN max(high) OVER {O.w(50)} - min(low) OVER {O.w(50)} END AS price_range FROM et1""",
    "et3": f"""SELECT *, divergence_momentum - lag(divergence_momentum, 5) OVER {S} AS divergence_acceleration,
sum(changed) OVER {S} AS run FROM et2""",
    "et4": """SELECT *, row_number() OVER (PARTITION BY connector, trading_pair, run ORDER BY ts) - 1 AS periods_since_cross FROM et3""",
    "ema_divergence_pct": rank_cte("et4", "ema_divergence", 50),
    "momentum_normalized": rank_cte("et4", "divergence_momentum", 50),
    "acceleration_normalized": rank_cte("et4", "divergence_acceleration", 50),
    "et5": "SELECT *, CASE WHEN periods_since_cross = 0 THEN 1.0 ELSE greatest(0.2, 1 - periods_since_cross / 50.0) END AS freshness_factor FROM ("
           + O.joined("et4", "ema_divergence_pct", "momentum_normalized", "acceleration_normalized") + ")",
    "ema_trend": """SELECT *, CASE WHEN signal = 1 THEN 0.20 * ema_divergence_pct + 0.30 * momentum_normalized
 + 0.10 * acceleration_normalized + 0.40 * freshness_factor
WHEN signal = -1 THEN 0.20 * (1 - ema_divergence_pct) + 0.30 * (1 - momentum_normalized)
 + 0.10 * (1 - acceleration_normalized) + 0.40 * freshness_factor ELSE 0.0 END AS signal_intensity,
price_range / nullif(close, 0) AS range_pct FROM et5""",
}


@query("f01_ema_trend", K + "signal:i ema_divergence:6 ema_divergence_pct:6 momentum_normalized:6 acceleration_normalized:6 "
       "periods_since_cross:i freshness_factor:6 signal_intensity:6 range_pct:6", "bars_1h",
       ctes=EMA_TREND_CTES, sql="SELECT * FROM ema_trend")
def f01(view):
    return EMA_TREND.calculate(view("bars_1h"))


LAST = "FROM ({}) QUALIFY row_number() OVER (PARTITION BY connector, trading_pair ORDER BY ts DESC) = 1"
FEATURE_COLS = "ts feature_name trading_pair connector_name "


def feature_columns(df, names):
    return df.select("ts", "feature_name", "trading_pair", "connector_name",
                     *[F.try_element_at("value_map", F.lit(n)).alias(n) for n in names])


@query("f10_ema_trend_feature", FEATURE_COLS + "ema_8:6 direction:6 intensity:6 divergence:6 range_pct:6 price:6", "bars_1h",
       ctes=EMA_TREND_CTES,
       sql="SELECT *, 'ema_trend' AS feature_name, connector AS connector_name, signal AS direction, "
           "signal_intensity AS intensity, ema_divergence AS divergence, close AS price " + LAST.format("SELECT * FROM ema_trend"))
def f10_ema(view):
    rows = P.feature_rows(EMA_TREND.calculate(view("bars_1h")), EMA_TREND)
    return feature_columns(rows, ["ema_8", "direction", "intensity", "divergence", "range_pct", "price"])


SIGNAL_COLS = "ts signal_name trading_pair category value:6"


@query("f11_ema_trend_signal", SIGNAL_COLS, "bars_1h", ctes=EMA_TREND_CTES,
       sql="SELECT *, 'ema_trend_8_20_50' AS signal_name, 'tf' AS category, signal * signal_intensity AS value FROM (SELECT * "
           + LAST.format("SELECT * FROM ema_trend") + ") WHERE abs(signal) = 1 AND signal_intensity > 0.3 AND range_pct > 0.01")
def f11_ema(view):
    f = P.EmaTrend(ema_lengths=(8, 20, 50), rolling_window=50, min_intensity=0.3)
    return P.signal_rows(f.calculate(view("bars_1h")), f)


CHANNEL = P.MeanReversionChannel(length=40)
_SS40 = C.supersmoother_coefficients(40)


def channel_ctes() -> dict[str, str]:
    reach = "meanrange * pi()"
    return {
        "src": f"SELECT *, (high + low + close) / 3 AS hlc3, {O.TRUE_RANGE} AS tr FROM nb",
        **two_pole_ctes("ss_mean", "src", "hlc3", *_SS40), **two_pole_ctes("ss_tr", "src", "tr", *_SS40, start=1),
        "ch1": "SELECT *, CASE WHEN i < 1 THEN hlc3 ELSE ss_mean END AS meanline, CASE WHEN i = 1 THEN tr ELSE ss_tr END AS meanrange FROM ("
               + O.joined("src", "ss_mean", "ss_tr") + ")",
        "ch2": f"""SELECT *, meanline + {reach} AS upband1, meanline - {reach} AS loband1,
meanline + {reach} * 2.415 AS upband2, meanline - {reach} * 2.415 AS loband2 FROM ch1""",
        "channel": """SELECT *, CASE WHEN close > meanline THEN
 CASE WHEN high >= upband2 - 2 * meanrange AND high < upband2 THEN 1
  WHEN high >= upband2 AND high < upband2 + 2 * meanrange THEN 2 WHEN high >= upband2 + 2 * meanrange THEN 3
  WHEN close <= meanline + meanrange THEN 4 ELSE 5 END
 WHEN close < meanline THEN
 CASE WHEN low <= loband2 + 2 * meanrange AND low > loband2 THEN -1
  WHEN low <= loband2 AND low > loband2 - 2 * meanrange THEN -2 WHEN low <= loband2 - 2 * meanrange THEN -3
  WHEN close >= meanline + meanrange THEN -4 ELSE -5 END ELSE 0 END AS condition FROM ch2""",
    }


@query("f02_channel", K + "meanline:6 meanrange:6 upband1:6 loband1:6 upband2:6 loband2:6 condition:i", "bars_1h",
       ctes={**NB, **channel_ctes()}, sql="SELECT * FROM channel")
def f02(view):
    return CHANNEL.calculate(view("bars_1h"))


@query("f11_channel_signal", SIGNAL_COLS, "bars_1d", ctes={"nb": O.numbered("bars_1d"), **channel_ctes()},
       sql="SELECT *, 'mean_reversion_40_SuperSmoother' AS signal_name, 'mr' AS category, -condition / 3.0 AS value FROM (SELECT * "
           + LAST.format("SELECT * FROM channel") + ") WHERE abs(condition) BETWEEN 1 AND 3")
def f11_channel(view):
    return P.signal_rows(CHANNEL.calculate(view("bars_1d")), CHANNEL)


def trend_ctes(src="nb", s=10, l=50) -> dict[str, str]:
    return {
        "tm": f"SELECT *, avg(close) OVER {O.w(s)} AS ms, avg(close) OVER {O.w(l)} AS ml FROM {src}",
        "ts0": f"""SELECT *, CASE WHEN i > 0 THEN regr_slope(ms, i) OVER {O.w(s)} ELSE 0 END AS short_slope,
CASE WHEN i > 0 THEN regr_slope(ml, i) OVER {O.w(l)} ELSE 0 END AS long_slope FROM tm""",
        "trend": "SELECT *, (short_slope - long_slope) / (abs(short_slope) + abs(long_slope) + 1e-8) AS trend_score FROM ts0",
    }


TREND = P.Trend(10, 50)


@query("f05_trend", K + "short_slope:6 long_slope:6 trend_score:5", "bars_1h", ctes={**NB, **trend_ctes()}, sql="SELECT * FROM trend")
def f05(view):
    return TREND.calculate(view("bars_1h"))


@query("f11_trend_signal", SIGNAL_COLS, "bars_1h", ctes={**NB, **trend_ctes()},
       sql="SELECT *, 'trend_10_50' AS signal_name, 'tf' AS category, greatest(-1, least(1, trend_score)) AS value FROM (SELECT * "
           + LAST.format("SELECT * FROM trend") + ") WHERE abs(trend_score) > 0.5")
def f11_trend(view):
    return P.signal_rows(TREND.calculate(view("bars_1h")), TREND)


def reset_cte(name: str, src: str, x: str, sensitivity: float) -> dict[str, str]:
    keep = 1 - sensitivity
    return {
        f"{name}_in": f"SELECT connector, trading_pair, i, {x} AS d FROM {src}",
        name: f"""SELECT connector, trading_pair, CAST(-1 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS total, CAST(0 AS DOUBLE) AS hi,
CAST(0 AS DOUBLE) AS lo, 0 AS trend, CAST(NULL AS DOUBLE) AS v FROM {name}_in WHERE i = 0
UNION ALL
SELECT connector, trading_pair, i, CASE WHEN flip THEN 0 ELSE t END, CASE WHEN flip THEN 0 ELSE hi1 END,
CASE WHEN flip THEN 0 ELSE lo1 END, CASE WHEN flip THEN -trend WHEN d IS NULL OR trend <> 0 THEN trend
 WHEN t > 0 THEN 1 WHEN t < 0 THEN -1 ELSE 0 END, CASE WHEN d IS NULL THEN NULL WHEN flip THEN 0 ELSE t END
FROM (SELECT *, d IS NOT NULL AND ((trend > 0 AND t <= hi1 * {keep!r}) OR (trend < 0 AND t >= lo1 * {keep!r})) AS flip
 FROM (SELECT b.connector, b.trading_pair, b.i, b.d, s.trend, s.total + coalesce(b.d, 0) AS t,
  CASE WHEN b.d IS NULL THEN s.hi WHEN s.trend > 0 THEN greatest(s.hi, s.total + b.d)
   WHEN s.trend = 0 AND s.total + b.d > 0 THEN s.total + b.d ELSE s.hi END AS hi1,
  CASE WHEN b.d IS NULL THEN s.lo WHEN s.trend < 0 THEN least(s.lo, s.total + b.d)
   WHEN s.trend = 0 AND s.total + b.d < 0 THEN s.total + b.d ELSE s.lo END AS lo1
  FROM {name} s JOIN {name}_in b ON b.connector = s.connector AND b.trading_pair = s.trading_pair AND b.i = s.i + 1))""",
    }


@query("r09_reset_cumsum", K + "cum:6", "bars_1h",
       ctes={**NB, "chg": "SELECT *, close - prev_close AS chg FROM nb", **reset_cte("cum", "chg", "chg", 0.3)},
       sql=O.joined("chg", "cum"))
def r09(view):
    df, p = segmented(view("bars_1h"), 200)
    df = df.withColumn("chg", R.diff("close", 1, p))
    return own_rows(fold_series(df, p, reset_cumsum("cum", "chg", 0.3)))


def supertrend_ctes(n: int, mult: float) -> dict[str, str]:
    return {
        "st_tr": f"SELECT *, {O.TRUE_RANGE} AS tr FROM nb", **O.rma("st_atr", n, "st_tr", "tr", 1),
        "st_b": (f"SELECT *, (high + low) / 2 + {mult!r} * st_atr AS ub, (high + low) / 2 - {mult!r} * st_atr AS lb FROM ("
                 + O.joined("st_tr", "st_atr") + ")"),
        "st_run": f"""SELECT connector, trading_pair, i, ub, lb, 1 AS way FROM st_b WHERE i = {n}
UNION ALL
SELECT connector, trading_pair, i, CASE WHEN way = -1 AND way = way0 AND NOT turn THEN least(ub, ub0) ELSE ub END,
CASE WHEN way = 1 AND NOT turn THEN greatest(lb, lb0) ELSE lb END, way FROM (
 SELECT b.connector, b.trading_pair, b.i, b.ub, b.lb, s.ub AS ub0, s.lb AS lb0, s.way AS way0,
 (b.close > s.ub OR b.close < s.lb) AS turn,
 CASE WHEN b.close > s.ub THEN 1 WHEN b.close < s.lb THEN -1 ELSE s.way END AS way
 FROM st_run s JOIN st_b b ON b.connector = s.connector AND b.trading_pair = s.trading_pair AND b.i = s.i + 1)""",
        "st_out": """SELECT b.*, CASE WHEN r.way = 1 THEN r.lb ELSE r.ub END AS supertrend, r.way AS supertrend_way FROM st_b b
LEFT JOIN st_run r ON r.connector = b.connector AND r.trading_pair = b.trading_pair AND r.i = b.i""",
    }


@query("r08_supertrend", K + "supertrend:6 supertrend_way:i", "bars_1h", ctes={**NB, **supertrend_ctes(20, 2.0)},
       sql="SELECT * FROM st_out")
def r08(view):
    return with_supertrend(view("bars_1h"), 20, 2.0)


def with_supertrend(bars, n, mult):
    from tickloom.plans.signals import supertrend_columns
    return supertrend_columns(bars, n, mult)


FURY = P.TrendFury(window=20, vwap_window=20)


def fury_ctes() -> dict[str, str]:
    return {
        "fu1": f"""SELECT *, CASE WHEN i >= 19 THEN regr_slope(close, i) OVER {O.w(20)} END AS slope,
sum(close * quote_asset_volume) OVER {S} / nullif(sum(quote_asset_volume) OVER {S}, 0) AS vwap,
CASE WHEN i >= 19 THEN sum(close * quote_asset_volume) OVER {O.w(20)} / nullif(sum(quote_asset_volume) OVER {O.w(20)}, 0) END AS rolling_vwap,
taker_buy_quote_volume / nullif(quote_asset_volume, 0) AS taker_buy_volume_ratio FROM nb""",
        "fu2": f"SELECT *, slope - lag(slope) OVER {S} AS slope_diff FROM fu1",
        **reset_cte("cumulative_slope_diff", "fu2", "slope_diff", 0.3),
        "fu3": O.joined("fu2", "cumulative_slope_diff"),
        "fu4": f"SELECT *, cumulative_slope_diff - lag(cumulative_slope_diff) OVER {S} AS jump FROM fu3",
        "cuts": """SELECT connector, trading_pair, quantile_cont(cumulative_slope_diff, 0.5) FILTER (WHERE cumulative_slope_diff > 0) AS up,
quantile_cont(cumulative_slope_diff, 0.5) FILTER (WHERE cumulative_slope_diff < 0) AS down FROM fu4 GROUP BY ALL""",
        "fury": """SELECT *, CASE WHEN cumulative_slope_diff = 0 AND jump < down AND close > rolling_vwap THEN -1
WHEN cumulative_slope_diff = 0 AND jump > up THEN 1 ELSE 0 END AS signal FROM fu4 JOIN cuts USING (connector, trading_pair)""",
    }


@query("f06_trend_fury", K + "slope:6 slope_diff:6 cumulative_slope_diff:6 vwap:6 rolling_vwap:6 taker_buy_volume_ratio:6 signal:i",
       "bars_1h", ctes={**NB, **fury_ctes()}, sql="SELECT * FROM fury")
def f06(view):
    return FURY.calculate(view("bars_1h"))


FILTERED = P.TrendFury(window=20, vwap_window=30, use_volume_weighting=True, volume_normalization_window=15, cum_diff_quantile_threshold=0.3,
                       reversal_sensitivity=0.2, slope_quantile_threshold=0.6, use_vwap_filter=True, use_slope_filter=True)


def filtered_fury_ctes() -> dict[str, str]:
    """Volume weights, both filters, and thresholds that differ above and below zero."""
    mean = f"sum(v * close) OVER {O.w(20)}"
    return {
        "fv": f"SELECT *, quote_asset_volume / nullif(avg(quote_asset_volume) OVER {O.w(15)}, 0) AS v FROM nb",
        "fu1": f"""SELECT *, CASE WHEN i >= 19 THEN (sum(v * i * close) OVER {O.w(20)} - sum(v * i) OVER {O.w(20)} * {mean} / nullif(sum(v) OVER {O.w(20)}, 0))
/ nullif(sum(v * i * i) OVER {O.w(20)} - (sum(v * i) OVER {O.w(20)}) ** 2 / nullif(sum(v) OVER {O.w(20)}, 0), 0) END AS slope,
CASE WHEN i >= 29 THEN sum(close * quote_asset_volume) OVER {O.w(30)} / nullif(sum(quote_asset_volume) OVER {O.w(30)}, 0) END AS rolling_vwap FROM fv""",
        "fu2": f"SELECT *, slope - lag(slope) OVER {S} AS slope_diff FROM fu1",
        **reset_cte("cumulative_slope_diff", "fu2", "slope_diff", 0.2),
        "fu3": O.joined("fu2", "cumulative_slope_diff"),
        "fu4": f"SELECT *, cumulative_slope_diff - lag(cumulative_slope_diff) OVER {S} AS jump FROM fu3",
        "cuts": """SELECT connector, trading_pair, quantile_cont(cumulative_slope_diff, 0.3) FILTER (WHERE cumulative_slope_diff > 0) AS up,
quantile_cont(cumulative_slope_diff, 0.7) FILTER (WHERE cumulative_slope_diff < 0) AS down, quantile_cont(slope, 0.6) FILTER (WHERE slope > 0) AS steep_up,
quantile_cont(slope, 0.6) FILTER (WHERE slope < 0) AS steep_down FROM fu4 GROUP BY ALL""",
        "fury": """SELECT *, CASE WHEN cumulative_slope_diff = 0 AND jump < down AND close > rolling_vwap AND slope > steep_up THEN -1
WHEN cumulative_slope_diff = 0 AND jump > up AND close < rolling_vwap AND slope < steep_down THEN 1 ELSE 0 END AS signal FROM fu4 JOIN cuts USING (connector, trading_pair)""",
    }


@query("f06_trend_fury_filtered", K + "slope:4 slope_diff:4 cumulative_slope_diff:4 rolling_vwap:6 signal:i",
       "bars_1h", ctes={**NB, **filtered_fury_ctes()}, sql="SELECT * FROM fury")
def f06_filtered(view):
    return FILTERED.calculate(view("bars_1h"))


def volatility_ctes(src="nb", n=30) -> dict[str, str]:
    return {
        "v0": f"SELECT *, close / nullif(prev_close, 0) - 1 AS ret, {O.TRUE_RANGE} AS tr FROM {src}",
        **O.rma("v_atr", n, "v0", "tr", 1),
        "volatility": f"""SELECT *, CASE WHEN count(ret) OVER {O.w(n)} >= {n} THEN stddev_samp(ret) OVER {O.w(n)} END AS volatility,
v_atr / close AS natr, CASE WHEN i >= {n - 1} THEN 400 * stddev_pop(close) OVER {O.w(n)} / nullif(avg(close) OVER {O.w(n)}, 0) END AS bb_width
FROM ({O.joined("v0", "v_atr")})""",
    }


@query("f07_volatility", K + "volatility:7 natr:7 bb_width:6", "bars_1d",
       ctes={"nb": O.numbered("bars_1d"), **volatility_ctes()}, sql="SELECT * FROM volatility")
def f07(view):
    return P.Volatility(30).calculate(view("bars_1d"))


@query("f10_volatility_feature", FEATURE_COLS + "current_natr:7 mean_volatility:7 max_natr:7 min_bb_width:6", "bars_1d",
       ctes={"nb": O.numbered("bars_1d"), **volatility_ctes()},
       sql="""SELECT max(ts) AS ts, 'volatility' AS feature_name, trading_pair, connector AS connector_name, arg_max(natr, ts) AS current_natr,
avg(volatility) AS mean_volatility, max(natr) AS max_natr, min(bb_width) AS min_bb_width FROM volatility GROUP BY connector, trading_pair""")
def f10_volatility(view):
    f = P.Volatility(30)
    rows = P.feature_rows(f.calculate(view("bars_1d")), f)
    return feature_columns(rows, ["current_natr", "mean_volatility", "max_natr", "min_bb_width"])


def volume_ctes(src="nb", s=5, l=100) -> dict[str, str]:
    return {
        "vo1": f"""SELECT *, volume * close AS volume_usd, coalesce(taker_buy_base_volume * close / nullif(volume * close, 0), 0.5) AS bp FROM {src}""",
        "vo2": f"""SELECT *, (bp - 0.5) * 2 AS buy_sell_imbalance, avg(bp) OVER {O.w(s)} AS buy_pressure_short_term,
avg(bp) OVER {O.w(l)} AS buy_pressure_long_term, avg(volume_usd) OVER {O.w(l)} AS ma,
coalesce(1 - stddev_samp(bp) OVER {O.w(s)}, 0.5) AS trend_consistency FROM vo1""",
        "vo3": f"""SELECT *, buy_pressure_short_term - buy_pressure_long_term AS buy_pressure_divergence,
buy_pressure_short_term - lag(buy_pressure_short_term) OVER {S} AS buy_momentum,
coalesce(volume_usd / nullif(ma, 0), 1) AS volume_surge FROM vo2""",
        "volume_f": """SELECT *, volume_surge * buy_pressure_divergence AS volume_buy_signal,
buy_pressure_long_term * volume_surge * trend_consistency AS accumulation_score,
(1 - buy_pressure_long_term) * volume_surge * trend_consistency AS distribution_score FROM vo3""",
    }


@query("f08_volume", K + "buy_sell_imbalance:6 buy_pressure_short_term:6 buy_pressure_long_term:6 buy_pressure_divergence:6 buy_momentum:6 "
       "volume_surge:6 volume_buy_signal:6 trend_consistency:6 accumulation_score:6 distribution_score:6", "bars_1h",
       ctes={**NB, **volume_ctes()}, sql="SELECT * FROM volume_f")
def f08(view):
    return P.Volume().calculate(view("bars_1h"))


@query("f08_volume_daily", K + "buy_pressure_divergence:6 volume_surge:6 accumulation_score:6", "bars_1d",
       ctes={"nb": O.numbered("bars_1d"), **volume_ctes()}, sql="SELECT * FROM volume_f")
def f08_daily(view):
    return P.Volume().calculate(view("bars_1d"))


@query("f11_volume_signal", SIGNAL_COLS, "bars_1d", ctes={"nb": O.numbered("bars_1d"), **volume_ctes()},
       sql="""SELECT *, 'volume_5_100' AS signal_name, 'tf' AS category, CASE WHEN accumulation_score > distribution_score
THEN least(accumulation_score, 1.0) ELSE -least(distribution_score, 1.0) END AS value FROM (SELECT * """
           + LAST.format("SELECT * FROM volume_f") + """) WHERE (accumulation_score > distribution_score AND accumulation_score > 0.6)
OR (distribution_score > accumulation_score AND distribution_score > 0.6)""")
def f11_volume(view):
    f = P.Volume()
    return P.signal_rows(f.calculate(view("bars_1d")), f)


@query("f09_chained_features", K + "trend_score:5 volatility:7 volume_surge:6", "bars_1h",
       ctes={**NB, **trend_ctes(), **volatility_ctes(), **volume_ctes()},
       sql="""SELECT t.connector, t.trading_pair, t.ts, trend_score, volatility, volume_surge FROM trend t
JOIN volatility v ON v.connector = t.connector AND v.trading_pair = t.trading_pair AND v.ts = t.ts
JOIN volume_f f ON f.connector = t.connector AND f.trading_pair = t.trading_pair AND f.ts = t.ts""")
def f09(view):
    return P.add_features(view("bars_1h"), TREND, P.Volatility(30), P.Volume())


LEARNING_CTES = {
    **NB, **O.ema("ema_20", 20), **O.ema("ema_50", 50), **macd_ctes(fast=12, slow=26, signal=9),
    **rsi_ctes(), **rsi_ctes(n=21, name="rsi21"), **adx_ctes(), **O.rma("atr_14", 14, "dm", "tr", 1), **stoch_ctes(),
    "base": f"""SELECT *, CASE WHEN i >= 49 THEN (close - avg(close) OVER {O.w(50)} + 2 * stddev_pop(close) OVER {O.w(50)})
 / nullif(4 * stddev_pop(close) OVER {O.w(50)}, 0) END AS bb_bbp_50, close / nullif(prev_close, 0) - 1 AS close_ret,
taker_buy_quote_volume / nullif(quote_asset_volume, 0) AS buy_volume_ratio FROM nb""",
    **{f"x_{n}": f"SELECT connector, trading_pair, i, {c} AS v FROM {t}" for n, c, t in (
        ("macd", "macd_hist", "macd_all"), ("rsi", "rsi", "rsi_all"), ("rsi21", "rsi21", "rsi21_all"), ("stoch", "stoch_d", "st2"))},
}


@query("f12_learning_set", K + "bb_bbp_50:6 ema_50:6 macd_hist_12:6 rsi_14:6 rsi_21:6 atr_14:6 stoch_d:6 adx:6 close_ret:7 buy_volume_ratio:6",
       "bars_1h", ctes=LEARNING_CTES,
       sql="SELECT *, x_macd AS macd_hist_12, x_rsi AS rsi_14, x_rsi21 AS rsi_21, x_stoch AS stoch_d FROM ("
           + O.joined("base", "ema_50", "x_macd", "x_rsi", "x_rsi21", "x_stoch", "atr_14", "adx") + ")")
def f12(view):
    return P.LearningSet().calculate(view("bars_1h"))
