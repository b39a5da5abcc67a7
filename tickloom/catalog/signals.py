"""G*: strategy signals, ladders and grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.catalog import oracle as O
from tickloom.catalog.features import channel_ctes, fury_ctes, supertrend_ctes
from tickloom.catalog.recursive import NB, macd_ctes, rsi_ctes
from tickloom.catalog.registry import query
from tickloom.catalog.rolling import alma_sql
from tickloom.operators.ingest import coarser_bars
from tickloom.operators.layout import SERIES
from tickloom.plans import features as P
from tickloom.plans import grids as Gr
from tickloom.plans import signals as G

K = "connector trading_pair ts "
S = O.SERIES_W


def bb_cte(src: str = "nb", n: int = 20, k: float = 2.0) -> str:
    return f"""SELECT *, CASE WHEN i >= {n - 1} THEN {200 * k} * stddev_pop(close) OVER {O.w(n)} / nullif(avg(close) OVER {O.w(n)}, 0) END AS bbb,
CASE WHEN i >= {n - 1} THEN (close - avg(close) OVER {O.w(n)} + {k} * stddev_pop(close) OVER {O.w(n)})
 / nullif({2 * k} * stddev_pop(close) OVER {O.w(n)}, 0) END AS bbp FROM {src}"""


BB = {**NB, "bb": bb_cte(), "bbs": "SELECT *, CASE WHEN bbp > 1 THEN -1 WHEN bbp < 0 THEN 1 ELSE 0 END AS signal FROM bb"}


@query("g01_bollinger", K + "bbp:6 signal:i", "bars_1h", ctes=BB, sql="SELECT * FROM bbs")
def g01(view):
    return G.Bollinger(20).calculate(view("bars_1h"))


LADDER = """SELECT s.*, l.level, s.close * (1 + CASE WHEN signal > 0 THEN -1 ELSE 1 END * l.spread * bbb / 200) AS price,
250.0 AS amount_quote FROM bbs s JOIN (VALUES (0, 0.001), (1, 0.018), (2, 0.15), (3, 0.25)) l(level, spread) ON signal <> 0"""
LADDER_COLS = K + "signal:i level:i price:6 amount_quote:4 stop_loss:6 activation_price:6 trailing_delta:6"


@query("g02_dca_ladder", LADDER_COLS, "bars_1h", ctes=BB,
       sql=f"SELECT *, 0.03 * bbb / 200 AS stop_loss, 0.015 * bbb / 200 AS activation_price, 0.003 * bbb / 200 AS trailing_delta FROM ({LADDER})")
def g02(view):
    return G.dca_ladder(G.Bollinger(20).calculate(view("bars_1h")), 1000.0)


@query("g03_macd_bb", K + "bbp:6 macd:6 macd_hist:6 signal:i", "bars_1h",
       ctes={**NB, "bb": bb_cte(n=30), **macd_ctes("bb")},
       sql="""SELECT *, CASE WHEN bbp > 0.8 AND macd_hist < 0 AND macd > 0 THEN -1
WHEN bbp < 0.2 AND macd_hist > 0 AND macd < 0 THEN 1 ELSE 0 END AS signal FROM macd_all""")
def g03(view):
    return G.MacdBollinger(30, 2.0, long_threshold=0.2, short_threshold=0.8).calculate(view("bars_1h"))


@query("g04_opening_range", K + "min_open:6 max_open:6 signal:i", "bars_1h",
       ctes={**NB, **channel_ctes(),
             "facts": """SELECT connector, trading_pair, CAST(ts AS DATE) AS day, min(o) AS min_open, max(o) AS max_open FROM (
SELECT connector, trading_pair, date_trunc('hour', ts) AS ts, arg_min(open, b.ts) AS o FROM bars_1h b
WHERE hour(b.ts) BETWEEN 8 AND 11 GROUP BY connector, trading_pair, date_trunc('hour', ts)) GROUP BY ALL""",
             "j": """SELECT c.*, f.min_open, f.max_open, CAST(c.ts AS TIME) BETWEEN TIME '12:00:00' AND TIME '15:00:00' AS trading FROM channel c
LEFT JOIN facts f ON f.connector = c.connector AND f.trading_pair = c.trading_pair AND f.day = CAST(c.ts AS DATE)"""},
       sql="""SELECT *, CASE WHEN trading AND high >= upband1 AND close > max_open THEN -1
WHEN trading AND low <= loband1 AND close < min_open THEN 1 ELSE 0 END AS signal FROM j""")
def g04(view):
    channel = P.MeanReversionChannel(length=40, outer_mult=1.0)
    return G.OpeningRangeFade(channel).calculate(view("bars_1h"))


RAJ = G.RajReversion(alma_length=20, alma_sigma=6.0, diff_sigma=6.0)


@query("g05_raj_reversion", K + "alma:6 src:6 diff:5 alma_over_mean:5 pct_rank:5 signal:i", "bars_1h",
       ctes={**NB, "a0": f"SELECT *, {alma_sql('close', 20, 0.85, 6.0)} AS alma FROM nb",
             "a1": """SELECT *, CASE WHEN high - alma > abs(low - alma) AND high - open > abs(low - open) THEN high
WHEN high - alma < abs(low - alma) AND high - open < abs(low - open) THEN low ELSE close END AS src FROM a0""",
             "a2": "SELECT *, 100 * (src - alma) / nullif(alma, 0) AS diff FROM a1",
             "a3": f"SELECT *, {alma_sql('diff', 9, 0.85, 6.0)} AS alma_over_mean, CASE WHEN diff = max(diff) OVER f OR diff = min(diff) OVER f THEN diff END AS pivot_value FROM a2 "
                   "WINDOW f AS (PARTITION BY connector, trading_pair ORDER BY ts ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)",
             "a4": f"SELECT *, quantile_cont(pivot_value, 0.86) OVER {O.w(100)} AS pct, diff > alma_over_mean AND lag(diff) OVER {S} < lag(alma_over_mean) OVER {S} AS up, "
                   f"diff < alma_over_mean AND lag(diff) OVER {S} > lag(alma_over_mean) OVER {S} AS down FROM a3",
             "a5": f"SELECT *, last_value(pct IGNORE NULLS) OVER {S} AS pct_rank FROM a4"},
       sql="SELECT *, CASE WHEN down AND diff > pct_rank THEN -1 WHEN up AND diff < -pct_rank THEN 1 ELSE 0 END AS signal FROM a5")
def g05(view):
    return RAJ.calculate(view("bars_1h"))


@query("g06_rsi_two_frames", K + "rsi_fast:6 rsi_slow:6 signal:i", "bars_1h",
       ctes={**NB, **rsi_ctes(name="rsi1"),
             "slow": """SELECT connector, trading_pair, time_bucket(INTERVAL 4 HOURS, ts, TIMESTAMP '1970-01-01') AS ts, arg_max(close, b.ts) AS close,
max(high) AS high, min(low) AS low FROM bars_1h b GROUP BY connector, trading_pair, time_bucket(INTERVAL 4 HOURS, ts, TIMESTAMP '1970-01-01')""",
             "nb4": O.numbered("slow"), **rsi_ctes("nb4", name="rsi4"),
             "prev4": f"SELECT connector, trading_pair, ts, lag(rsi4) OVER {S} AS rsi_slow FROM rsi4_all"},
       sql="""SELECT a.connector, a.trading_pair, a.ts, rsi1 AS rsi_fast, rsi_slow, CASE WHEN rsi1 > 60 AND rsi_slow > 60 THEN -1
WHEN rsi1 < 40 AND rsi_slow < 40 THEN 1 ELSE 0 END AS signal FROM rsi1_all a ASOF LEFT JOIN prev4 b
ON a.connector = b.connector AND a.trading_pair = b.trading_pair AND a.ts >= b.ts WHERE rsi1 IS NOT NULL AND rsi_slow IS NOT NULL""")
def g06(view):
    b = view("bars_1h")
    return G.RsiTwoFrames(14, 40, 60).calculate(b, coarser_bars(b, "4h"))


@query("g07_smugplug", K + "ema_8:6 long_atr_support:6 short_atr_resistance:6 macd_hist:6 signal:i", "bars_1h",
       ctes={**NB, "tr": f"SELECT *, {O.TRUE_RANGE} AS tr FROM nb", **macd_ctes("tr"), **O.rma("atr", 11, "tr", "tr", 1),
             **O.ema("ema_8", 8), **O.ema("ema_29", 29), **O.ema("ema_31", 31),
             "j": "SELECT *, prev_close - atr * 1.5 AS long_atr_support, prev_close + atr * 1.5 AS short_atr_resistance FROM ("
                  + O.joined("macd_all", "atr", "ema_8", "ema_29", "ema_31") + ")"},
       sql="""SELECT *, CASE WHEN ema_8 < ema_29 AND ema_29 < ema_31 AND close < ema_8 AND close < short_atr_resistance AND macd_hist < 0 THEN -1
WHEN ema_8 > ema_29 AND ema_29 > ema_31 AND close > ema_8 AND close > long_atr_support AND macd_hist > 0 THEN 1 ELSE 0 END AS signal FROM j""")
def g07(view):
    return G.SmugPlug().calculate(view("bars_1h"))


@query("g08_supertrend", K + "supertrend:6 percentage_distance:6 signal:i", "bars_1h", ctes={**NB, **supertrend_ctes(20, 2.0)},
       sql="""SELECT *, CASE WHEN supertrend_way = -1 AND percentage_distance < 0.5 THEN -1 WHEN supertrend_way = 1 AND percentage_distance < 0.5 THEN 1
ELSE 0 END AS signal FROM (SELECT *, abs(close - supertrend) / nullif(close, 0) AS percentage_distance FROM st_out)""")
def g08(view):
    return G.SuperTrend(20, 2.0, 0.5).calculate(view("bars_1h"))


TRIPLE = {**NB, **O.ema("ema_8", 8), **O.ema("ema_29", 29), **O.ema("ema_31", 31),
          "triple": "SELECT *, CASE WHEN ema_8 < ema_29 AND ema_29 < ema_31 THEN -1 WHEN ema_8 > ema_29 AND ema_29 > ema_31 THEN 1 ELSE 0 END AS signal FROM ("
                    + O.joined("nb", "ema_8", "ema_29", "ema_31") + ")"}


@query("g09_triple_ema", K + "ema_8:6 ema_29:6 ema_31:6 signal:i", "bars_1h", ctes=TRIPLE, sql="SELECT * FROM triple")
def g09(view):
    return G.TripleEma().calculate(view("bars_1h"))


@query("g09_last_signal", K + "close:6 signal:i", "bars_1h", ctes=TRIPLE,
       sql="SELECT * FROM triple QUALIFY row_number() OVER (PARTITION BY connector, trading_pair ORDER BY ts DESC) = 1")
def g09_last(view):
    return G.last_signals(G.TripleEma().calculate(view("bars_1h")))


POSITIONS = """SELECT o_orderkey AS executor_id, 'sim' AS connector, CASE o_orderkey % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'signup'
WHEN 3 THEN 'error' ELSE 'purchase' END AS trading_pair, CASE WHEN o_orderkey % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side,
o_orderstatus AS status, CASE WHEN o_orderkey % 3 = 0 THEN 'STOP_LOSS' ELSE 'TAKE_PROFIT' END AS close_type, o_orderdate AS close_ts FROM orders"""


def positions(view):
    k = F.col("o_orderkey")
    m = k % 5
    return view("orders").select(
        k.alias("executor_id"), F.lit("sim").alias("connector"),
        F.when(m == 0, "click").when(m == 1, "view").when(m == 2, "signup").when(m == 3, "error").otherwise("purchase").alias("trading_pair"),
        F.when(k % 2 == 0, "BUY").otherwise("SELL").alias("side"), F.col("o_orderstatus").alias("status"),
        F.when(k % 3 == 0, "STOP_LOSS").otherwise("TAKE_PROFIT").alias("close_type"), F.col("o_orderdate").alias("close_ts"))


# newest bar with a non-zero signal per market, so that the decision has something to act on
LAST_NONZERO = "SELECT * FROM {} WHERE signal <> 0 QUALIFY row_number() OVER (PARTITION BY connector, trading_pair ORDER BY ts DESC) = 1"


@query("g10_close_opposite", "executor_id:i trading_pair side", "bars_1h",
       ctes={**NB, **fury_ctes(), "pos": POSITIONS, "s": LAST_NONZERO.format("fury")},
       sql="""SELECT p.* FROM pos p JOIN s ON s.connector = p.connector AND s.trading_pair = p.trading_pair
WHERE p.status = 'O' AND p.side = CASE WHEN s.signal = 1 THEN 'SELL' ELSE 'BUY' END""")
def g10(view):
    fury = P.TrendFury(window=20, vwap_window=20).calculate(view("bars_1h"))
    s = G.last_signals(fury.filter(F.col("signal") != 0))
    return G.opposite_positions(s, positions(view).filter(F.col("status") == "O"))


@query("g12_allowed_entries", K + "signal:i can_create", "bars_1h",
       ctes={**BB, "pos": POSITIONS, "s": LAST_NONZERO.format("bbs"),
             "last": """SELECT connector, trading_pair, arg_max(close_type, row(close_ts, executor_id)) AS ct, arg_max(side, row(close_ts, executor_id)) AS sd
FROM pos WHERE status <> 'O' GROUP BY ALL"""},
       sql="""SELECT s.*, NOT (coalesce(ct = 'STOP_LOSS', false) AND sd = CASE WHEN signal > 0 THEN 'BUY' ELSE 'SELL' END) AS can_create
FROM s LEFT JOIN last l ON l.connector = s.connector AND l.trading_pair = s.trading_pair""")
def g12(view):
    bars = G.Bollinger(20).calculate(view("bars_1h")).filter(F.col("signal") != 0)
    return G.allowed_entries(G.last_signals(bars), positions(view).filter(F.col("status") != "O"))


@query("g12_clamped_ladder", LADDER_COLS, "bars_1h", ctes=BB,
       sql=f"""SELECT *, activation_price * 0.2 AS trailing_delta FROM (SELECT *, greatest(0.01, least(0.1, 0.1 * bbb / 200)) AS stop_loss,
greatest(0.005, least(0.2, 0.02 * bbb / 200)) AS activation_price FROM ({LADDER}))""")
def g12_ladder(view):
    return G.dca_ladder(G.Bollinger(20).calculate(view("bars_1h")), 1000.0, stop_loss=0.1, activation=0.02, delta=0.2,
                        stop_bounds=(0.01, 0.1), trailing_bounds=(0.005, 0.2))


@query("g13_pmm", K + "macd:6 spread_multiplier:6 reference_price:6", "bars_1h",
       ctes={**NB, "tr": f"SELECT *, {O.TRUE_RANGE} AS tr FROM nb", **macd_ctes("tr"), **O.rma("atr", 14, "tr", "tr", 1),
             "j": "SELECT *, atr / close AS natr FROM (" + O.joined("macd_all", "atr") + ")",
             "z": """SELECT *, (0.5 * -((macd - avg(macd) OVER g) / nullif(stddev_samp(macd) OVER g, 0)) + 0.5 * CASE WHEN macd_hist > 0 THEN 1 ELSE -1 END)
 * natr / 2 AS shift FROM j WINDOW g AS (PARTITION BY connector, trading_pair)""",
             "m": "SELECT connector, trading_pair, arg_max(shift, ts) AS last_shift FROM z GROUP BY ALL"},
       sql="""SELECT z.*, natr AS spread_multiplier, close * (1 + last_shift) AS reference_price FROM z
JOIN m ON m.connector = z.connector AND m.trading_pair = z.trading_pair""")
def g13(view):
    return G.PmmDynamic().calculate(view("bars_1h"))


@query("g14_maker_ladder", "connector trading_pair ts side level:i level_price:6 amount:6 amount_quote:4", "bars_1h",
       sql="""SELECT b.*, side, level, close * factor AS level_price, 10.0 * w / 1.5 AS amount, 10.0 * w / 1.5 * close * factor AS amount_quote FROM bars_1h b
JOIN (VALUES ('BUY', 0, 0.99, 0.1), ('BUY', 1, 0.98, 0.2), ('BUY', 2, 0.96, 0.4), ('BUY', 3, 0.92, 0.8),
('SELL', 0, 1.01, 0.1), ('SELL', 1, 1.02, 0.2), ('SELL', 2, 1.04, 0.4), ('SELL', 3, 1.08, 0.8)) l(side, level, factor, w) ON true""")
def g14(view):
    return Gr.maker_ladder(view("bars_1h").select(*SERIES, "ts", F.col("close").alias("price")), 10.0)


@query("g14_refresh", "executor_id:i level:i", sql="""SELECT o_orderkey AS executor_id, o_orderkey % 4 AS level FROM orders
WHERE o_orderstatus <> 'F' AND o_orderstatus <> 'P' AND (date_diff('second', o_orderdate, TIMESTAMP '2001-12-01') > 86400 * 1500
OR (o_orderkey % 4 = 0 AND date_diff('second', o_orderdate, TIMESTAMP '2001-12-01') > 86400 * 1000))""")
def g14_refresh(view):
    e = view("orders").select(F.col("o_orderkey").alias("executor_id"), (F.col("o_orderkey") % 4).alias("level"),
                              (F.col("o_orderstatus") != "F").alias("is_active"), (F.col("o_orderstatus") == "P").alias("is_trading"),
                              F.col("o_orderdate").alias("created_at"))
    return Gr.executors_to_refresh(e, F.lit("2001-12-01 00:00:00").cast("timestamp_ntz"), 86400 * 1500, 86400 * 1000)


RANGES_SQL = """SELECT o_orderkey AS grid_id, concat('R', o_orderkey % 3) AS range_id, o_orderkey % 7 <> 0 AS active,
CASE WHEN o_orderkey % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, 100 * (1 - 1e-2 * (o_orderkey % 4)) AS start_price,
100 * (1 + 5e-3 * (1 + o_orderkey % 5)) AS end_price, o_totalprice / 1000 AS total_amount, 1e2 AS mid_price,
1e-2 AS min_price_increment, 1e1 AS min_amount FROM orders"""


def ranges(view):
    k = F.col("o_orderkey")
    return view("orders").select(
        k.alias("grid_id"), F.concat(F.lit("R"), k % 3).alias("range_id"), (k % 7 != 0).alias("active"),
        F.when(k % 2 == 0, "BUY").otherwise("SELL").alias("side"), (100 * (1 - 0.01 * (k % 4))).alias("start_price"),
        (100 * (1 + 0.005 * (1 + k % 5))).alias("end_price"), (F.col("o_totalprice") / 1000).alias("total_amount"),
        F.lit(100.0).alias("mid_price"), F.lit(0.01).alias("min_price_increment"), F.lit(10.0).alias("min_amount"))


LEVELS_CTES = {
    "ranges": RANGES_SQL,
    "n": """SELECT *, CAST(floor(least((end_price - start_price) / greatest(min_price_increment, 1e-3 * mid_price), total_amount / min_amount) ) AS BIGINT) AS n_levels
FROM ranges WHERE active""",
    "levels": """SELECT *, concat(range_id, '_P', level) AS level_id, (end_price - start_price) / end_price / n_levels AS step,
round(start_price + (end_price - start_price) * coalesce(level / nullif(n_levels - 1.0, 0), 0), 9) AS price, total_amount / n_levels / mid_price AS amount
FROM (SELECT *, unnest(range(n_levels)) AS level FROM n WHERE n_levels > 0)""",
    "orders_now": """SELECT *, CASE WHEN (side = 'BUY' AND price > mid_price) OR (side = 'SELL' AND price < mid_price) THEN mid_price ELSE price END AS entry_price,
CASE WHEN (side = 'BUY' AND price > mid_price) OR (side = 'SELL' AND price < mid_price) THEN greatest(step * 2, abs(price - mid_price) / mid_price + step)
ELSE step END AS take_profit FROM levels WHERE (side = 'BUY' AND price >= mid_price * (1 - 1e-2)) OR (side = 'SELL' AND price <= mid_price * (1 + 1e-2))""",
}


@query("g15_grid_levels", "grid_id:i level_id side n_levels:i price:6 amount:6 step:8", ctes=LEVELS_CTES, sql="SELECT * FROM levels")
def g15_levels(view):
    return Gr.grid_levels(ranges(view))


@query("g15_grid_orders", "grid_id:i level_id entry_price:6 take_profit:8 rank:i", ctes=LEVELS_CTES,
       sql="""SELECT *, row_number() OVER (PARTITION BY grid_id ORDER BY round(abs(price - mid_price), 9), level_id) AS rank FROM orders_now
WHERE NOT (grid_id % 2 = 0 AND level = 1) QUALIFY rank <= 5""")
def g15_orders(view):
    r = ranges(view)
    open_now = Gr.grid_levels(r).filter((F.col("grid_id") % 2 == 0) & (F.col("level") == 1)).select("grid_id", "level_id")
    return Gr.grid_orders(r, open_now)


@query("g16_grid_stops", "grid_id:i executor_id:i", ctes={"ranges": RANGES_SQL},
       sql="""SELECT DISTINCT grid_id, grid_id * 10 AS executor_id FROM (SELECT *, start_price AS entry_price FROM ranges)
WHERE NOT active OR (grid_id % 5 <> 0 AND ((side = 'BUY' AND entry_price <= mid_price * (1 - 1e-2)) OR (side = 'SELL' AND entry_price >= mid_price * (1 + 1e-2))))""")
def g16(view):
    r = ranges(view)
    e = r.select("grid_id", "range_id", "side", (F.col("grid_id") * 10).alias("executor_id"), F.lit(True).alias("is_active"),
                 (F.col("grid_id") % 5 == 0).alias("is_trading"), F.col("start_price").alias("entry_price"))
    return Gr.grid_stops(e, r, r.select("grid_id", "mid_price"))


@query("g17_trend_grids", "trading_pair config_id side:i start_price:6 end_price:6 limit_price:6", "bars_1d",
       ctes={"sig": """SELECT trading_pair, CASE WHEN arg_max(close, ts) > avg(close) THEN 0.8 ELSE -0.8 END AS value, arg_max(close, ts) AS price,
(max(high) - min(low)) / arg_max(close, ts) AS range_pct FROM bars_1d GROUP BY trading_pair"""},
       sql="""SELECT *, concat('tf_', lower(trading_pair), CASE WHEN value > 0 THEN '_long' ELSE '_short' END, '_20011201_0000') AS config_id,
CASE WHEN value > 0 THEN 1 ELSE 2 END AS side, price * (1 + CASE WHEN value > 0 THEN -0.25 ELSE -0.75 END * range_pct) AS start_price,
price * (1 + CASE WHEN value > 0 THEN 0.75 ELSE 0.25 END * range_pct) AS end_price,
price * (1 + CASE WHEN value > 0 THEN -0.35 ELSE 0.35 END * range_pct) AS limit_price FROM sig""")
def g17(view):
    f = view("bars_1d").groupBy("trading_pair").agg(
        F.max("ts").alias("ts"), F.max_by("close", "ts").alias("price"), F.avg("close").alias("_avg"),
        ((F.max("high") - F.min("low")) / F.max_by("close", "ts")).alias("range_pct"))
    s = f.select("trading_pair", F.when(F.col("price") > F.col("_avg"), 0.8).otherwise(-0.8).alias("value"))
    return Gr.trend_grids(s, f, F.lit("20011201_0000"))


@query("f03_level_windows", "trading_pair window:i start_time end_time close:4 resistance:5 support:5 levels:i", "bars_1h")
def f03(view):
    from tickloom.operators.peaks import level_windows
    w = level_windows(view("bars_1h"))
    return w.select("trading_pair", "window", "start_time", "end_time", "close", F.array_min("high_clusters").alias("resistance"),
                    F.array_max("low_clusters").alias("support"), (F.size("high_clusters") + F.size("low_clusters")).alias("levels"))


@query("f11_level_signal", "ts signal_name trading_pair category value:5", "bars_1h")
def f11_levels(view):
    from tickloom.operators.peaks import level_signal, level_windows, nearest_levels
    b = view("bars_1h")
    return level_signal(nearest_levels(level_windows(b), b), 0.5)


def peak_ctes(share: float, distance: int) -> dict[str, str]:
    """Local maxima of highs and mirrored lows, thinned from the highest down one by one, then by prominence."""
    side = "connector, trading_pair, kind"
    same = " AND ".join(f"a.{c} = b.{c}" for c in side.split(", "))
    return {
        "nb": O.numbered(),
        "sides": "SELECT connector, trading_pair, 'high' AS kind, i, high AS x FROM nb UNION ALL SELECT connector, trading_pair, 'low', i, -low FROM nb",
        "marked": f"SELECT *, CASE WHEN x = lag(x) OVER (PARTITION BY {side} ORDER BY i) THEN 0 ELSE 1 END AS fresh FROM sides",
        "flat": f"SELECT *, sum(fresh) OVER (PARTITION BY {side} ORDER BY i) AS run FROM marked",
        "runs": f"SELECT {side}, run, any_value(x) AS x, (min(i) + max(i)) // 2 AS p FROM flat GROUP BY {side}, run",
        "tops": f"""SELECT *, row_number() OVER (PARTITION BY {side} ORDER BY x DESC, p DESC) AS k FROM (SELECT * FROM runs
QUALIFY x > lag(x) OVER (PARTITION BY {side} ORDER BY run) AND x > lead(x) OVER (PARTITION BY {side} ORDER BY run))""",
        "thin": f"""SELECT {side}, CAST(1 AS BIGINT) AS k, [p] AS kept FROM tops WHERE k = 1
UNION ALL SELECT a.connector, a.trading_pair, a.kind, b.k, CASE WHEN len([q FOR q IN kept IF abs(q - b.p) < {distance}]) = 0
THEN list_append(kept, b.p) ELSE kept END FROM thin a JOIN tops b ON {same} AND b.k = a.k + 1""",
        "kept": f"SELECT {side}, unnest(arg_max(kept, k)) AS p FROM thin GROUP BY {side}",
        "tall": f"""SELECT a.*, t.x, n.nominal FROM kept a JOIN tops t ON a.connector = t.connector AND a.trading_pair = t.trading_pair AND a.kind = t.kind
AND a.p = t.p JOIN (SELECT connector, trading_pair, (max(high) - min(low)) * {share} AS nominal FROM nb GROUP BY ALL) n
ON a.connector = n.connector AND a.trading_pair = n.trading_pair""",
        "walls": f"""SELECT a.connector, a.trading_pair, a.kind, a.p, a.x, min(b.i) FILTER (WHERE b.i > p AND b.x > a.x) AS rise_r, max(b.i) FILTER (WHERE b.i < p AND b.x > a.x) AS rise_l,
min(b.i) FILTER (WHERE b.i > p AND b.x <= a.x - nominal) AS fall_r, max(b.i) FILTER (WHERE b.i < p AND b.x <= a.x - nominal) AS fall_l
FROM tall a JOIN sides b ON {same} GROUP BY ALL""",
        "peaks": """SELECT w.connector, w.trading_pair, w.kind, w.p, n.ts, CASE WHEN kind = 'low' THEN -x ELSE x END AS price FROM walls w JOIN nb n ON n.connector = w.connector
AND n.trading_pair = w.trading_pair AND n.i = w.p WHERE fall_r IS NOT NULL AND fall_l IS NOT NULL AND coalesce(fall_r < rise_r, TRUE) AND coalesce(fall_l > rise_l, TRUE)""",
    }


@query("f04_series_peaks", "trading_pair kind ts price:4", "bars_1h", ctes=peak_ctes(0.05, 20), sql="SELECT * FROM peaks")
def f04(view):
    from tickloom.operators.peaks import series_peaks
    return series_peaks(view("bars_1h"), 0.05, 20)


@query("j09_earlier_peak", K + "target:4", "bars_1h", ctes={
    "nb": O.numbered(),
    "pk": f"""SELECT connector, trading_pair, i, close AS price FROM (SELECT *, max(close) OVER f AS m FROM nb
WINDOW f AS (PARTITION BY connector, trading_pair ORDER BY ts ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)) WHERE close = m""",
    "hit": """SELECT a.connector, a.trading_pair, a.i, arg_max(p.price, p.i) AS price FROM nb a JOIN pk p ON p.connector = a.connector
AND p.trading_pair = a.trading_pair AND p.i < a.i AND p.price > a.close GROUP BY ALL"""},
       sql="SELECT a.*, coalesce(h.price, a.close * 1.05) AS target FROM nb a LEFT JOIN hit h ON h.connector = a.connector AND h.trading_pair = a.trading_pair AND h.i = a.i")
def j09(view):
    from tickloom.operators import rolling as R
    from tickloom.operators.layout import POS, own_rows, segmented
    from tickloom.operators.peaks import earlier_peak
    df, p = segmented(view("bars_1h"), 7, ahead=7)
    df = own_rows(df.withColumn("_top", R.pivot_flags("close", 7, 7, p)[0]))
    peaks = df.filter("_top").select(*SERIES, POS, F.col("close").alias("price"))
    return earlier_peak(df, peaks, "target", True, F.col("close") * 1.05)


def xgrid_ctes() -> dict[str, str]:
    """Averages, channels and both targets: the newest peak if it lies beyond the bar, else an older one beyond the close, else 5 %."""
    key = lambda a, b: f"{a}.connector = {b}.connector AND {a}.trading_pair = {b}.trading_pair"
    ctes = {**peak_ctes(0.05, 20), "tr": f"SELECT *, {O.TRUE_RANGE} AS tr FROM nb", **O.rma("atr_100", 100, "tr", "tr", 1),
            **O.ema("ema_8", 8, "tr"), **O.ema("ema_29", 29, "tr"), **O.ema("ema_31", 31, "tr"),
            "ind": f"""SELECT *, 100 * atr_100 / nullif(close, 0) AS natr, CASE WHEN i >= 49 THEN min(low) OVER {O.w(50)} END AS sl_long,
CASE WHEN i >= 49 THEN max(high) OVER {O.w(50)} END AS sl_short, CASE WHEN ema_8 < ema_29 AND ema_29 < ema_31 AND ema_8 < ema_31 THEN -1
WHEN ema_8 > ema_29 AND ema_29 > ema_31 AND ema_8 > ema_31 THEN 1 ELSE 0 END AS signal FROM ({O.joined('tr', 'ema_8', 'ema_29', 'ema_31', 'atr_100')})"""}
    for kind, name, sign, edge in (("high", "long", ">", "high"), ("low", "short", "<", "low")):
        ctes[f"seen_{name}"] = f"""SELECT b.connector, b.trading_pair, b.i, arg_max(p.price, p.p) AS newest,
arg_max(p.price, p.p) FILTER (WHERE p.p < b.i AND p.price {sign} b.close) AS older FROM nb b JOIN peaks p ON {key('b', 'p')} AND p.kind = '{kind}' AND p.p <= b.i GROUP BY ALL"""
    ctes["xgrid"] = f"""SELECT b.*, CASE WHEN l.newest > high THEN l.newest ELSE coalesce(l.older, close * 1.05) END AS tp_long,
CASE WHEN s.newest < low THEN s.newest ELSE coalesce(s.older, close * 0.95) END AS tp_short, sl_long * (1 + 2.0 * natr) AS limit_long
FROM ind b LEFT JOIN seen_long l ON {key('b', 'l')} AND l.i = b.i LEFT JOIN seen_short s ON {key('b', 's')} AND s.i = b.i"""
    ctes["targets"] = """SELECT *, abs(CASE WHEN signal > 0 THEN tp_long ELSE tp_short END - close) / nullif(close, 0) AS tp_pct,
abs(CASE WHEN signal > 0 THEN sl_long ELSE sl_short END - close) / nullif(close, 0) AS sl_pct FROM xgrid"""
    return ctes


@query("g11_xgrid", K + "signal:i tp_long:4 tp_short:4 sl_long:4 sl_short:4 limit_long:4 tp_pct:6 sl_pct:6 trailing_delta:6", "bars_1h",
       ctes=xgrid_ctes(), sql="SELECT *, tp_pct * 0.5 * 0.2 AS trailing_delta FROM targets")
def g11(view):
    return G.xgrid_targets(G.XGrid(distance=20).calculate(view("bars_1h")))
