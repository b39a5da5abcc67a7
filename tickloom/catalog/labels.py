"""B*: labels, backtest analytics, sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.catalog import oracle as O
from tickloom.catalog.ingest import as_of
from tickloom.catalog.recursive import NB
from tickloom.catalog.registry import query
from tickloom.catalog.signals import BB
from tickloom.operators import labels as L
from tickloom.plans import backtest as B
from tickloom.plans.signals import Bollinger

K = "connector trading_pair ts "


@query("b01_target", K + "target:7", "bars_1h", ctes=NB,
       sql=f"SELECT *, stddev_samp(close) OVER {O.w(50)} / nullif(close, 0) AS target FROM nb QUALIFY i >= 49")
def b01(view):
    return L.volatility_target(view("bars_1h"), 50)


def barrier_ctes(src: str, tp: float, sl: float, hours: int, span: int = 50) -> dict[str, str]:
    return {
        "tg": f"SELECT *, signal AS side, stddev_samp(close) OVER {O.w(span)} / nullif(close, 0) AS target FROM {src} QUALIFY i >= {span - 1}",
        "path": f"""SELECT e.connector, e.trading_pair, e.ts, b.ts AS bt, b.close AS bc, (b.close / e.close - 1) * e.side AS r, e.target FROM tg e JOIN tg b
ON b.connector = e.connector AND b.trading_pair = e.trading_pair AND b.ts BETWEEN e.ts AND e.ts + INTERVAL {hours} HOUR WHERE e.side <> 0""",
        "touch": f"""SELECT connector, trading_pair, ts, min(bt) FILTER (WHERE r > {tp} * target) AS take_profit_time, min(bt) FILTER (WHERE r < -{sl} * target) AS stop_loss_time
FROM path GROUP BY ALL""",
        "bar": f"""SELECT g.*, ts + INTERVAL {hours} HOUR AS tl, take_profit_time, stop_loss_time, least(ts + INTERVAL {hours} HOUR, take_profit_time, stop_loss_time) AS close_time
FROM tg g LEFT JOIN touch t USING (connector, trading_pair, ts)""",
        "barrier": """SELECT b.*, CASE WHEN close_time = take_profit_time THEN 1 WHEN close_time = stop_loss_time THEN -1 ELSE 0 END AS close_type,
(p.pc / b.close - 1) * side AS ret FROM bar b ASOF JOIN (SELECT connector, trading_pair, ts AS pts, close AS pc FROM tg) p
ON p.connector = b.connector AND p.trading_pair = b.trading_pair AND b.close_time >= p.pts""",
    }


BAR = {**BB, **barrier_ctes("bbs", 1.0, 1.0, 24)}


def barriers(view):
    bars = Bollinger(20).calculate(view("bars_1h")).withColumn("side", F.col("signal"))
    return L.triple_barrier(bars, 1.0, 1.0, 24 * 3600, 50)


@query("b02_barrier", K + "side:i take_profit_time stop_loss_time close_time close_type:i", "bars_1h", ctes=BAR, sql="SELECT * FROM barrier")
def b02(view):
    return barriers(view)


@query("b03_bins", K + "ret:7 real_class:i tp:5 sl:5", "bars_1h", ctes=BAR,
       sql="SELECT *, sign(ret - 0.0006) AS real_class, close * (1 + target * side) AS tp, close * (1 - target * side) AS sl FROM barrier")
def b03(view):
    return barriers(view)


TRADES = {**BAR, "trades_t": """SELECT trading_pair, ts AS trade_id, close_time AS ts_close, side, (ret - 0.0006) * 1000 AS pnl_quote, 1000.0 AS amount,
CASE close_type WHEN 1 THEN 'TAKE_PROFIT' WHEN -1 THEN 'STOP_LOSS' ELSE 'TIME_LIMIT' END AS close_type FROM barrier WHERE side <> 0"""}


def summary_ctes(trades: str, keys: str) -> dict[str, str]:
    return {
        "eq": f"SELECT *, sum(pnl_quote) OVER (PARTITION BY {keys} ORDER BY ts_close, trade_id) AS equity, sum(amount) OVER (PARTITION BY {keys}) AS tv FROM {trades}",
        "dd": f"SELECT *, max(equity) OVER (PARTITION BY {keys} ORDER BY ts_close, trade_id) AS peak FROM eq",
        "summary": f"""SELECT {keys}, sum(pnl_quote) AS net_pnl_quote, sum(pnl_quote) / sum(amount) AS net_pnl, min(equity - peak) AS max_drawdown_usd,
min((equity - peak) / (tv + peak)) AS max_drawdown_pct, sum(amount) AS total_volume,
avg(pnl_quote / amount) / nullif(stddev_samp(pnl_quote / amount), 0) * sqrt(count(*)) AS sharpe_ratio,
sum(pnl_quote) FILTER (WHERE pnl_quote > 0) / abs(sum(pnl_quote) FILTER (WHERE pnl_quote <= 0)) AS profit_factor, count(*) AS total_executors,
count_if(side > 0 AND pnl_quote > 0) / nullif(count_if(side > 0), 0) AS accuracy_long, count_if(side < 0 AND pnl_quote > 0) / nullif(count_if(side < 0), 0) AS accuracy_short,
count_if(close_type = 'TAKE_PROFIT') AS take_profit, count_if(close_type = 'STOP_LOSS') AS stop_loss, count_if(close_type = 'TIME_LIMIT') AS time_limit FROM dd GROUP BY {keys}""",
    }


SUM_COLS = ("net_pnl_quote:4 net_pnl:7 max_drawdown_usd:4 max_drawdown_pct:7 total_volume:2 sharpe_ratio:5 profit_factor:5 total_executors:i accuracy_long:6 "
            "accuracy_short:6 take_profit:i stop_loss:i time_limit:i")


def barrier_trades(view):
    names = F.create_map(*[F.lit(x) for kv in B.CLOSE_TYPES.items() for x in kv])
    return barriers(view).filter(F.col("side") != 0).select(
        "trading_pair", F.col("ts").alias("trade_id"), F.col("close_time").alias("ts_close"), "side",
        ((F.col("ret") - 0.0006) * 1000).alias("pnl_quote"), F.lit(1000.0).alias("amount"), names[F.col("close_type")].alias("close_type"))


@query("b04_summary", "trading_pair " + SUM_COLS, "bars_1h", ctes={**TRADES, **summary_ctes("trades_t", "trading_pair")}, sql="SELECT * FROM summary")
def b04(view):
    return B.backtest_summary(barrier_trades(view), ["trading_pair"])


@query("b05_equity", "trading_pair trade_id ts_close equity:4 drawdown:4 profitable", "bars_1h", ctes={**TRADES, **summary_ctes("trades_t", "trading_pair")},
       sql="SELECT *, equity - peak AS drawdown, pnl_quote > 0 AS profitable FROM dd")
def b05(view):
    return B.equity_curve(barrier_trades(view), ["trading_pair"])


@query("b06_executor_sides", "executor_id:i side net_pnl_quote:4",
       sql="SELECT o_orderkey AS executor_id, CASE WHEN o_orderkey % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, (o_totalprice - 250000) / 1000 AS net_pnl_quote FROM orders")
def b06(view):
    k = F.col("o_orderkey")
    e = view("orders").select(k.alias("executor_id"), ((F.col("o_totalprice") - 250000) / 1000).alias("net_pnl_quote"),
                              F.struct(F.when(k % 2 == 0, "BUY").otherwise("SELL").alias("side"), k.alias("level")).alias("config"))
    return B.executor_sides(e)


@query("b07_live_versus_backtest", "source trading_pair net_pnl_quote:4 total_executors:i sharpe_ratio:5", "bars_1h", ctes={
    **TRADES, "live": "SELECT * FROM trades_t WHERE ts_close BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20'",
    "per": "SELECT trading_pair, min(ts_close) - INTERVAL 1 HOUR AS a, max(ts_close) + INTERVAL 1 HOUR AS b FROM live GROUP BY 1",
    "cut": "SELECT t.* FROM trades_t t JOIN per ON per.trading_pair = t.trading_pair AND ts_close BETWEEN a AND b"},
       sql=" UNION ALL ".join(f"""SELECT '{n}' AS source, trading_pair, sum(pnl_quote) AS net_pnl_quote, count(*) AS total_executors,
avg(pnl_quote / amount) / nullif(stddev_samp(pnl_quote / amount), 0) * sqrt(count(*)) AS sharpe_ratio FROM {t} GROUP BY trading_pair""" for n, t in (("live", "live"), ("backtest", "cut"))))
def b07(view):
    t = barrier_trades(view)
    live = t.filter(F.col("ts_close").between(as_of("2024-01-10 00:00:00"), as_of("2024-01-20 00:00:00")))
    return B.live_versus_backtest(live, t, ["trading_pair"])


# 50 runs per market
EMA_TRIALS = B.parameter_grid(B.TripleEmaTrial, short=(8,), medium=(20, 29), long=(50,), take_profit=(0.1, 0.2, 0.3, 0.4, 0.5),
                              stop_loss=(0.1, 0.2, 0.3, 0.4, 0.5))
SWEEP = {
    **NB, **O.ema("ema_8", 8), **O.ema("ema_20", 20), **O.ema("ema_29", 29), **O.ema("ema_50", 50),
    "ind": O.joined("nb", "ema_8", "ema_20", "ema_29", "ema_50"),
    "ev": " UNION ALL ".join(
        f"""SELECT *, {t.trial} AS trial, {t.take_profit!r} AS tp, {t.stop_loss!r} AS sl, CASE WHEN ema_8 < ema_{t.medium} AND ema_{t.medium} < ema_50 THEN -1
WHEN ema_8 > ema_{t.medium} AND ema_{t.medium} > ema_50 THEN 1 ELSE 0 END AS side FROM ind""" for t in EMA_TRIALS),
    "path": """SELECT e.trial, e.trading_pair, e.ts, e.side, b.ts AS bt, b.close AS bc, (b.close / e.close - 1) * e.side AS r, e.tp, e.sl FROM ev e JOIN nb b
ON b.trading_pair = e.trading_pair AND b.ts BETWEEN e.ts AND e.ts + INTERVAL 12 HOUR WHERE e.side <> 0""",
    "touch": """SELECT trial, trading_pair, ts, any_value(side) AS side, min(bt) FILTER (WHERE r > tp) AS t1, min(bt) FILTER (WHERE r < -sl) AS t2,
arg_min(r, bt) FILTER (WHERE r > tp) AS r1, arg_min(r, bt) FILTER (WHERE r < -sl) AS r2, arg_max(r, bt) AS r3 FROM path GROUP BY trial, trading_pair, ts""",
    "tr": """SELECT trial, trading_pair, ts AS trade_id, side, least(ts + INTERVAL 12 HOUR, t1, t2) AS ts_close, 1000.0 AS amount,
((CASE WHEN t1 = least(ts + INTERVAL 12 HOUR, t1, t2) THEN r1 WHEN t2 = least(ts + INTERVAL 12 HOUR, t1, t2) THEN r2 ELSE r3 END) - 0.0006) * 1000 AS pnl_quote,
CASE WHEN t1 = least(ts + INTERVAL 12 HOUR, t1, t2) THEN 'TAKE_PROFIT' WHEN t2 = least(ts + INTERVAL 12 HOUR, t1, t2) THEN 'STOP_LOSS' ELSE 'TIME_LIMIT' END AS close_type FROM touch""",
    **summary_ctes("tr", "trial, trading_pair"),
}


@query("b08_sweep", "trial:i trading_pair " + SUM_COLS, "bars_1h", ctes=SWEEP, sql="SELECT * FROM summary")
def b08(view):
    b = view("bars_1h")
    return B.sweep(B.triple_ema_signals(b, EMA_TRIALS), b, 12 * 3600)


@query("b10_studies", "study trial:i value:5", "bars_1h", ctes=SWEEP, sql="SELECT concat('ema_2024-01-31_', trading_pair) AS study, trial, sharpe_ratio AS value FROM summary")
def b10(view):
    b = view("bars_1h")
    s = B.objective(B.sweep(B.triple_ema_signals(b, EMA_TRIALS), b, 12 * 3600))
    return B.study_names(s, "ema", as_of())


BB_TRIALS = B.parameter_sample(B.MacdBollingerTrial, 50, 42, fast=(9, 19), slow=(21, 41), signal=(10, 20), length=(20, 30, 50), width=(1.5, 2.0),
                               take_profit=(0.3, 0.5), stop_loss=(0.2, 0.3))


def config_list_ctes() -> dict[str, str]:
    """Every distinct average, MACD and band once, then one branch per trial."""
    macds = sorted({(t.fast, t.slow, t.signal) for t in BB_TRIALS})
    bands = sorted({(t.length, t.width) for t in BB_TRIALS})
    lengths = sorted({n for f, s, _ in macds for n in (f, s)})
    ctes = {**NB}
    for n in lengths:
        ctes |= O.ema(f"ema_{n}", n)
    columns = [f"ema_{f} - ema_{s} AS line_{i}" for i, (f, s, _) in enumerate(macds)]
    columns += [f"CASE WHEN i >= {n - 1} THEN (close - avg(close) OVER {O.w(n)} + {k} * stddev_pop(close) OVER {O.w(n)}) "
                f"/ nullif({2 * k} * stddev_pop(close) OVER {O.w(n)}, 0) END AS bbp_{i}" for i, (n, k) in enumerate(bands)]
    ctes["lines"] = f"SELECT *, {', '.join(columns)} FROM ({O.joined('nb', *[f'ema_{n}' for n in lengths])})"
    for i, (_, slow, signal) in enumerate(macds):
        ctes |= O.ema(f"sig_{i}", signal, "lines", f"line_{i}", slow - 1)
    ctes["ind"] = O.joined("lines", *[f"sig_{i}" for i in range(len(macds))])
    branches = []
    for t in BB_TRIALS:
        i, bbp = macds.index((t.fast, t.slow, t.signal)), f"bbp_{bands.index((t.length, t.width))}"
        hist = f"line_{i} - sig_{i}"
        branches.append(f"""SELECT connector, trading_pair, ts, close, {t.trial} AS trial, {t.take_profit!r} AS tp, {t.stop_loss!r} AS sl,
CASE WHEN {bbp} > 0.8 AND {hist} < 0 AND line_{i} > 0 THEN -1 WHEN {bbp} < 0.2 AND {hist} > 0 AND line_{i} < 0 THEN 1 ELSE 0 END AS side FROM ind""")
    return {**ctes, "ev": " UNION ALL ".join(branches), **{k: SWEEP[k] for k in ("path", "touch", "tr", "eq", "dd", "summary")}}


@query("b09_macd_bb_config_list", "trial:i trading_pair net_pnl:6 sharpe_ratio:5 total_executors:i", "bars_1h", ctes=config_list_ctes(), sql="SELECT * FROM summary")
def b09(view):
    b = view("bars_1h")
    return B.sweep(B.macd_bollinger_signals(b, BB_TRIALS), b, 12 * 3600)
