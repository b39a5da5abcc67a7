"""P*, A16-A18: ledger, portfolio, control decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.catalog.ingest import as_of
from tickloom.catalog.joins import SIGNAL_MAP, SIGNALS, signals
from tickloom.catalog.registry import query
from tickloom.catalog.rolling import FILL_KEY, FILL_ORDER, FILL_W
from tickloom.plans import portfolio as Po
from tickloom.sources.fixtures import ORDERS_AS_OF


@query("p01_fill_ledger", "config_file_path symbol ts order_id fill_no tie amount:2 cum_fees_in_quote:3 cum_net_amount:3 unrealized_trade_pnl:1 inventory_cost:1 "
       "realized_trade_pnl:1 net_realized_pnl:1 realized_pnl:2 gross_pnl:2 trade_fee:3 quote_volume:2", "fills",
       ctes={"a": "SELECT *, CASE WHEN trade_type = 'BUY' THEN amount ELSE -amount END AS net FROM fills",
             "b": f"""SELECT *, sum(trade_fee_in_quote) OVER {FILL_W} AS cum_fees_in_quote, sum(net) OVER {FILL_W} AS cum_net_amount,
-sum(net * price) OVER {FILL_W} AS unrealized_trade_pnl, price * amount AS quote_volume FROM a""",
             "c": """SELECT *, cum_net_amount * price AS inventory_cost, unrealized_trade_pnl + cum_net_amount * price AS realized_trade_pnl,
unrealized_trade_pnl + cum_net_amount * price - cum_fees_in_quote AS net_realized_pnl FROM b"""},
       sql=f"""SELECT *, net_realized_pnl - lag(net_realized_pnl) OVER w AS realized_pnl, realized_trade_pnl - lag(realized_trade_pnl) OVER w AS gross_pnl,
cum_fees_in_quote - lag(cum_fees_in_quote) OVER w AS trade_fee FROM c WINDOW w AS (PARTITION BY {FILL_KEY} ORDER BY {', '.join(FILL_ORDER)})""")
def p01(view):
    return Po.fill_ledger(view("fills"), FILL_ORDER)


@query("p02_stop_rule", "controller_id:i bot_name stop_reason", "bot_performance", ctes={
    "a": f"SELECT *, global_pnl_pct / 100 AS pnl, date_diff('second', started_at, TIMESTAMP '{ORDERS_AS_OF}') AS age FROM bot_performance"},
       sql="""SELECT * FROM (SELECT *, CASE WHEN pnl >= 5e-2 THEN 'take_profit' WHEN pnl <= -8e-2 THEN 'stop_loss' WHEN age >= 86400 * 3000 THEN 'time_limit'
WHEN age BETWEEN 86400 * 1000 AND 86400 * 2000 AND pnl >= 2e-2 THEN 'early_take_profit'
WHEN age BETWEEN 86400 * 1000 AND 86400 * 2000 AND pnl <= -3e-2 THEN 'early_stop_loss' END AS stop_reason FROM a) WHERE stop_reason IS NOT NULL""")
def p02(view):
    return Po.pnl_stops(view("bot_performance"), as_of(ORDERS_AS_OF), 0.08, 0.05, 86400 * 3000, 86400 * 1000, 86400 * 2000, 0.03, 0.02)


CONTROLLERS = f"""SELECT controller_id, bot_name, concat('P', controller_id % 60) AS trading_pair, CASE WHEN controller_id % 2 = 0 THEN 'long' ELSE 'short' END AS direction,
status = 'F' AND controller_id % 3 = 0 AS manual_kill_switch, date_diff('second', started_at, TIMESTAMP '{ORDERS_AS_OF}') / 3600.0 AS runtime_hours, global_pnl_pct AS pnl_pct FROM bot_performance"""


def controllers(view):
    k = F.col("controller_id")
    age = F.unix_micros(as_of(ORDERS_AS_OF).cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))
    return view("bot_performance").select(
        "controller_id", "bot_name", F.concat(F.lit("P"), k % 60).alias("trading_pair"), F.when(k % 2 == 0, "long").otherwise("short").alias("direction"),
        ((F.col("status") == "F") & (k % 3 == 0)).alias("manual_kill_switch"), (age / 3.6e9).alias("runtime_hours"), F.col("global_pnl_pct").alias("pnl_pct"))


DECISIONS = {"s": SIGNALS, "sm": f"SELECT *, CASE WHEN value > 0 THEN 'long' ELSE 'short' END AS signal_direction FROM ({SIGNAL_MAP})", "c": CONTROLLERS,
             "dec": """SELECT *, CASE WHEN manual_kill_switch THEN 'inactive' WHEN runtime_hours < 30000 THEN 'keep'
WHEN signal_direction <> direction OR pnl_pct < -3 THEN 'stop' ELSE 'keep' END AS decision,
CASE WHEN manual_kill_switch THEN 'already stopped' WHEN runtime_hours < 30000 THEN 'within minimum runtime' WHEN signal_direction <> direction THEN 'opposing signal'
WHEN pnl_pct < -3 THEN 'poor pnl' WHEN signal_direction = direction THEN 'matching signal' ELSE 'no signal' END AS reason FROM c LEFT JOIN sm USING (trading_pair)"""}


def decisions(view):
    return Po.keep_or_stop(controllers(view), signals(view), 30000.0)


@query("p03_decision", "controller_id:i trading_pair direction decision reason", ctes=DECISIONS, views="bot_performance", sql="SELECT * FROM dec")
def p03(view):
    return decisions(view)


@query("p04_archive_bots", "bot_name active_controllers:i stopped_controllers:i", "bot_performance", ctes={
    "g": "SELECT concat(bot_name, '-', controller_id % 2000) AS bot_name, status = 'O' AS active FROM bot_performance"},
       sql="SELECT bot_name, count_if(active) AS active_controllers, count_if(NOT active) AS stopped_controllers FROM g GROUP BY 1 HAVING count_if(active) = 0")
def p04(view):
    b = view("bot_performance").select(F.concat_ws("-", "bot_name", F.col("controller_id") % 2000).alias("bot_name"), (F.col("status") == "O").alias("active"))
    return Po.archivable_bots(b)


@query("p05_deploy", "trading_pair direction value:6 position:i", ctes={**DECISIONS,
       "best": """SELECT trading_pair, value, CASE WHEN value > 0 THEN 'long' ELSE 'short' END AS direction FROM sm
QUALIFY row_number() OVER (PARTITION BY value > 0 ORDER BY abs(value) DESC, trading_pair) <= 5"""}, views="bot_performance",
       sql="""SELECT *, row_number() OVER (ORDER BY direction, abs(value) DESC, trading_pair) AS position FROM best b
WHERE NOT EXISTS (SELECT 1 FROM dec d WHERE decision = 'keep' AND d.controller_id % 50 = 0 AND d.trading_pair = b.trading_pair AND d.direction = b.direction)
AND NOT EXISTS (SELECT 1 FROM dec d WHERE decision = 'stop' AND d.controller_id % 75 = 0 AND d.trading_pair = b.trading_pair AND d.direction = b.direction) QUALIFY position <= 7""")
def p05(view):
    d = decisions(view)
    running = d.filter((F.col("decision") == "keep") & (F.col("controller_id") % 50 == 0))
    stopped = d.filter((F.col("decision") == "stop") & (F.col("controller_id") % 75 == 0))
    return Po.new_deployments(Po.signal_map(signals(view)).select("trading_pair", "value"), running, stopped, 7)


@query("p06_min_notional", "rule_id:i min_notional:6", sql="""SELECT p_partkey AS rule_id, CASE WHEN p_size % 2 = 0 THEN p_size / 1000.0 * last_price ELSE p_size * 5 END AS min_notional
FROM part LEFT JOIN (SELECT p_brand AS b, avg(p_retailprice) AS last_price FROM part GROUP BY 1) ON b = p_brand""")
def p06(view):
    p = view("part")
    rules = p.select(F.col("p_partkey").alias("rule_id"), F.col("p_brand").alias("trading_pair"), F.when(F.col("p_size") % 2 == 0, "venue_a").otherwise("venue_b").alias("connector"),
                     (F.col("p_size") / 1000.0).alias("min_base_increment"), (F.col("p_size") * 5).cast("double").alias("min_notional_size"))
    prices = p.groupBy(F.col("p_brand").alias("trading_pair")).agg(F.avg("p_retailprice").alias("last_price"))
    return Po.min_notionals(rules, prices, "venue_a")


@query("p07_candidate_cut", "config_id:i score:4", sql="SELECT o_orderkey AS config_id, o_totalprice AS score FROM orders ORDER BY score DESC, config_id LIMIT 10")
def p07(view):
    return Po.candidate_cut(view("orders").select(F.col("o_orderkey").alias("config_id"), F.col("o_totalprice").alias("score")), 10)


@query("p07_bot_slots", "running:i has_slot", "bot_performance", sql="SELECT count(DISTINCT bot_name) AS running, count(DISTINCT bot_name) < 6 AS has_slot FROM bot_performance WHERE status = 'O'")
def p07_slots(view):
    return Po.bot_slots(view("bot_performance").filter(F.col("status") == "O"), 6)


@query("p08_top_signals", "trading_pair direction intensity:6 rank:i", ctes={"s": SIGNALS},
       sql=f"""SELECT *, abs(value) AS intensity, CASE WHEN value > 0 THEN 'long' ELSE 'short' END AS direction,
row_number() OVER (PARTITION BY value > 0 ORDER BY abs(value) DESC, trading_pair) AS rank FROM ({SIGNAL_MAP}) QUALIFY rank <= 3""")
def p08(view):
    return Po.top_signals(Po.signal_map(signals(view)).select("trading_pair", "value"))


@query("a16_bot_rollup", "bot_name strategies:i pnl:3 volume:1", "bot_performance",
       sql="SELECT bot_name, count(*) AS strategies, sum(global_pnl_quote) AS pnl, sum(volume_traded) AS volume FROM bot_performance GROUP BY 1")
def a16(view):
    return Po.bot_rollup(view("bot_performance"))


@query("a17_winners_losers", "controller_id:i outcome global_pnl_quote:5 rank:i", "bot_performance",
       sql="""SELECT *, CASE WHEN global_pnl_quote > 0 THEN 'winner' ELSE 'loser' END AS outcome,
row_number() OVER (PARTITION BY global_pnl_quote > 0 ORDER BY abs(global_pnl_quote) DESC, controller_id) AS rank FROM bot_performance WHERE global_pnl_quote <> 0""")
def a17(view):
    return Po.winners_and_losers(view("bot_performance"))


@query("a18_portfolio", "exchange token value:2 exchange_total:2 position:i", "balances",
       sql="""SELECT *, row_number() OVER (ORDER BY exchange_total DESC, exchange, value DESC, token) AS position FROM (
SELECT *, sum(value) OVER (PARTITION BY exchange) AS exchange_total FROM balances WHERE units > 0 AND value >= 1)""")
def a18(view):
    return Po.portfolio(view("balances"))
