"""S*: sources, storage and normalisers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.catalog import oracle as O
from tickloom.catalog.ingest import as_of
from tickloom.catalog.registry import query
from tickloom.catalog.signals import BB
from tickloom.plans.signals import Bollinger
from tickloom.sources import lake as L
from tickloom.sources import normalise as N
from tickloom.sources.fixtures import EVENTS_AS_OF, ORDERS_AS_OF

def raw_millis(c: str = "ts"):
    return F.unix_millis(F.col(c).cast("timestamp"))


@query("s05_trades", "trading_pair id:i ts price:4 volume:4 sell_taker", "trades",
       sql="SELECT trading_pair, id, date_trunc('millisecond', ts) AS ts, price, volume, sell_taker FROM trades")
def s05(view):
    raw = view("trades").select("trading_pair", raw_millis().alias("T"), F.col("price").cast("string").alias("p"), F.col("volume").cast("string").alias("q"),
                                F.col("sell_taker").alias("m"), F.col("id").alias("a"), F.col("id").alias("f"), F.col("id").alias("l"))
    return N.trades(raw)


@query("s06_open_interest", "trading_pair ts sum_open_interest:4 cmc_circulating_supply:4", "open_interest",
       sql="SELECT *, CASE WHEN hour(ts) % 2 = 0 THEN sum_open_interest END AS cmc_circulating_supply FROM open_interest")
def s06(view):
    raw = view("open_interest").select(
        "trading_pair", raw_millis().alias("timestamp"), F.col("sum_open_interest").cast("string").alias("sumOpenInterest"),
        F.when(F.hour("ts") % 2 == 0, F.col("sum_open_interest").cast("string")).otherwise("n/a").alias("CMCCirculatingSupply"), F.lit("x").alias("symbol"))
    return N.open_interest(raw)


@query("s07_funding_history", "symbol funding_time funding_rate:9 mark_price:4", "funding_history",
       sql="SELECT symbol, date_trunc('millisecond', funding_time) AS funding_time, funding_rate, mark_price FROM funding_history")
def s07(view):
    h = view("funding_history").select("symbol", raw_millis("funding_time").alias("fundingTime"), F.col("funding_rate").cast("string").alias("fundingRate"),
                                       F.col("mark_price").cast("string").alias("markPrice"))
    return N.funding_history(h)


@query("s08_fills", "order_id:i timestamp amount:4 price:4 trade_fee_in_quote:4", "fills",
       sql="SELECT order_id, ts AS timestamp, round(amount * 1e6) / 1e6 AS amount, round(price * 1e6) / 1e6 AS price, round(trade_fee_in_quote * 1e6) / 1e6 AS trade_fee_in_quote FROM fills")
def s08(view):
    fixed = {c: F.round(F.col(c) * 1e6).cast("bigint") for c in ("amount", "price", "trade_fee_in_quote")}
    return N.fills(view("fills").withColumns(fixed).withColumn("timestamp", raw_millis()))


@query("s08_executors", "executor_id:i side level_id", sql="""SELECT o_orderkey AS executor_id, CASE WHEN o_orderkey % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side,
concat('L', o_orderkey % 4) AS level_id FROM orders WHERE o_orderpriority = '1-URGENT'""")
def s08_executors(view):
    k = F.col("o_orderkey")
    raw = view("orders").select(
        k.alias("executor_id"), F.col("o_orderpriority").alias("controller_id"),
        F.to_json(F.struct(F.when(k % 2 == 0, "BUY").otherwise("SELL").alias("side"))).alias("config"),
        F.to_json(F.struct(F.concat(F.lit("L"), k % 4).alias("level_id"))).alias("custom_info"))
    return N.executors(raw, "1-URGENT").select("executor_id", "config.side", "custom_info.level_id")


@query("s09_health", "relation status ok", sql="""SELECT 'orders' AS relation, 'Correct' AS status, true AS ok UNION ALL SELECT 'fills', 'Correct', true
UNION ALL SELECT 'executors', CASE WHEN (SELECT count(*) FROM orders WHERE o_totalprice < 0) > 0 THEN 'Correct' ELSE 'Error - No records matched' END, (SELECT count(*) FROM orders WHERE o_totalprice < 0) > 0
UNION ALL SELECT 'all', 'Error - No records matched', false""")
def s09(view):
    return N.health(orders=view("orders"), fills=view("lineitem"), executors=view("orders").filter(F.col("o_totalprice") < 0))


FEATURES = "SELECT ts, 'close' AS feature_name, trading_pair, connector AS connector_name, close AS value FROM bars_1h"


def features(view):
    return view("bars_1h").select("ts", F.lit("close").alias("feature_name"), "trading_pair", F.col("connector").alias("connector_name"), F.col("close").alias("value"))


@query("s11_find_features", "ts trading_pair value:4", "bars_1h", ctes={"f": FEATURES},
       sql="SELECT * FROM f WHERE trading_pair = 'view' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' ORDER BY ts DESC LIMIT 50")
def s11(view):
    return L.find_features(features(view), "close", "view", "sim", as_of("2024-01-05 00:00:00"), as_of("2024-01-20 00:00:00"), 50)


@query("s12_find_signals", "ts trading_pair category value:4", "bars_1h", ctes=BB,
       sql="SELECT *, 'mr' AS category, signal * 0.5 AS value FROM bbs WHERE signal * 0.5 BETWEEN -1 AND -0.1")
def s12(view):
    s = Bollinger(20).calculate(view("bars_1h")).select("ts", F.lit("bollinger").alias("signal_name"), "trading_pair", F.lit("mr").alias("category"), (F.col("signal") * 0.5).alias("value"))
    return L.find_signals(s, "bollinger", category="mr", low=-1.0, high=-0.1)


@query("s13_retention", "ts trading_pair value:4", "bars_1h", ctes={"f": FEATURES}, sql=f"SELECT * FROM f WHERE ts >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 14 DAY")
def s13(view):
    return L.retained(features(view), as_of(), 14)


@query("s14_execution_ttl", "execution_id:i", "task_runs", sql="SELECT execution_id FROM task_runs WHERE started_at >= TIMESTAMP '2024-04-10' - INTERVAL 90 DAY")
def s14(view):
    return L.retained(view("task_runs"), as_of("2024-04-10 00:00:00"), 90, "started_at")


@query("s15_documents_find", "event_id:i ts value:4", sql="SELECT * FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id LIMIT 100")
def s15(view):
    return L.newest_first(view("events").filter(F.col("event_type") == "purchase"), 100, "ts", "event_id")


@query("s15_documents_delete", "event_id:i", sql="SELECT event_id FROM events WHERE NOT (event_type = 'purchase' AND value < 50)")
def s15_delete(view):
    return L.without(view("events"), (F.col("event_type") == "purchase") & (F.col("value") < 50))


@query("s17_export", "trading_pair ts close:6 venue export_timestamp", "bars_1h",
       sql=f"SELECT *, 'sim' AS venue, TIMESTAMP '{EVENTS_AS_OF}' AS export_timestamp FROM bars_1h")
def s17(view):
    return L.export_frame(view("bars_1h"), as_of(), {"venue": "sim"})


@query("s18_inventory", "connector trading_pair rows:i first_bar last_bar mean_volume:4 return_std:6 low:4 high:4", "bars_1d", ctes={"nb": O.numbered("bars_1d")},
       sql="""SELECT connector, trading_pair, count(*) AS rows, min(ts) AS first_bar, max(ts) AS last_bar, avg(volume) AS mean_volume,
stddev_samp(close / nullif(prev_close, 0) - 1) AS return_std, min(low) AS low, max(high) AS high FROM nb GROUP BY ALL""")
def s18(view):
    return L.inventory(view("bars_1d"))


@query("s19_clear", "trading_pair ts interval", "bars_1h", sql="SELECT *, '1h' AS interval FROM bars_1h WHERE trading_pair <> 'view'")
def s19(view):
    return L.cleared(view("bars_1h").withColumn("interval", F.lit("1h")), pair="view", interval="1h")


@query("s20_recent_configs", "o_orderkey:i", sql=f"SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 1000 DAY")
def s20(view):
    return L.retained(view("orders"), as_of(ORDERS_AS_OF), 1000, "o_orderdate")
