"""Views of the shared test tables in the shape of the market-data inputs.

One text per view serves Spark and the DuckDB oracle; ``@json`` and ``@row`` mark the two dialect
differences, ``{name}`` refers to another view or table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tickloom.operators.layout import mark_bars
from tickloom.session import use_utc

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

EVENTS_AS_OF = "2024-01-31 00:00:00"
ORDERS_AS_OF = "2001-12-01 00:00:00"

_TIE = "l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax"

VIEWS = {
    "trades": """
SELECT 'sim' AS connector, event_type AS trading_pair, event_id AS id, ts, value AS price,
       CAST(@json AS DOUBLE) AS volume, event_id % 2 = 1 AS sell_taker FROM {events}""",
    "bars_1h": """
SELECT connector, trading_pair, date_trunc('hour', ts) AS ts,
       min_by(price, @row(ts, id)) AS open, max(price) AS high, min(price) AS low,
       max_by(price, @row(ts, id)) AS close,
       sum(volume) AS volume, sum(price * volume) AS quote_asset_volume, count(*) AS n_trades,
       sum(CASE WHEN NOT sell_taker THEN volume ELSE 0 END) AS taker_buy_base_volume,
       sum(CASE WHEN NOT sell_taker THEN price * volume ELSE 0 END) AS taker_buy_quote_volume
FROM {trades} GROUP BY connector, trading_pair, date_trunc('hour', ts)""",
    "bars_1d": f"""
SELECT 'sim' AS connector, concat('S', l_suppkey) AS trading_pair, l_shipdate AS ts,
       min_by(l_extendedprice / l_quantity, @row({_TIE})) AS open,
       max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
       max_by(l_extendedprice / l_quantity, @row({_TIE})) AS close,
       sum(l_quantity) AS volume, sum(l_extendedprice) AS quote_asset_volume, count(*) AS n_trades,
       sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) AS taker_buy_base_volume,
       sum(CASE WHEN l_linestatus = 'O' THEN l_extendedprice ELSE 0 END) AS taker_buy_quote_volume
FROM {{lineitem}} GROUP BY l_suppkey, l_shipdate""",
    "fills": """
SELECT l_returnflag AS config_file_path, 'sim' AS market, concat('S', l_suppkey) AS symbol,
       l_shipdate AS ts, l_orderkey AS order_id, l_linenumber AS fill_no, l_partkey AS tie,
       CASE WHEN l_linestatus = 'O' THEN 'BUY' ELSE 'SELL' END AS trade_type,
       l_quantity AS amount, l_extendedprice / l_quantity AS price,
       l_extendedprice * l_tax AS trade_fee_in_quote FROM {lineitem}""",
    "funding": """
SELECT n.n_name AS connector, s.s_name AS trading_pair, avg(l.l_discount) - avg(l.l_tax) AS rate,
       avg(l.l_extendedprice) AS mark_price
FROM {lineitem} l JOIN {supplier} s ON l.l_suppkey = s.s_suppkey
     JOIN {nation} n ON s.s_nationkey = n.n_nationkey GROUP BY n.n_name, s.s_name""",
    "funding_history": """
SELECT event_type AS symbol, event_id AS id, ts AS funding_time, value / 1e5 AS funding_rate,
       value AS mark_price FROM {events}""",
    "open_interest": """
SELECT connector, trading_pair, ts, sum(volume) OVER (PARTITION BY trading_pair ORDER BY ts
       ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS sum_open_interest FROM {bars_1h}""",
    "pools": f"""
SELECT p_partkey AS pool_id,
       concat(p_brand, ' / ', CASE WHEN p_size % 3 = 0 THEN 'USDC' ELSE 'SOL' END) AS name,
       CAST(p_retailprice * 1000 AS @string) AS fdv_usd,
       CAST(p_size % 10 * 20000 AS @string) AS reserve_in_usd,
       CAST(p_retailprice * (p_partkey % 400) AS @string) AS volume_usd_h24, p_size AS age_days,
       CAST(p_partkey % 600 AS @string) AS transactions_h24_buys,
       CAST(p_partkey % 500 AS @string) AS transactions_h24_sells FROM {{part}}""",
    "book": """
SELECT p_brand AS trading_pair, CASE WHEN p_partkey % 2 = 0 THEN 'bid' ELSE 'ask' END AS side,
       1000 + CASE WHEN p_partkey % 2 = 0 THEN -1 ELSE 1 END * (CAST(p_partkey AS DOUBLE) / 100)
       AS price, CAST(p_size AS DOUBLE) AS amount FROM {part}""",
    "amm_bins": """
SELECT p_brand AS pool, p_partkey AS bin_id, p_retailprice AS price,
       CAST(p_size AS DOUBLE) AS base_amount, CAST(p_partkey % 100 AS DOUBLE) AS quote_amount
FROM {part}""",
    "trading_rules": """
SELECT DISTINCT concat(p_brand, '-', CASE WHEN p_size % 2 = 0 THEN 'USDT' ELSE 'BTC' END)
       AS trading_pair, CAST(p_size AS DECIMAL(38,18)) AS min_order_size,
       CAST(p_size * 5 AS DECIMAL(38,18)) AS min_notional_size FROM {part}""",
    "balances": """
SELECT c_mktsegment AS exchange, c_name AS token, CAST(1 AS DOUBLE) AS units, c_acctbal AS value
FROM {customer}""",
    "task_runs": """
SELECT event_id AS execution_id, event_type AS task_name, ts AS started_at,
       value AS duration_seconds,
       CASE WHEN event_id % 7 = 0 THEN 'failed' ELSE 'completed' END AS status FROM {events}""",
    "quotes": """
SELECT l_orderkey AS quote_id, concat('V', l_suppkey) AS venue, sum(l_extendedprice) AS amount_out,
       CAST(1000 AS DOUBLE) AS amount_in FROM {lineitem} GROUP BY l_orderkey, l_suppkey""",
    "bot_performance": """
SELECT o_orderpriority AS bot_name, o_orderkey AS controller_id, o_orderstatus AS status,
       o_totalprice AS volume_traded, (o_totalprice - 250000) / 1000 AS global_pnl_quote,
       (o_totalprice - 250000) / 25000 AS global_pnl_pct, o_orderdate AS started_at
FROM {orders}""",
}

_BARS = {"bars_1h": 3600, "bars_1d": 86400, "open_interest": 3600}

_SPARK = {"@json": "get_json_object(props, '$.k')", "@row": "struct", "@string": "STRING"}
_DUCK = {"@json": "json_extract_string(props, '$.k')", "@row": "row", "@string": "VARCHAR"}


def _dialect(text: str, marks: dict[str, str]) -> str:
    for mark, value in marks.items():
        text = text.replace(mark, value)
    return text


def needs(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", text)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a lazy DataFrame over the given tables."""
    use_utc(spark)
    if name in TABLES:
        return table(spark, sf_dir, name)
    text = VIEWS[name]
    inputs = {n: view(spark, sf_dir, n) for n in needs(text)}
    out = spark.sql(_dialect(text, _SPARK), **inputs)
    return mark_bars(out, _BARS[name]) if name in _BARS else out


def duck_views(*names: str) -> list[tuple[str, str]]:
    """(name, SQL) of the views and what they build on, in dependency order."""
    out: dict[str, str] = {}

    def add(name: str) -> None:
        if name in TABLES or name in out:
            return
        for dep in needs(VIEWS[name]):
            add(dep)
        text = _dialect(VIEWS[name], _DUCK)
        out[name] = re.sub(r"\{(\w+)\}", r"\1", text).strip()

    for n in names:
        add(n)
    return list(out.items())
