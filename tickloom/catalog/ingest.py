"""T*: trades to bars and alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.catalog import oracle as O
from tickloom.catalog.registry import query
from tickloom.functions.columns import bars_per_day, interval_seconds_col
from tickloom.operators import ingest as I
from tickloom.operators import rolling as R
from tickloom.operators.layout import own_rows, segmented
from tickloom.sources.fixtures import EVENTS_AS_OF

OHLCV = "connector trading_pair ts open high low close volume:4 "
FULL = OHLCV + "quote_asset_volume:2 n_trades:i taker_buy_base_volume:2 taker_buy_quote_volume:2"


def as_of(text: str = EVENTS_AS_OF):
    return F.lit(text).cast("timestamp_ntz")


def bars_sql(bucket: str, src: str = "trades") -> str:
    return f"""SELECT connector, trading_pair, {bucket} AS ts, arg_min(price, row(ts, id)) AS open, max(price) AS high,
min(price) AS low, arg_max(price, row(ts, id)) AS close, sum(volume) AS volume,
sum(price * volume) AS quote_asset_volume, count(*) AS n_trades,
sum(CASE WHEN NOT sell_taker THEN volume ELSE 0 END) AS taker_buy_base_volume,
sum(CASE WHEN NOT sell_taker THEN price * volume ELSE 0 END) AS taker_buy_quote_volume
FROM {src} GROUP BY connector, trading_pair, {bucket}"""


def _bucket(seconds: int) -> str:
    return f"time_bucket(INTERVAL {seconds} SECONDS, ts, TIMESTAMP '1970-01-01')"


@query("t01_resample_dense_1h", OHLCV, "trades", ctes={
    "b": bars_sql("date_trunc('hour', ts)"),
    "grid": "SELECT connector, trading_pair, unnest(g) AS ts FROM (SELECT connector, trading_pair, generate_series(min(ts), max(ts), INTERVAL 1 HOUR) AS g FROM b GROUP BY connector, trading_pair)",
    "j": "SELECT g.*, open, high, low, close, coalesce(volume, 0) AS volume FROM grid g LEFT JOIN b USING (connector, trading_pair, ts)"},
    sql="SELECT connector, trading_pair, ts, volume, " + ", ".join(
        f"last_value({c} IGNORE NULLS) OVER (PARTITION BY connector, trading_pair ORDER BY ts) AS {c}"
        for c in ("open", "high", "low", "close")) + " FROM j")
def t01(view):
    return I.resample_ohlcv(view("trades"), "1h")


@query("t01_resample_dense_15m", OHLCV, "trades", ctes={
    "b": bars_sql(_bucket(900)),
    "grid": "SELECT connector, trading_pair, unnest(g) AS ts FROM (SELECT connector, trading_pair, generate_series(min(ts), max(ts), INTERVAL 15 MINUTE) AS g FROM b GROUP BY connector, trading_pair)",
    "j": "SELECT g.*, open, high, low, close, coalesce(volume, 0) AS volume FROM grid g LEFT JOIN b USING (connector, trading_pair, ts)"},
    sql="SELECT connector, trading_pair, ts, volume, " + ", ".join(
        f"last_value({c} IGNORE NULLS) OVER (PARTITION BY connector, trading_pair ORDER BY ts) AS {c}"
        for c in ("open", "high", "low", "close")) + " FROM j")
def t01_15m(view):
    return I.resample_ohlcv(view("trades"), "15m")


@query("t02_enriched_1h", FULL, "trades", sql=bars_sql("date_trunc('hour', ts)"))
def t02(view):
    return I.trades_to_bars(view("trades"), "1h")


@query("t02_enriched_weekly", FULL, "trades", sql=bars_sql("date_trunc('week', ts)"))
def t02_weekly(view):
    return I.trades_to_bars(view("trades"), "1w")


@query("t03_multi_interval", FULL + " interval", "trades",
       sql=" UNION ALL ".join(f"SELECT *, '{iv}' AS interval FROM ({bars_sql(_bucket(s))})"
                              for iv, s in (("15m", 900), ("1h", 3600), ("4h", 14400), ("3d", 259200))))
def t03(view):
    return I.multi_interval_bars(view("trades"), ["1h", "15m", "3d", "4h"])


@query("t04_interval_seconds", "order_key:i label seconds:i bars_per_day:i",
       sql="""SELECT o_orderkey AS order_key, label, CASE label WHEN '1s' THEN 1 WHEN '5m' THEN 300 WHEN '30m' THEN 1800
WHEN '1w' THEN 604800 ELSE 60 END AS seconds, 86400 // CASE label WHEN '1s' THEN 1 WHEN '5m' THEN 300 WHEN '30m' THEN 1800
WHEN '1w' THEN 604800 ELSE 60 END AS bars_per_day FROM (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '1s' WHEN 1 THEN '5m'
WHEN 2 THEN '30m' WHEN 3 THEN '1w' ELSE 'odd' END AS label FROM orders)""")
def t04_t05(view):
    k = F.col("o_orderkey") % 5
    df = view("orders").select(F.col("o_orderkey").alias("order_key"), F.when(k == 0, "1s").when(k == 1, "5m")
                               .when(k == 2, "30m").when(k == 3, "1w").otherwise("odd").alias("label"))
    df = df.withColumn("seconds", interval_seconds_col("label"))
    return df.withColumn("bars_per_day", F.floor(F.lit(86400) / F.col("seconds")))


@query("t06_range_slice", OHLCV, "bars_1h",
       sql="SELECT * FROM bars_1h WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-12 00:00:00'")
def t06(view):
    return I.between(view("bars_1h"), as_of("2024-01-05 00:00:00"), as_of("2024-01-12 00:00:00"))


REQUESTS = """SELECT DISTINCT 'sim' AS connector, event_type AS trading_pair,
 TIMESTAMP '2024-01-10 00:00:00' + (length(event_type) - 5) * INTERVAL 6 DAY AS start,
 TIMESTAMP '2024-01-25 00:00:00' + (length(event_type) - 4) * INTERVAL 4 DAY AS "end" FROM events
UNION ALL SELECT DISTINCT 'sim', concat(event_type, '2'), TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-02' FROM events
UNION ALL SELECT DISTINCT 'sim', event_type, TIMESTAMP '2023-12-01', TIMESTAMP '2024-03-01' FROM events"""


@query("t07_missing_ranges", "connector trading_pair start end side gap_start gap_end", "bars_1h", ctes={
    "requests": REQUESTS,
    "have": "SELECT connector, trading_pair, min(ts) AS lo, max(ts) AS hi FROM bars_1h GROUP BY ALL",
    "r": "SELECT * FROM requests LEFT JOIN have USING (connector, trading_pair)"},
    sql="""SELECT *, 'all' AS side, start AS gap_start, "end" AS gap_end FROM r WHERE lo IS NULL
UNION ALL SELECT *, 'left', start, least(lo - INTERVAL 1 SECOND, "end") FROM r WHERE start < lo
UNION ALL SELECT *, 'right', greatest(hi + INTERVAL 1 SECOND, start), "end" FROM r WHERE "end" > hi""")
def t07(view):
    e = view("events").select("event_type").distinct()
    day = lambda n: F.make_dt_interval(days=n)
    size = F.length("event_type")
    base = e.select(F.lit("sim").alias("connector"), F.col("event_type").alias("trading_pair"),
                    (as_of("2024-01-10 00:00:00") + day((size - 5) * 6)).alias("start"),
                    (as_of("2024-01-25 00:00:00") + day((size - 4) * 4)).alias("end"))
    unknown = e.select(F.lit("sim").alias("connector"), F.concat("event_type", F.lit("2")).alias("trading_pair"),
                       as_of("2024-01-01 00:00:00").alias("start"), as_of("2024-01-02 00:00:00").alias("end"))
    wide = e.select(F.lit("sim").alias("connector"), F.col("event_type").alias("trading_pair"),
                    as_of("2023-12-01 00:00:00").alias("start"), as_of("2024-03-01 00:00:00").alias("end"))
    return I.missing_ranges(base.unionByName(unknown).unionByName(wide), view("bars_1h"))


@query("t07_interior_gaps", "connector trading_pair prev_ts ts missing_bars:i", "bars_1h",
       sql="""SELECT *, date_diff('hour', prev_ts, ts) - 1 AS missing_bars FROM (SELECT *, lag(ts) OVER (
PARTITION BY connector, trading_pair ORDER BY ts) AS prev_ts FROM bars_1h) WHERE ts - prev_ts > INTERVAL 1 HOUR""")
def t07_interior(view):
    return I.interior_gaps(view("bars_1h"), "1h")


MERGE_SQL = {"old": "SELECT * FROM bars_1h WHERE ts < TIMESTAMP '2024-01-20'",
             "fresh": """SELECT * REPLACE (CASE WHEN n_trades % 2 = 0 THEN close + 1 ELSE close END AS close)
FROM bars_1h WHERE ts >= TIMESTAMP '2024-01-18'"""}


def _batches(view):
    b = view("bars_1h")
    old = b.filter(F.col("ts") < as_of("2024-01-20 00:00:00"))
    fresh = b.filter(F.col("ts") >= as_of("2024-01-18 00:00:00")).withColumn(
        "close", F.when(F.col("n_trades") % 2 == 0, F.col("close") + 1).otherwise(F.col("close")))
    return old, fresh


@query("t08_merge_key", FULL.replace("close ", "close:4 "), "bars_1h", ctes=MERGE_SQL,
       sql="""SELECT * FROM fresh UNION ALL SELECT o.* FROM old o ANTI JOIN fresh f
ON o.connector = f.connector AND o.trading_pair = f.trading_pair AND o.ts = f.ts""")
def t08_key(view):
    return I.merge_bars(*_batches(view), mode="key")


@query("t08_merge_row", "connector trading_pair ts close:4", "bars_1h", ctes=MERGE_SQL,
       sql="SELECT connector, trading_pair, ts, close FROM old UNION SELECT connector, trading_pair, ts, close FROM fresh")
def t08_row(view):
    old, fresh = (d.select("connector", "trading_pair", "ts", "close") for d in _batches(view))
    return I.merge_bars(old, fresh, mode="row")


@query("t09_recent", OHLCV, "bars_1h", sql=f"SELECT * FROM bars_1h WHERE ts >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 10 DAY")
def t09(view):
    return I.recent(view("bars_1h"), as_of(), 10)


@query("t11_daily", OHLCV + "buy_volume:2 sell_volume:2", "bars_1h",
       sql="""SELECT connector, trading_pair, date_trunc('day', ts)::TIMESTAMP AS ts, arg_min(open, b.ts) AS open, max(high) AS high,
min(low) AS low, arg_max(close, b.ts) AS close, sum(volume) AS volume, sum(taker_buy_base_volume) AS buy_volume,
sum(volume) - sum(taker_buy_base_volume) AS sell_volume FROM bars_1h b GROUP BY connector, trading_pair, date_trunc('day', ts)""")
def t11(view):
    return I.daily_volume(view("bars_1h"))


@query("t12_last_completed", "connector trading_pair ts prev_close", "bars_1h", ctes={"nb": O.numbered()}, sql="SELECT * FROM nb")
def t12(view):
    df, p = segmented(view("bars_1h"), 1)
    return own_rows(df.withColumn("prev_close", R.shift("close", 1, p)))


@query("t13_forward_fill", "connector trading_pair ts seen", "bars_1h",
       sql="""SELECT *, last_value(CASE WHEN n_trades % 4 = 0 THEN close END IGNORE NULLS) OVER (
PARTITION BY connector, trading_pair ORDER BY ts ROWS UNBOUNDED PRECEDING) AS seen FROM bars_1h""")
def t13(view):
    df = view("bars_1h").withColumn("seen", F.when(F.col("n_trades") % 4 == 0, F.col("close")))
    return I.fill_forward(df, ["seen"])
