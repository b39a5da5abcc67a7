"""L*: books, AMM bins, quotes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.catalog.registry import query
from tickloom.plans import liquidity as L

DEPTH = """SELECT *, sum(amount) OVER w AS cum_amount, sum(price * amount) OVER w AS cum_quote, row_number() OVER w AS level FROM book
WINDOW w AS (PARTITION BY trading_pair, side ORDER BY CASE WHEN side = 'bid' THEN -price ELSE price END ROWS UNBOUNDED PRECEDING)"""
D = {"d": DEPTH}


@query("l01_depth_snapshot", "trading_pair side level:i price amount cum_amount:4", "book", ctes=D, sql="SELECT * FROM d WHERE level <= 20")
def l01(view):
    return L.depth_snapshot(view("book"), 20)


def _price_sql(cum: str, volume: float, side: str) -> str:
    return f"""SELECT trading_pair, arg_min(price, level) FILTER (WHERE {cum} >= {volume}) AS result_price, least({volume}, max({cum})) AS result_volume
FROM d WHERE side = '{side}' GROUP BY trading_pair"""


@query("l02_price_for_volume", "trading_pair result_price:6 result_volume:4", "book", ctes=D, sql=_price_sql("cum_amount", 900.0, "ask"))
def l02(view):
    return L.price_for_volume(view("book"), 900.0, True)


@query("l04_price_for_quote", "trading_pair result_price:6 result_volume:4", "book", ctes=D, sql=_price_sql("cum_quote", 800000.0, "bid"))
def l04(view):
    return L.price_for_volume(view("book"), 800000.0, False, quote=True)


@query("l03_volume_for_price", "trading_pair result_volume:4 result_quote_volume:3", "book",
       sql="SELECT trading_pair, sum(amount) FILTER (WHERE side = 'ask' AND price <= 1010) AS result_volume, sum(price * amount) FILTER (WHERE side = 'ask' AND price <= 1010) AS result_quote_volume FROM book GROUP BY trading_pair")
def l03(view):
    return L.volume_for_price(view("book"), F.lit(1010.0), True)


@query("l05_quote_volume_crossed", "trading_pair result_quote_volume:3 crossed_book crossed_reason best_bid:4 best_ask:4 mid_price:4 suggested_price:4", "book",
       sql="""SELECT *, CASE WHEN crossed_book AND 999.95 < best_bid THEN concat('Buy price 999.95 below best bid ', best_bid::DOUBLE, ' - no liquidity available') END AS crossed_reason,
CASE WHEN crossed_book AND 999.95 < best_bid THEN best_bid END AS suggested_price, (best_bid + best_ask) / 2 AS mid_price FROM (
SELECT trading_pair, sum(price * amount) FILTER (WHERE side = 'ask' AND price <= 999.95) AS result_quote_volume, coalesce(sum(amount) FILTER (WHERE side = 'ask' AND price <= 999.95), -1) = -1 AS crossed_book,
max(price) FILTER (WHERE side = 'bid') AS best_bid, min(price) FILTER (WHERE side = 'ask') AS best_ask FROM book GROUP BY trading_pair)""")
def l05(view):
    return L.volume_for_price(view("book"), F.lit(999.95), True)


@query("l06_vwap", "trading_pair vwap:6 result_volume:4", "book", ctes=D,
       sql="""SELECT trading_pair, sum(price * t) / nullif(sum(t), 0) AS vwap, sum(t) AS result_volume FROM (
SELECT *, greatest(0, least(amount, 500 - (cum_amount - amount))) AS t FROM d WHERE side = 'ask') GROUP BY trading_pair""")
def l06(view):
    return L.vwap_for_volume(view("book"), 500.0, True)


@query("l07_book_summary", "trading_pair best_bid:4 best_ask:4 spread:5 spread_pct:5 mid_price:5 bid_amount:3 ask_amount:3 bid_value:2 ask_value:2 levels_in_window:i amount_in_window:3", "book",
       ctes={"s": """SELECT trading_pair, max(price) FILTER (WHERE side = 'bid') AS best_bid, min(price) FILTER (WHERE side = 'ask') AS best_ask,
sum(amount) FILTER (WHERE side = 'bid') AS bid_amount, sum(amount) FILTER (WHERE side = 'ask') AS ask_amount,
sum(price * amount) FILTER (WHERE side = 'bid') AS bid_value, sum(price * amount) FILTER (WHERE side = 'ask') AS ask_value FROM book GROUP BY 1"""},
       sql="""SELECT s.*, best_ask - best_bid AS spread, 100 * (best_ask - best_bid) / best_bid AS spread_pct, (best_ask + best_bid) / 2 AS mid_price, n.* EXCLUDE (trading_pair) FROM s
LEFT JOIN (SELECT b.trading_pair, count(*) AS levels_in_window, sum(amount) AS amount_in_window FROM book b JOIN s USING (trading_pair)
WHERE (side = 'bid' AND price >= (best_ask + best_bid) / 2 * 0.995) OR (side = 'ask' AND price <= (best_ask + best_bid) / 2 * 1.005) GROUP BY 1) n USING (trading_pair)""")
def l07(view):
    return L.book_summary(view("book"), 0.005)


POOL_STATE = "SELECT pool, avg(price) AS price, CAST(floor(avg(bin_id)) AS BIGINT) AS active_bin_id FROM amm_bins GROUP BY pool"
PS = {"ps": POOL_STATE, "b": "SELECT a.*, ps.price AS p, active_bin_id, quote_amount + base_amount * ps.price AS v FROM amm_bins a JOIN ps USING (pool)"}


def pool_state(view):
    return view("amm_bins").groupBy("pool").agg(F.avg("price").alias("price"), F.floor(F.avg("bin_id")).alias("active_bin_id"))


@query("l08_pool", "pool base_liquidity:3 quote_liquidity:3 total_liquidity:2 num_bins:i min_price:4 max_price:4 liquidity_concentration:6", "amm_bins", ctes=PS,
       sql="""SELECT pool, sum(base_amount) AS base_liquidity, sum(quote_amount) AS quote_liquidity, sum(v) AS total_liquidity, count(*) AS num_bins, min(price) AS min_price,
max(price) AS max_price, coalesce(100 * sum(CASE WHEN abs(bin_id - active_bin_id) <= 5 THEN v ELSE 0 END) / nullif(sum(v), 0), 0) AS liquidity_concentration FROM b GROUP BY pool""")
def l08(view):
    return L.pool_analysis(view("amm_bins"), pool_state(view))


@query("l08_top_bins", "pool bin_id:i total_value:3 rank:i", "amm_bins",
       sql="""SELECT *, row_number() OVER (PARTITION BY pool ORDER BY total_value DESC, bin_id) AS rank FROM (SELECT *, quote_amount + base_amount * 1000 AS total_value FROM amm_bins) QUALIFY rank <= 5""")
def l08_top(view):
    return L.top_bins(view("amm_bins"), F.lit(1000.0))


@query("l09_distribution", "pool range_pct:i share_pct:6", "amm_bins", ctes=PS,
       sql="""SELECT pool, r AS range_pct, coalesce(100 * sum(CASE WHEN price BETWEEN p * (1 - r / 100.0) AND p * (1 + r / 100.0) THEN v ELSE 0 END) / nullif(sum(v), 0), 0) AS share_pct
FROM b JOIN (VALUES (5), (10), (15), (20)) x(r) ON true GROUP BY pool, r""")
def l09(view):
    return L.price_range_distribution(view("amm_bins"), pool_state(view))


@query("l10_bin_detail", "pool bin_id:i is_active_bin distance_from_price:6 total_value:3 liquidity_share_pct:6", "amm_bins", ctes=PS,
       sql="""SELECT *, bin_id = active_bin_id AS is_active_bin, 100 * (price - p) / p AS distance_from_price, v AS total_value,
100 * v / nullif(sum(v) OVER (PARTITION BY pool), 0) AS liquidity_share_pct FROM b""")
def l10(view):
    return L.bin_detail(view("amm_bins"), pool_state(view))


SQRT = """SELECT p_partkey AS pool_id, CAST(p_retailprice * 1e27 AS DECIMAL(38,0)) AS root, 18 - p_size % 3 * 6 AS d0, 6 AS d1 FROM part"""


@query("l11_sqrt_price", "pool_id:i price:6", sql="""SELECT *, power(x / power(2.0::DOUBLE, 96), 2) * power(10.0::DOUBLE, d0 - d1) / 1e9 AS price FROM (
SELECT p_partkey AS pool_id, p_retailprice * 1e27 AS x, 18 - p_size % 3 * 6 AS d0, 6 AS d1 FROM part)""")
def l11(view):
    p = view("part").select(F.col("p_partkey").alias("pool_id"), (F.col("p_retailprice") * 1e27).alias("x"),
                            (18 - F.col("p_size") % 3 * 6).alias("d0"), F.lit(6).alias("d1"))
    return p.withColumn("price", L.sqrt_price(F.col("x"), F.col("d0"), F.col("d1")) / 1e9)


DEX = """SELECT p_partkey AS pool, p_brand AS trading_pair, CASE p_size % 3 WHEN 0 THEN 'WETH' WHEN 1 THEN 'USDC' ELSE 'TOK' END AS token0,
CASE WHEN p_size % 3 = 2 THEN 'USDC' ELSE 'TOK' END AS token1, CAST(p_size AS DOUBLE) AS balance0, CAST(p_size * 2 AS DOUBLE) AS balance1,
CASE p_size % 3 WHEN 2 THEN p_retailprice ELSE 1 / p_retailprice END AS price FROM part"""


def dex(view):
    s = F.col("p_size") % 3
    return view("part").select(
        F.col("p_partkey").alias("pool"), F.col("p_brand").alias("trading_pair"), F.when(s == 0, "WETH").when(s == 1, "USDC").otherwise("TOK").alias("token0"),
        F.when(s == 2, "USDC").otherwise("TOK").alias("token1"), F.col("p_size").cast("double").alias("balance0"), (F.col("p_size") * 2).cast("double").alias("balance1"),
        F.when(s == 2, F.col("p_retailprice")).otherwise(1 / F.col("p_retailprice")).alias("price"))


@query("l12_dex_vs_cex", "pool:i price_usd:4 tvl:3 diff_pct:5", "book", ctes={"dex": DEX,
       "cex": "SELECT trading_pair, (max(price) FILTER (WHERE side = 'bid') + min(price) FILTER (WHERE side = 'ask')) / 2 AS cex_price FROM book GROUP BY 1",
       "j": """SELECT *, CASE WHEN token0 = 'WETH' THEN 2000.0 / price WHEN token0 = 'USDC' THEN 1 / price ELSE price END AS price_usd,
CASE WHEN token0 = 'WETH' THEN balance0 * 2000 * 2 WHEN token0 = 'USDC' THEN balance0 * 2 ELSE balance1 * 2 END AS tvl FROM dex LEFT JOIN cex USING (trading_pair)"""},
       sql="SELECT *, 100 * (price_usd - cex_price) / cex_price AS diff_pct FROM j")
def l12(view):
    cex = L.book_summary(view("book"), 0.005)
    return L.pool_usd(dex(view), "TOK", F.lit(2000.0), cex)


@query("l13_quotes", "quote_id:i venue price:9 best_price:9 best_venue over_best_pct:5", "quotes",
       ctes={"p": "SELECT *, CASE WHEN amount_in = 0 THEN 0 ELSE amount_in / nullif(amount_out, 0) END AS price FROM quotes"},
       sql="""SELECT *, (price / best_price - 1) * 100 AS over_best_pct FROM p JOIN (SELECT quote_id, min(price) AS best_price, arg_min(venue, row(price, venue)) AS best_venue FROM p GROUP BY 1) USING (quote_id)""")
def l13(view):
    return L.compare_quotes(view("quotes"))


@query("l13_swap_amounts", "quote_id:i from_amount:6 to_amount:6 execution_price:6 value_in_usd:4",
       sql="""SELECT *, CASE WHEN to_amount = 0 THEN 0 ELSE from_amount / to_amount END AS execution_price, from_amount * from_price AS value_in_usd FROM (
SELECT o_orderkey AS quote_id, o_orderkey * 1000 / 1e6 AS from_amount, round(o_totalprice * 100) * 10 / 1e8 AS to_amount, 2.5 AS from_price FROM orders)""")
def l13_swaps(view):
    o = view("orders").select(F.col("o_orderkey").alias("quote_id"), (F.col("o_orderkey") * 1000).cast("string").alias("from_units"), F.lit(6).alias("from_decimals"),
                              (F.round(F.col("o_totalprice") * 100).cast("bigint") * 10).cast("string").alias("to_units"), F.lit(8).alias("to_decimals"), F.lit(2.5).alias("from_price"))
    return L.swap_amounts(o)
