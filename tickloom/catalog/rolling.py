"""W*: window and rolling functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.catalog import oracle as O
from tickloom.catalog.registry import query
from tickloom.functions.columns import ratio
from tickloom.operators import rolling as R
from tickloom.operators.layout import OWN, POS, own_rows, prefix_scan, segmented

K = "connector trading_pair ts "
S = O.SERIES_W


def bars(view, halo: int, ahead: int = 0, name: str = "bars_1h"):
    return segmented(view(name), halo, ahead=ahead)


@query("w01_rolling_mean", K + "ma_5:6 ma_100:6", "bars_1h",
       sql=f"SELECT *, avg(close) OVER {O.w(5)} AS ma_5, avg(close) OVER {O.w(100)} AS ma_100 FROM bars_1h")
def w01(view):
    df, p = bars(view, 100)
    return own_rows(df.withColumns({f"ma_{n}": R.mean("close", n, p, partial=True) for n in (5, 100)}))


@query("w02_rolling_std", K + "sd:6 sd_partial:6", "bars_1h",
       sql=f"""SELECT *, CASE WHEN count(close) OVER {O.w(20)} >= 20 THEN stddev_samp(close) OVER {O.w(20)} END AS sd,
stddev_samp(close) OVER {O.w(5)} AS sd_partial FROM bars_1h""")
def w02(view):
    df, p = bars(view, 20)
    return own_rows(df.withColumns({"sd": R.std("close", 20, p), "sd_partial": R.std("close", 5, p, partial=True)}))


@query("w03_rolling_range", K + "price_range:6 range_pct:6", "bars_1h",
       sql=f"""SELECT *, price_range / nullif(close, 0) AS range_pct FROM (SELECT *, CASE WHEN count(*) OVER {O.w(50)} >= 50
THEN max(high) OVER {O.w(50)} - min(low) OVER {O.w(50)} END AS price_range FROM bars_1h)""")
def w03(view):
    df, p = bars(view, 50)
    df = df.withColumn("price_range", R.highest("high", 50, p) - R.lowest("low", 50, p))
    return own_rows(df.withColumn("range_pct", ratio("price_range", "close")))


@query("w04_vwap", K + "cum_volume:2 vwap:6 rolling_vwap:6", "bars_1h",
       sql=f"""SELECT *, sum(quote_asset_volume) OVER {S} AS cum_volume,
sum(close * quote_asset_volume) OVER {S} / nullif(sum(quote_asset_volume) OVER {S}, 0) AS vwap,
CASE WHEN count(*) OVER {O.w(50)} >= 50 THEN sum(close * quote_asset_volume) OVER {O.w(50)}
 / nullif(sum(quote_asset_volume) OVER {O.w(50)}, 0) END AS rolling_vwap FROM bars_1h""")
def w04(view):
    df, p = bars(view, 50)
    df = own_rows(df.withColumn("rolling_vwap", ratio(
        R.total(F.col("close") * F.col("quote_asset_volume"), 50, p), R.total("quote_asset_volume", 50, p))))
    df = prefix_scan(df, {"cum_volume": ("sum", "quote_asset_volume"),
                          "_cum_price": ("sum", F.col("close") * F.col("quote_asset_volume"))})
    return df.withColumn("vwap", ratio("_cum_price", "cum_volume"))


@query("w05_rolling_rank", K + "rank_50:6", "bars_1h", ctes={"nb": O.numbered()},
       sql="""SELECT a.*, r.rank_50 FROM nb a LEFT JOIN (
SELECT a.connector, a.trading_pair, a.i, (count(*) FILTER (WHERE b.close < a.close)
 + (count(*) FILTER (WHERE b.close = a.close) + 1) / 2.0) / 50.0 AS rank_50
FROM nb a JOIN nb b ON a.connector = b.connector AND a.trading_pair = b.trading_pair
 AND b.i BETWEEN a.i - 49 AND a.i WHERE a.i >= 49 GROUP BY ALL) r
ON a.connector = r.connector AND a.trading_pair = r.trading_pair AND a.i = r.i""")
def w05(view):
    df, p = bars(view, 50)
    return own_rows(R.rolling_rank(df, p, {"rank_50": "close"}, 50))


@query("w06_diff_shift", K + "diff_5:6 shift_3:6", "bars_1h",
       sql=f"SELECT *, close - lag(close, 5) OVER {S} AS diff_5, lag(close, 3) OVER {S} AS shift_3 FROM bars_1h")
def w06(view):
    df, p = bars(view, 5)
    return own_rows(df.withColumns({"diff_5": R.diff("close", 5, p), "shift_3": R.shift("close", 3, p)}))


@query("w07_returns", K + "pct:8 log_ret:8", "bars_1h", ctes={"nb": O.numbered()},
       sql="SELECT *, close / nullif(prev_close, 0) - 1 AS pct, ln(close / nullif(prev_close, 0)) AS log_ret FROM nb")
def w07(view):
    df, p = bars(view, 1)
    return own_rows(df.withColumns({"pct": R.pct_change("close", p), "log_ret": R.log_return("close", p)}))


@query("w08_normalised", K + "normalised:8", "bars_1h",
       sql=f"SELECT *, close / nullif(first_value(close) OVER {S}, 0) AS normalised FROM bars_1h")
def w08(view):
    df = prefix_scan(view("bars_1h"), {"_first": ("first", "close")})
    return df.withColumn("normalised", ratio("close", "_first"))


@query("w09_run_length", K + "sig:i run_id:i periods_since_change:i freshness:6", "bars_1h",
       ctes={"s": f"SELECT *, CASE WHEN close > avg(close) OVER {O.w(10)} THEN 1 ELSE -1 END AS sig FROM bars_1h",
             "c": f"SELECT *, CASE WHEN sig IS DISTINCT FROM lag(sig) OVER {S} THEN 1 ELSE 0 END AS changed FROM s",
             "r": f"SELECT *, sum(changed) OVER {S} AS run_id FROM c",
             "k": "SELECT *, row_number() OVER (PARTITION BY connector, trading_pair, run_id ORDER BY ts) - 1 AS periods_since_change FROM r"},
       sql="SELECT *, CASE WHEN periods_since_change = 0 THEN 1.0 ELSE greatest(0.2, 1 - periods_since_change / 50.0) END AS freshness FROM k")
def w09_w10(view):
    df, p = bars(view, 10)
    df = df.withColumn("sig", F.when(F.col("close") > R.mean("close", 10, p, partial=True), 1).otherwise(-1))
    df = df.withColumn("changed", (~F.col("sig").eqNullSafe(R.shift("sig", 1, p))).cast("int"))
    return run_age(own_rows(df))


def run_age(df, decay: int = 50, floor: float = 0.2):
    """Rows since the last change flag (running max of the change position) and freshness."""
    df = prefix_scan(df, {"run_id": ("sum", "changed"),
                          "_start": ("max", F.when(F.col("changed") == 1, F.col(POS)))})
    df = df.withColumn("periods_since_change", F.col(POS) - F.col("_start"))
    k = F.col("periods_since_change")
    return df.withColumn("freshness", F.when(k == 0, 1.0).otherwise(F.greatest(F.lit(floor), 1 - k / decay)))


@query("w11_rolling_slope", K + "slope:7 slope_partial:7 slope_weighted:7", "bars_1h",
       ctes={"nb": O.numbered()},
       sql=f"""SELECT *, CASE WHEN count(*) OVER {O.w(20)} >= 20 THEN regr_slope(close, i) OVER {O.w(20)} END AS slope,
CASE WHEN count(*) OVER {O.w(50)} > 1 THEN regr_slope(close, i) OVER {O.w(50)} ELSE 0 END AS slope_partial,
CASE WHEN count(*) OVER {O.w(20)} >= 20 THEN (sum(v) OVER {O.w(20)} * sum(v * i * close) OVER {O.w(20)}
 - sum(v * i) OVER {O.w(20)} * sum(v * close) OVER {O.w(20)})
 / nullif(sum(v) OVER {O.w(20)} * sum(v * i * i) OVER {O.w(20)} - (sum(v * i) OVER {O.w(20)}) * (sum(v * i) OVER {O.w(20)}), 0)
 END AS slope_weighted FROM (SELECT *, quote_asset_volume / 1000 AS v FROM nb)""")
def w11(view):
    df, p = bars(view, 50)
    df = df.withColumn("v", F.col("quote_asset_volume") / 1000)
    return own_rows(df.withColumns({
        "slope": R.slope("close", 20, p), "slope_partial": R.slope("close", 50, p, partial=True),
        "slope_weighted": R.weighted_slope("close", "v", 20, p)}))


@query("w12_rolling_percentile", K + "pct_86:6", "bars_1h",
       sql=f"SELECT *, quantile_cont(CASE WHEN n_trades % 3 = 0 THEN close END, 0.86) OVER {O.w(30)} AS pct_86 FROM bars_1h")
def w12(view):
    df, p = bars(view, 30)
    sparse = F.when(F.col("n_trades") % 3 == 0, F.col("close"))
    return own_rows(df.withColumn("pct_86", R.quantile(sparse, 0.86, 30, p)))


@query("w13_pivots", K + "pivot_high pivot_low", "bars_1h",
       sql=f"""SELECT *, close = max(close) OVER f AS pivot_high, close = min(close) OVER f AS pivot_low FROM bars_1h
WINDOW f AS (PARTITION BY connector, trading_pair ORDER BY ts ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)""")
def w13(view):
    df, p = bars(view, 7, ahead=7)
    high, low = R.pivot_flags("close", 7, 7, p)
    return own_rows(df.withColumns({"pivot_high": high, "pivot_low": low}))


def alma_sql(x: str, n: int, offset: float, sigma: float) -> str:
    """Weighted sum of lags, Gaussian weights computed in the statement."""
    m, s = offset * (n - 1), n / sigma
    terms = [f"lag({x}, {n - 1 - k}) OVER {S} * exp(-power({k} - {m!r}, 2) / {2 * s * s!r})" for k in range(n)]
    norm = " + ".join(f"exp(-power({k} - {m!r}, 2) / {2 * s * s!r})" for k in range(n))
    return f"(({' + '.join(terms)}) / ({norm}))"


@query("w14_alma", K + "alma:6", "bars_1h",
       sql=f"SELECT *, {alma_sql('close', 20, 0.85, 6.0)} AS alma FROM bars_1h")
def w14(view):
    df, p = bars(view, 20)
    return own_rows(df.withColumn("alma", R.alma("close", 20, 0.85, 6.0, p)))


@query("w15_donchian", K + "dcl:6 dcu:6", "bars_1h",
       sql=f"""SELECT *, CASE WHEN count(*) OVER {O.w(50)} >= 50 THEN min(low) OVER {O.w(50)} END AS dcl,
CASE WHEN count(*) OVER {O.w(50)} >= 50 THEN max(high) OVER {O.w(50)} END AS dcu FROM bars_1h""")
def w15(view):
    df, p = bars(view, 50)
    return own_rows(df.withColumns({"dcl": R.lowest("low", 50, p), "dcu": R.highest("high", 50, p)}))


@query("w16_cross", K + "crossed_over crossed_under", "bars_1h",
       ctes={"m": f"SELECT *, avg(close) OVER {O.w(5)} AS a, avg(close) OVER {O.w(20)} AS b FROM bars_1h"},
       sql=f"""SELECT *, coalesce(a > b AND lag(a) OVER {S} < lag(b) OVER {S}, false) AS crossed_over,
coalesce(a < b AND lag(a) OVER {S} > lag(b) OVER {S}, false) AS crossed_under FROM m""")
def w16(view):
    df, p = bars(view, 21)
    df = df.withColumns({"a": R.mean("close", 5, p, True), "b": R.mean("close", 20, p, True)})
    return own_rows(df.withColumns({
        "crossed_over": F.coalesce(R.crossed_over("a", "b", p), F.lit(False)),
        "crossed_under": F.coalesce(R.crossed_under("a", "b", p), F.lit(False))}))


FILL_KEY = "config_file_path, market, symbol"
FILL_ORDER = ("ts", "order_id", "fill_no", "tie", "amount", "price", "trade_fee_in_quote", "trade_type")
FILL_W = f"(PARTITION BY {FILL_KEY} ORDER BY {', '.join(FILL_ORDER)} ROWS UNBOUNDED PRECEDING)"


@query("w17_grouped_running_sum", "config_file_path symbol ts order_id fill_no tie cum_fees:3 cum_amount:3 fee_diff:4", "fills",
       sql=f"""SELECT *, sum(trade_fee_in_quote) OVER {FILL_W} AS cum_fees, sum(amount) OVER {FILL_W} AS cum_amount,
trade_fee_in_quote - lag(trade_fee_in_quote) OVER (PARTITION BY {FILL_KEY} ORDER BY {', '.join(FILL_ORDER)}) AS fee_diff FROM fills""")
def w17_w18(view):
    keys = FILL_KEY.split(", ")
    df = prefix_scan(view("fills"), {"cum_fees": ("sum", "trade_fee_in_quote"), "cum_amount": ("sum", "amount"),
                                     "_prev": ("prev", "trade_fee_in_quote")}, keys, FILL_ORDER,
                     segment_seconds=90 * 86400)
    return df.withColumn("fee_diff", F.col("trade_fee_in_quote") - F.col("_prev"))


@query("w20_depth_cumsum", "trading_pair side price amount cum_amount:4", "book",
       sql="""SELECT *, sum(amount) OVER (PARTITION BY trading_pair, side ORDER BY CASE WHEN side = 'bid' THEN -price ELSE price END
ROWS UNBOUNDED PRECEDING) AS cum_amount FROM book""")
def w20(view):
    from tickloom.plans.liquidity import with_depth
    return with_depth(view("book"))


@query("w21_bollinger", K + "mid:6 upper:6 lower:6 bbb:6 bbp:6", "bars_1h",
       ctes={"m": f"""SELECT *, count(*) OVER {O.w(20)} AS c, avg(close) OVER {O.w(20)} AS mm, stddev_pop(close) OVER {O.w(20)} AS sd FROM bars_1h"""},
       sql="""SELECT *, CASE WHEN c >= 20 THEN mm END AS mid, CASE WHEN c >= 20 THEN mm + 2 * sd END AS upper,
CASE WHEN c >= 20 THEN mm - 2 * sd END AS lower, CASE WHEN c >= 20 THEN 400 * sd / nullif(mm, 0) END AS bbb,
CASE WHEN c >= 20 THEN (close - (mm - 2 * sd)) / nullif(4 * sd, 0) END AS bbp FROM m""")
def w21(view):
    df, p = bars(view, 20)
    return own_rows(df.withColumns(R.bollinger(p, 20, 2.0)))


@query("w22_sma", K + "sma_20:6 sma_50:6", "bars_1h",
       sql=f"""SELECT *, CASE WHEN count(*) OVER {O.w(20)} >= 20 THEN avg(close) OVER {O.w(20)} END AS sma_20,
CASE WHEN count(*) OVER {O.w(50)} >= 50 THEN avg(close) OVER {O.w(50)} END AS sma_50 FROM bars_1h""")
def w22(view):
    df, p = bars(view, 50)
    return own_rows(df.withColumns({f"sma_{n}": R.mean("close", n, p) for n in (20, 50)}))


def stoch_ctes(src: str = "nb") -> dict[str, str]:
    return {
        "st0": f"""SELECT *, CASE WHEN i >= 13 THEN 100 * (close - min(low) OVER {O.w(14)})
 / nullif(max(high) OVER {O.w(14)} - min(low) OVER {O.w(14)}, 0) END AS raw FROM {src}""",
        "st1": f"SELECT *, CASE WHEN count(raw) OVER {O.w(3)} >= 3 THEN avg(raw) OVER {O.w(3)} END AS stoch_k FROM st0",
        "st2": f"SELECT *, CASE WHEN count(stoch_k) OVER {O.w(3)} >= 3 THEN avg(stoch_k) OVER {O.w(3)} END AS stoch_d FROM st1",
    }


@query("w23_stochastic", K + "stoch_k:6 stoch_d:6", "bars_1h", ctes={"nb": O.numbered(), **stoch_ctes()},
       sql="SELECT * FROM st2")
def w23(view):
    from tickloom.operators.recursive import stochastic
    df, p = bars(view, 20)
    return own_rows(stochastic(df, p))


@query("w24_true_range", K + "tr:6", "bars_1h", ctes={"nb": O.numbered()},
       sql=f"SELECT *, {O.TRUE_RANGE} AS tr FROM nb")
def w24(view):
    df, p = bars(view, 1)
    return own_rows(df.withColumn("tr", R.true_range(p)))


@query("w26_global_zscore", K + "z:6", "bars_1h",
       sql="""SELECT *, (close - avg(close) OVER (PARTITION BY connector, trading_pair))
 / nullif(stddev_samp(close) OVER (PARTITION BY connector, trading_pair), 0) AS z FROM bars_1h""")
def w26(view):
    b = view("bars_1h")
    stats = b.groupBy("connector", "trading_pair").agg(F.avg("close").alias("_m"), F.stddev_samp("close").alias("_s"))
    return b.join(stats, ["connector", "trading_pair"]).withColumn("z", ratio(F.col("close") - F.col("_m"), "_s"))
