"""A*, C*: reports, filters and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.catalog import oracle as O
from tickloom.catalog.features import volatility_ctes, volume_ctes
from tickloom.catalog.ingest import as_of
from tickloom.catalog.registry import query
from tickloom.catalog.signals import BB
from tickloom.operators.ingest import daily_volume
from tickloom.operators.layout import SERIES
from tickloom.plans import screeners as Sc
from tickloom.plans.features import Volatility, Volume
from tickloom.plans.signals import Bollinger
from tickloom.sources.fixtures import EVENTS_AS_OF, ORDERS_AS_OF

K = "connector trading_pair ts "


@query("a01_liquid_pairs", "trading_pair quote_asset_volume:2", "bars_1d",
       sql="""SELECT * FROM (SELECT trading_pair, sum(quote_asset_volume) AS quote_asset_volume FROM bars_1d GROUP BY 1)
QUALIFY quote_asset_volume >= quantile_cont(quote_asset_volume, 0.75) OVER ()""")
def a01(view):
    return Sc.liquid_pairs(view("bars_1d"))


REPORT_CTES = {
    "nb": O.numbered("bars_1d"), **volatility_ctes(), **volume_ctes(),
    "ra": "SELECT connector, trading_pair, avg(volatility) AS mean_volatility, avg(natr) AS mean_natr, avg(bb_width) AS mean_bb_width FROM volatility GROUP BY ALL",
    "rb": """SELECT connector, trading_pair, arg_max(buy_pressure_divergence, ts) AS buy_pressure_divergence, arg_max(buy_momentum, ts) AS buy_momentum,
arg_max(volume_surge, ts) AS volume_surge, arg_max(volume_buy_signal, ts) AS volume_buy_signal, arg_max(accumulation_score, ts) AS accumulation_score,
arg_max(distribution_score, ts) AS distribution_score, arg_max(close, ts) AS close, max(close) AS hi, min(close) AS lo,
sum(volume_usd) / (date_diff('second', min(ts), max(ts)) / 3600.0) AS average_volume_per_hour FROM volume_f GROUP BY connector, trading_pair""",
    "rc": """SELECT *, (hi - close) / close AS range_price_pct, coalesce((close - lo) / nullif(hi - lo, 0), 0.5) AS current_position
FROM ra JOIN rb USING (connector, trading_pair)""",
    "rd": """SELECT *, mean_natr * average_volume_per_hour * greatest(0.1, (buy_pressure_divergence + 1) / 2 * volume_surge)
 * (1 - abs(current_position - 0.5)) AS score FROM rc""",
    "report": "SELECT *, score / max(score) OVER () AS normalized_score FROM rd",
}


def report(view):
    return Sc.volume_volatility_report(view("bars_1d"), Volatility(30), Volume())


@query("a02_report", "trading_pair mean_volatility:6 mean_natr:6 mean_bb_width:5 buy_pressure_divergence:6 buy_momentum:6 volume_surge:6 "
       "accumulation_score:6 average_volume_per_hour:3 range_price_pct:6 current_position:6 normalized_score:6", "bars_1d",
       ctes=REPORT_CTES, sql="SELECT * FROM report")
def a02(view):
    return report(view)


@query("a03_select_markets", "trading_pair current_position:6 mean_natr:6", "bars_1d", ctes=REPORT_CTES,
       sql="""SELECT * FROM (SELECT *, quantile_cont(average_volume_per_hour, 0.5) OVER () AS vq, quantile_cont(mean_natr, 0.5) OVER () AS nq FROM report)
WHERE average_volume_per_hour > vq AND mean_natr > nq ORDER BY current_position DESC, trading_pair LIMIT 20""")
def a03(view):
    return Sc.select_markets(report(view))


@query("a04_momentum_lists", "list trading_pair buy_pressure_divergence:6", "bars_1d", ctes={**REPORT_CTES,
       "q": "SELECT *, quantile_cont(accumulation_score, 0.8) OVER () AS aq, quantile_cont(distribution_score, 0.8) OVER () AS dq FROM report"},
       sql="""(SELECT *, 'bullish' AS list FROM q WHERE buy_pressure_divergence > 0.05 ORDER BY buy_pressure_divergence DESC, trading_pair LIMIT 5)
UNION ALL (SELECT *, 'bearish' FROM q WHERE buy_pressure_divergence < -0.05 ORDER BY buy_pressure_divergence, trading_pair LIMIT 5)
UNION ALL (SELECT *, 'accumulation' FROM q WHERE accumulation_score > aq ORDER BY accumulation_score DESC, trading_pair LIMIT 5)
UNION ALL (SELECT *, 'distribution' FROM q WHERE distribution_score > dq ORDER BY distribution_score DESC, trading_pair LIMIT 5)""")
def a04(view):
    return Sc.momentum_lists(report(view))


SCREEN_CTES = {
    "t": """SELECT *, row_number() OVER (PARTITION BY connector, trading_pair ORDER BY ts DESC) AS r,
count(*) OVER (PARTITION BY connector, trading_pair) AS data_points FROM bars_1d""",
    "s0": """SELECT connector, trading_pair, arg_max(close, ts) AS price, arg_min(close, ts) AS first_close, sum(volume) AS volume_24h_base,
stddev_samp(close) AS sd, max(high) AS high_24h, min(low) AS low_24h, avg(volume) FILTER (WHERE r <= 6) AS rv,
avg(volume) FILTER (WHERE r > 6) AS ev, any_value(data_points) AS data_points FROM t WHERE r <= 24 AND data_points >= 24 GROUP BY connector, trading_pair""",
    "s1": """SELECT *, volume_24h_base * price AS volume_24h_usd, 100 * (price - first_close) / first_close AS price_change_24h_pct,
100 * sd / price AS volatility_pct, coalesce((price - low_24h) / nullif(high_24h - low_24h, 0), 0.5) AS position_in_range,
coalesce(100 * (rv - ev) / nullif(ev, 0), 0) AS volume_trend_pct FROM s0""",
    "screen": """SELECT *, volume_24h_usd / 1e6 * volatility_pct / 100 * (1 + abs(price_change_24h_pct) / 100) AS composite_score,
row_number() OVER (ORDER BY volume_24h_usd DESC, trading_pair) AS volume_rank FROM s1""",
}


@query("a05_screener_24", "trading_pair price:4 volume_24h_base:4 volume_24h_usd:3 price_change_24h_pct:6 volatility_pct:6 position_in_range:6 "
       "volume_trend_pct:5 composite_score:7 data_points:i volume_rank:i", "bars_1d", ctes=SCREEN_CTES, sql="SELECT * FROM screen")
def a05(view):
    return Sc.screener_24(view("bars_1d"))


@query("a06_summary", "total_volume:2 mean_change:6 biggest_gainer biggest_loser", "bars_1d", ctes=SCREEN_CTES,
       sql="""SELECT sum(volume_24h_usd) AS total_volume, avg(price_change_24h_pct) AS mean_change,
arg_max(trading_pair, price_change_24h_pct) AS biggest_gainer, arg_min(trading_pair, price_change_24h_pct) AS biggest_loser FROM screen""")
def a06(view):
    return Sc.screener_summary(Sc.screener_24(view("bars_1d")))


@query("c12_c13_categories", "trading_pair performance_category volume_category", "bars_1d", ctes=SCREEN_CTES,
       sql="""SELECT *, CASE WHEN price_change_24h_pct > 5 THEN 'Strong Gain' WHEN price_change_24h_pct > 1 THEN 'Moderate Gain'
WHEN price_change_24h_pct > -1 THEN 'Stable' WHEN price_change_24h_pct > -5 THEN 'Moderate Loss' ELSE 'Strong Loss' END AS performance_category,
CASE WHEN volume_24h_usd > q75 THEN 'Very High' WHEN volume_24h_usd > q50 THEN 'High' WHEN volume_24h_usd > q25 THEN 'Medium' ELSE 'Low' END AS volume_category
FROM (SELECT *, quantile_cont(volume_24h_usd, 0.25) OVER () AS q25, quantile_cont(volume_24h_usd, 0.5) OVER () AS q50,
quantile_cont(volume_24h_usd, 0.75) OVER () AS q75 FROM screen)""")
def c12_c13(view):
    r = Sc.screener_24(view("bars_1d"))
    return r.withColumns({"performance_category": Sc.change_category(), "volume_category": Sc.quartile_category()})


A07_COLS = ("mean_natr", "mean_bb_width", "log_volume", "current_position")


@query("a07_correlations", "x y correlation:6", "bars_1d", ctes={**REPORT_CTES, "r": "SELECT *, log10(average_volume_per_hour + 1) AS log_volume FROM report"},
       sql=" UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, corr({a}, {b}) AS correlation FROM r"
                              for i, a in enumerate(A07_COLS) for b in A07_COLS[i + 1:]))
def a07(view):
    r = report(view).withColumn("log_volume", F.log10(F.col("average_volume_per_hour") + 1))
    return Sc.correlation_matrix(r, A07_COLS)


# two-sided tail of Student's t with v degrees of freedom: finite series in the angle o = atan(t / sqrt(v)), for even and odd v
T_TAIL = """CASE WHEN v % 2 = 0 THEN 1 - sin(o) * (SELECT coalesce(sum(exp(lgamma(j + 0.5) - lgamma(j + 1)) / sqrt(pi()) * cos(o) ** (2 * j)), 0) FROM (SELECT unnest(range(0, v // 2)) AS j))
ELSE 1 - 2 / pi() * (o + sin(o) * (SELECT coalesce(sum(sqrt(pi()) / 2 * exp(lgamma(j) - lgamma(j + 0.5)) * cos(o) ** (2 * j - 1)), 0) FROM (SELECT unnest(range(1, (v - 1) // 2 + 1)) AS j))) END"""


@query("a08_regression", "connector trading_pair slope:6 intercept:5 r:6 stderr:6 p_value:6 n:i", "bars_1d",
       ctes={"m": """SELECT connector, trading_pair, regr_slope(close, volume) AS slope, regr_intercept(close, volume) AS intercept, corr(close, volume) AS r,
sqrt((1 - corr(close, volume) ^ 2) * regr_syy(close, volume) / (regr_sxx(close, volume) * (count(*) - 2))) AS stderr, count(*) AS n
FROM bars_1d GROUP BY ALL""", "t": "SELECT *, n - 2 AS v, atan(abs(slope / stderr) / sqrt(n - 2)) AS o FROM m"},
       sql=f"SELECT *, {T_TAIL} AS p_value FROM t")
def a08(view):
    return Sc.linear_regression(view("bars_1d"), "volume", "close", ["connector", "trading_pair"])


@query("a08_return_regression", "connector trading_pair slope:9 r:6 p_value:6 n:i", "bars_1d",
       ctes={"nb": O.numbered("bars_1d"), "d": "SELECT *, close / nullif(prev_close, 0) - 1 AS ret FROM nb",
             "m": """SELECT connector, trading_pair, regr_slope(ret, volume) AS slope, corr(ret, volume) AS r,
sqrt((1 - corr(ret, volume) ^ 2) * regr_syy(ret, volume) / (regr_sxx(ret, volume) * (count(ret) - 2))) AS stderr, count(ret) AS n
FROM d WHERE ret IS NOT NULL GROUP BY ALL""", "t": "SELECT *, n - 2 AS v, atan(abs(slope / stderr) / sqrt(n - 2)) AS o FROM m"},
       sql=f"SELECT *, {T_TAIL} AS p_value FROM t")
def a08_returns(view):
    from tickloom.operators.rolling import pct_change
    from tickloom.operators.layout import own_rows, segmented
    df, p = segmented(view("bars_1d"), 1)
    return Sc.linear_regression(own_rows(df.withColumn("ret", pct_change("close", p))), "volume", "ret", ["connector", "trading_pair"])


@query("a09_histogram", "connector trading_pair bin:i n:i", "bars_1d", ctes={"nb": O.numbered("bars_1d"),
       "d": "SELECT *, close / nullif(prev_close, 0) - 1 AS ret FROM nb",
       "e": "SELECT *, min(ret) OVER g AS lo, max(ret) OVER g AS hi FROM d WHERE ret IS NOT NULL WINDOW g AS (PARTITION BY connector, trading_pair)"},
       sql="SELECT connector, trading_pair, least(49, floor(coalesce((ret - lo) / nullif(hi - lo, 0), 0) * 50)) AS bin, count(*) AS n FROM e GROUP BY ALL")
def a09(view):
    from tickloom.operators.rolling import pct_change
    from tickloom.operators.layout import own_rows, segmented
    df, p = segmented(view("bars_1d"), 1)
    return Sc.histogram(own_rows(df.withColumn("ret", pct_change("close", p))), "ret")


@query("a10_class_distribution", "signal:i n:i", "bars_1h", ctes=BB, sql="SELECT signal, count(*) AS n FROM bbs GROUP BY signal")
def a10(view):
    return Sc.class_distribution(Bollinger(20).calculate(view("bars_1h")), "signal")


@query("a10_describe", "count:i mean:4 std:4 min:4 max:4",
       sql="SELECT count(o_totalprice) AS count, avg(o_totalprice) AS mean, stddev_samp(o_totalprice) AS std, min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders")
def a10_describe(view):
    return Sc.describe(view("orders"), "o_totalprice")


@query("a11_signal_statistics", "trading_pair buy_signals:i sell_signals:i neutral:i transitions:i mean_duration:6", "bars_1h",
       ctes={**BB, "c": f"SELECT *, signal IS DISTINCT FROM lag(signal) OVER {O.SERIES_W} AS turned FROM bbs"},
       sql="""SELECT trading_pair, count_if(signal = 1) AS buy_signals, count_if(signal = -1) AS sell_signals, count_if(signal = 0) AS neutral,
count_if(turned) AS transitions, count(*) / nullif(count_if(turned), 0) AS mean_duration FROM c GROUP BY trading_pair""")
def a11(view):
    return Sc.signal_statistics(Bollinger(20).calculate(view("bars_1h")))


TASK = """count(*) AS total_executions, count_if(status = 'completed') AS successful_executions, count_if(status = 'failed') AS failed_executions,
round(avg(duration_seconds), 2) AS avg_duration, max(duration_seconds) AS max_duration, min(duration_seconds) AS min_duration,
100.0 * count_if(status = 'completed') / count(*) AS success_rate"""
TASK_COLS = "total_executions:i successful_executions:i failed_executions:i avg_duration:2 max_duration:4 min_duration:4 success_rate:5"


@query("a12_task_metrics", "task_name " + TASK_COLS, "task_runs",
       sql=f"SELECT task_name, {TASK} FROM task_runs WHERE started_at >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 7 DAY GROUP BY task_name")
def a12(view):
    return Sc.task_metrics(view("task_runs"), as_of())


@query("a13_task_metrics_daily", "task_name bucket " + TASK_COLS, "task_runs",
       sql=f"SELECT task_name, date_trunc('day', started_at)::TIMESTAMP AS bucket, {TASK} FROM task_runs GROUP BY ALL")
def a13(view):
    return Sc.task_metrics(view("task_runs"), interval="1 day")


@query("a14_duration_anomalies", "execution_id:i task_name duration_seconds:4 mean_duration:6 std_duration:6", "task_runs",
       sql="""SELECT * FROM (SELECT *, avg(duration_seconds) OVER g AS mean_duration, stddev_samp(duration_seconds) OVER g AS std_duration FROM task_runs
WINDOW g AS (PARTITION BY task_name)) WHERE abs(duration_seconds - mean_duration) > 3 * std_duration""")
def a14(view):
    return Sc.duration_anomalies(view("task_runs"))


@query("a15_schedule_state", "task_name last_run run_count:i success_count:i failure_count:i average_duration_seconds:5", "task_runs",
       sql="""SELECT task_name, max(started_at) AS last_run, count(*) AS run_count, count_if(status = 'completed') AS success_count,
count_if(status = 'failed') AS failure_count, avg(duration_seconds) FILTER (WHERE status = 'completed' AND duration_seconds <> 0) AS average_duration_seconds
FROM task_runs GROUP BY task_name""")
def a15(view):
    return Sc.schedule_state(view("task_runs"))


DAILY = """SELECT connector, trading_pair, date_trunc('day', ts)::TIMESTAMP AS ts, sum(volume) AS volume, sum(taker_buy_base_volume) AS buy_volume,
sum(volume) - sum(taker_buy_base_volume) AS sell_volume FROM bars_1h b GROUP BY connector, trading_pair, date_trunc('day', ts)"""


@query("a19_daily_net_volume", K + "net_volume:3 cumulative_net:3 buy_pressure_pct:6", "bars_1h", ctes={"d": DAILY},
       sql=f"""SELECT *, buy_volume - sell_volume AS net_volume, sum(buy_volume - sell_volume) OVER {O.SERIES_W} AS cumulative_net,
100 * buy_volume / nullif(buy_volume + sell_volume, 0) AS buy_pressure_pct FROM d""")
def a19(view):
    return Sc.daily_net_volume(daily_volume(view("bars_1h")))


@query("a20_ranges", "trading_pair today_high:4 today_low:4 today_range_pct:4 week_high:4 week_low:4 week_range_pct:4", "bars_1h",
       sql="""SELECT trading_pair, coalesce(max(high) FILTER (WHERE today), 0) AS today_high, coalesce(min(low) FILTER (WHERE today), 0) AS today_low,
coalesce(100 * (max(high) FILTER (WHERE today) - min(low) FILTER (WHERE today)) / nullif(min(low) FILTER (WHERE today), 0), 0) AS today_range_pct,
max(high) FILTER (WHERE week) AS week_high, min(low) FILTER (WHERE week) AS week_low,
100 * (max(high) FILTER (WHERE week) - min(low) FILTER (WHERE week)) / nullif(min(low) FILTER (WHERE week), 0) AS week_range_pct
FROM (SELECT *, CAST(ts AS DATE) = DATE '2024-01-29' AS today, ts >= max(ts) OVER (PARTITION BY trading_pair) - INTERVAL 7 DAY AS week FROM bars_1h) GROUP BY trading_pair""")
def a20(view):
    return Sc.range_today_and_week(view("bars_1h"), as_of("2024-01-29 12:00:00"))


@query("a21_funding_metrics", "symbol avg_funding_72h:9 avg_funding_24h:9 current_funding_rate:9 mark_price:4", "funding_history",
       ctes={"h": f"""SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY funding_time DESC, id DESC) AS r FROM funding_history
WHERE funding_time >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 72 HOUR"""},
       sql="""SELECT symbol, avg(funding_rate) AS avg_funding_72h, avg(funding_rate) FILTER (WHERE r <= 8) AS avg_funding_24h,
any_value(funding_rate) FILTER (WHERE r = 1) AS current_funding_rate, any_value(mark_price) FILTER (WHERE r = 1) AS mark_price FROM h GROUP BY symbol""")
def a21(view):
    return Sc.funding_metrics(view("funding_history"), as_of())


CLUSTERS = "SELECT DISTINCT connector, trading_pair, CAST(substr(trading_pair, 2) AS INT) % 5 AS cluster FROM bars_1d"


def clusters(view):
    return view("bars_1d").select(*SERIES).distinct().withColumn("cluster", F.substring("trading_pair", 2, 9).cast("int") % 5)


@query("a22_cluster_metrics", "cluster:i trading_pair avg_volume:5 volume_stability:6 rank:i", "bars_1d", ctes={"cl": CLUSTERS,
       "m": "SELECT connector, trading_pair, avg(volume) AS avg_volume, stddev_samp(volume) / avg(volume) AS volume_stability FROM bars_1d GROUP BY 1, 2"},
       sql="""SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY avg_volume DESC, trading_pair) AS rank FROM cl LEFT JOIN m USING (connector, trading_pair) QUALIFY rank <= 3""")
def a22(view):
    return Sc.cluster_metrics(clusters(view), view("bars_1d"))


@query("a23_representatives", "cluster:i trading_pair avg_usd_volume:3 volatility:6 price_range:6 liquidity_score:2 composite_score:6 rank:i", "bars_1d",
       ctes={"nb": O.numbered("bars_1d"), "cl": CLUSTERS,
             "m": """SELECT connector, trading_pair, avg(volume * close) AS avg_usd_volume, stddev_samp(close / nullif(prev_close, 0) - 1) AS volatility,
(max(high) - min(low)) / avg(close) AS price_range FROM nb GROUP BY 1, 2""",
             "j": "SELECT *, avg_usd_volume / (volatility + 1e-10) AS liquidity_score FROM cl LEFT JOIN m USING (connector, trading_pair)",
             "n": """SELECT *, (avg_usd_volume - min(avg_usd_volume) OVER ()) / (max(avg_usd_volume) OVER () - min(avg_usd_volume) OVER ()) AS a,
(volatility - min(volatility) OVER ()) / (max(volatility) OVER () - min(volatility) OVER ()) AS b,
(liquidity_score - min(liquidity_score) OVER ()) / (max(liquidity_score) OVER () - min(liquidity_score) OVER ()) AS c FROM j"""},
       sql="""SELECT *, a * 0.6 + (1 - b) * 0.2 + c * 0.2 AS composite_score,
row_number() OVER (PARTITION BY cluster ORDER BY a * 0.6 + (1 - b) * 0.2 + c * 0.2 DESC, trading_pair) AS rank FROM n QUALIFY rank <= 2""")
def a23(view):
    return Sc.representative_markets(clusters(view), view("bars_1d"), 2)


@query("a24_cluster_returns", "cluster:i mean:6 std:6 count:i pairs:i", "bars_1d", ctes={"cl": CLUSTERS,
       "n": f"SELECT *, close / nullif(first_value(close) OVER {O.SERIES_W}, 0) AS v FROM bars_1d"},
       sql="SELECT cluster, avg(v) AS mean, stddev_samp(v) AS std, count(*) AS count, count(DISTINCT trading_pair) AS pairs FROM n JOIN cl USING (connector, trading_pair) GROUP BY cluster")
def a24(view):
    return Sc.cluster_return_stats(clusters(view), view("bars_1d"))


@query("a27_position_metrics", "trading_pair period:i max_price:4 min_price:4 current_price:4 position_from_high:6 range_price_pct:6", "bars_1d",
       ctes={"r": "SELECT *, row_number() OVER (PARTITION BY trading_pair ORDER BY ts DESC) AS r FROM bars_1d"},
       sql="""SELECT *, coalesce((max_price - current_price) / nullif(max_price - min_price, 0), 0) AS position_from_high, (max_price - current_price) / current_price AS range_price_pct
FROM (SELECT trading_pair, period, max(high) AS max_price, min(low) AS min_price, arg_max(close, ts) AS current_price
FROM r JOIN (VALUES (10), (50), (200)) p(period) ON r <= period GROUP BY trading_pair, period)""")
def a27(view):
    return Sc.position_metrics(view("bars_1d"), (10, 50, 200))


@query("c01_rules", "trading_pair base quote symbol min_order_size:4 min_notional_size:4", "trading_rules",
       sql="""SELECT *, split_part(trading_pair, '-', 1) AS base, split_part(trading_pair, '-', 2) AS quote, replace(trading_pair, '-', '') AS symbol
FROM trading_rules WHERE trading_pair LIKE '%-USDT' AND min_order_size <= 30 AND min_notional_size <= 100""")
def c01(view):
    return Sc.filter_rules(view("trading_rules"), quote="USDT", max_order_size=30, max_notional=100)


@query("c02_pair_symbols", "trading_pair symbol", "trading_rules", sql="SELECT DISTINCT trading_pair, replace(trading_pair, '-', '') AS symbol FROM trading_rules")
def c02(view):
    return Sc.split_pair(view("trading_rules").select("trading_pair").distinct())


POOL_CTES = {"clean": f"""SELECT *, trim(split_part(name, '/', 1)) AS base, trim(split_part(name, '/', 2)) AS quote,
TIMESTAMP '{ORDERS_AS_OF}' - age_days * INTERVAL 1 DAY AS pool_created_at, fdv_usd AS fdv, coalesce(v / nullif(r, 0), 0) AS volume_liquidity_ratio,
coalesce(f / nullif(r, 0), 0) AS fdv_liquidity_ratio, coalesce(f / nullif(v, 0), 0) AS fdv_volume_ratio FROM (
SELECT *, CAST(fdv_usd AS DOUBLE) AS f, CAST(volume_usd_h24 AS DOUBLE) AS v, CAST(reserve_in_usd AS DOUBLE) AS r,
CAST(transactions_h24_buys AS DOUBLE) AS buys, CAST(transactions_h24_sells AS DOUBLE) AS sells FROM pools)"""}
POOL_COLS = "pool_id:i base quote pool_created_at fdv_usd:3 volume_usd_h24:3 reserve_in_usd:3 "


def orders_as_of():
    return as_of(ORDERS_AS_OF)


@query("c03_pools_clean", POOL_COLS + "volume_liquidity_ratio:6 fdv_liquidity_ratio:6 fdv_volume_ratio:6", "pools", ctes=POOL_CTES,
       sql="SELECT * FROM clean WHERE quote = 'SOL'")
def c03(view):
    return Sc.clean_pools(view("pools"), orders_as_of())


@query("c04_pools_filter", POOL_COLS, "pools", ctes=POOL_CTES,
       sql=f"""SELECT * FROM clean WHERE quote = 'SOL' AND pool_created_at > TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 20 DAY AND f BETWEEN 70e3 AND 5e6
AND v >= 150e3 AND r >= 50e3 AND buys >= 50 AND sells >= 50""")
def c04(view):
    day = F.make_dt_interval(days=F.lit(20))
    return Sc.filter_pools(Sc.clean_pools(view("pools"), orders_as_of()), created_after=orders_as_of() - day, transactions=50)


@query("c05_pools_by_age", POOL_COLS, "pools", ctes=POOL_CTES,
       sql=f"""SELECT * FROM clean WHERE quote = 'SOL' AND pool_created_at < TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 7 DAY
AND pool_created_at > TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 720 DAY AND f > 1e6 AND f < 100e6 AND v > 100e3 AND r > 10e3""")
def c05(view):
    ago = lambda n: orders_as_of() - F.make_dt_interval(days=F.lit(n))
    return Sc.filter_pools(Sc.clean_pools(view("pools"), orders_as_of()), ago(720), ago(7), (1e6, 100e6), 100e3, 10e3, 0, True)


@query("c06_pool_summary", "source total:i filtered:i", "pools", ctes=POOL_CTES,
       sql="""SELECT 'top' AS source, count(*) AS total, count_if(f BETWEEN 70e3 AND 5e6 AND v >= 150e3 AND r >= 50e3 AND buys >= 50 AND sells >= 50) AS filtered FROM clean WHERE quote = 'SOL'
UNION ALL SELECT 'new', count(*), count_if(f BETWEEN 70e3 AND 5e6 AND v >= 150e3 AND r >= 50e3 AND buys >= 50 AND sells >= 50) FROM clean WHERE quote = 'SOL' AND age_days <= 10""")
def c06(view):
    p = Sc.clean_pools(view("pools"), orders_as_of())
    new = p.filter(F.col("age_days") <= 10)
    return Sc.pool_summary({"top": (p, Sc.filter_pools(p, transactions=50)), "new": (new, Sc.filter_pools(new, transactions=50))})


TRIALS = """SELECT o_custkey % 20 AS study, o_orderkey AS trial, CASE WHEN o_orderkey % 11 <> 0 THEN (o_totalprice - 200000) / 100000 END AS value,
o_orderkey % 97 AS user_attrs_total_executors, o_orderkey % 50 AS params_fast, o_orderkey % 200 AS params_slow FROM orders"""


def trials(view):
    k = F.col("o_orderkey")
    return view("orders").select(
        (F.col("o_custkey") % 20).alias("study"), k.alias("trial"),
        F.when(k % 11 != 0, (F.col("o_totalprice") - 200000) / 100000).alias("value"),
        (k % 97).alias("user_attrs_total_executors"), (k % 50).alias("params_fast"), (k % 200).alias("params_slow"))


@query("c07_c08_trials", "study:i trial:i value:6 total_executors:i fast:i slow:i", ctes={"t": TRIALS},
       sql="SELECT *, user_attrs_total_executors AS total_executors, params_fast AS fast, params_slow AS slow FROM t WHERE value > 0.5 AND user_attrs_total_executors > 40")
def c07_c08(view):
    return Sc.good_trials(Sc.tidy_trials(trials(view)))


@query("c09_best_trial", "study:i trial:i value:6 fast:i slow:i", ctes={"t": TRIALS},
       sql="""SELECT *, params_fast AS fast, params_slow AS slow FROM t WHERE value IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY study ORDER BY value DESC, trial) = 1""")
def c09(view):
    return Sc.best_trials(Sc.tidy_trials(trials(view)), ["study"], ["fast", "slow"])


CAND = """SELECT o_orderkey AS config_id, 'bin_perp' AS connector_name, concat('P', o_custkey % 9, '-USDT') AS base_trading_pair,
concat('P', (o_custkey + 3) % 9, '-USDT') AS quote_trading_pair, 1e2 AS base_start_price, 100 + o_orderkey % 9 * 1e0 AS base_end_price,
100 + o_orderkey % 5 * 5e-1 AS base_price, o_orderkey % 20 * 1e-4 AS base_step, 1 + o_orderkey % 60 AS base_levels,
5e1 AS quote_start_price, 50 + o_orderkey % 7 * 1e0 AS quote_end_price, 50 + o_orderkey % 4 * 1e0 AS quote_price,
o_orderkey % 13 * 1e-4 AS quote_step, 1 + o_orderkey % 70 AS quote_levels, 5e2 AS total_amount_quote FROM orders"""


def candidates(view):
    k = F.col("o_orderkey")
    c = F.col("o_custkey")
    return view("orders").select(
        k.alias("config_id"), F.lit("bin_perp").alias("connector_name"), F.concat(F.lit("P"), c % 9, F.lit("-USDT")).alias("base_trading_pair"),
        F.concat(F.lit("P"), (c + 3) % 9, F.lit("-USDT")).alias("quote_trading_pair"), F.lit(100.0).alias("base_start_price"),
        (100 + k % 9 * 1.0).alias("base_end_price"), (100 + k % 5 * 0.5).alias("base_price"), (k % 20 * 1e-4).alias("base_step"),
        (1 + k % 60).alias("base_levels"), F.lit(50.0).alias("quote_start_price"), (50 + k % 7 * 1.0).alias("quote_end_price"),
        (50 + k % 4 * 1.0).alias("quote_price"), (k % 13 * 1e-4).alias("quote_step"), (1 + k % 70).alias("quote_levels"),
        F.lit(500.0).alias("total_amount_quote"))


@query("c10_candidates", "config_id:i base_range:6 quote_range:6 base_distance:6 quote_distance:6", ctes={"c": CAND, "d": """SELECT *,
base_end_price / base_start_price - 1 AS base_range, quote_end_price / quote_start_price - 1 AS quote_range FROM c""",
       "e": """SELECT *, (base_price / base_start_price - 1) / nullif(base_range, 0) AS base_distance,
1 - (quote_price / quote_start_price - 1) / nullif(quote_range, 0) AS quote_distance FROM d"""},
       sql="""SELECT * FROM e WHERE base_step <= 1e-3 AND quote_step <= 1e-3 AND base_range > 0 AND quote_range > 0 AND base_distance < 4e-1 AND quote_distance < 4e-1
AND base_range / quote_range BETWEEN 5e-1 AND 2 AND base_start_price < base_price AND base_price < base_end_price
AND quote_start_price < quote_price AND quote_price < quote_end_price AND 500 / base_levels <= 20 AND 500 / quote_levels <= 20""")
def c10(view):
    return Sc.valid_candidates(candidates(view))


@query("c11_adjusted", "config_id:i id total_amount_quote:2 min_order_amount_quote:4", ctes={"c": CAND},
       sql="""SELECT config_id, concat('bin-perp||', base_trading_pair, '||', quote_trading_pair, '||2001||isoweek48_6-1320') AS id, 200.0 AS total_amount_quote,
greatest(o_custkey % 9, (o_custkey + 3) % 9) * 1.5 + 7.5 AS min_order_amount_quote FROM c JOIN orders ON o_orderkey = config_id""")
def c11(view):
    pairs = candidates(view).select(F.col("base_trading_pair").alias("trading_pair")).distinct()
    notionals = pairs.withColumn("min_notional", F.substring("trading_pair", 2, 1).cast("double") + 5)
    return Sc.adjust_candidates(candidates(view), notionals, as_of("2001-12-01 13:27:45"), 200.0)


@query("c14_signal_validity", "valid n:i", sql="""SELECT coalesce(value BETWEEN -1 AND 1 AND category IN ('tf', 'mr', 'pt'), false) AS valid, count(*) AS n FROM (
SELECT (value - 50) / 50 AS value, CASE event_id % 4 WHEN 0 THEN 'tf' WHEN 1 THEN 'mr' WHEN 2 THEN 'pt' ELSE 'xx' END AS category FROM events) GROUP BY 1""")
def c14(view):
    k = F.col("event_id") % 4
    s = view("events").select(((F.col("value") - 50) / 50).alias("value"), F.when(k == 0, "tf").when(k == 1, "mr").when(k == 2, "pt").otherwise("xx").alias("category"))
    good, bad = Sc.valid_signals(s)
    both = good.select(F.lit(True).alias("valid")).unionByName(bad.select(F.lit(False).alias("valid")))
    return both.groupBy("valid").agg(F.count(F.lit(1)).alias("n"))


@query("c15_drop_nulls", K + "sd:6", "bars_1h",
       sql=f"SELECT * FROM (SELECT *, CASE WHEN count(*) OVER {O.w(100)} >= 100 THEN stddev_samp(close) OVER {O.w(100)} END AS sd FROM bars_1h) WHERE sd IS NOT NULL")
def c15(view):
    from tickloom.operators.layout import own_rows, segmented
    from tickloom.operators.rolling import std
    df, p = segmented(view("bars_1h"), 100)
    return own_rows(df.withColumn("sd", std("close", 100, p))).na.drop(subset=["sd"])
