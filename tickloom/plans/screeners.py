"""Market reports, filters and roll-ups.

Reports hold one row per symbol; global quantiles, ranks and min/max run over those rows only, never
over bars.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.functions.columns import ratio
from tickloom.operators.joins import latest_rows
from tickloom.operators.layout import SERIES, join_series, prefix_scan
from tickloom.plans.features import Volatility, Volume


#: Parts a key's rows are ranked in before its first rows are merged.
SALTS = 64


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows per key. Rows are cut to n per (key, salt) first and per key then, so a hot key's
    rows are ranked in many tasks whatever n is."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(SALTS))
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    cut = df.withColumn("_salt", salt).withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= n).drop("_salt", "_r")
    final = Window.partitionBy(*keys).orderBy(*order)
    return cut.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= n)


def rank_rows(report: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Position in a report with one row per symbol."""
    return report.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def across(aggregate: Column) -> Column:
    """An aggregate over all rows of a report (one row per symbol), next to each row; the report is
    computed once, where a subquery would compute it again."""
    return aggregate.over(Window.partitionBy(F.lit(0)))


# --- selection -----------------------------------------------------------------------------------

def liquid_pairs(bars: DataFrame, quantile: float = 0.75) -> DataFrame:
    """Markets whose total quote volume reaches the quantile over markets."""
    totals = bars.groupBy(*SERIES).agg(F.sum("quote_asset_volume").alias("quote_asset_volume"))
    totals = totals.withColumn("_cut", across(F.percentile("quote_asset_volume", quantile)))
    return totals.filter(F.col("quote_asset_volume") >= F.col("_cut")).drop("_cut")


def volume_volatility_report(bars: DataFrame, volatility: Volatility, volume: Volume) -> DataFrame:
    """One row per pair: mean volatilities, newest momentum fields, volume per hour, position
    in the close range and a score normalised by the best pair."""
    newest = ["buy_pressure_divergence", "buy_momentum", "volume_surge", "volume_buy_signal",
              "accumulation_score", "distribution_score", "close"]
    # chained, so that the series are numbered once, and one aggregate per market
    both = volume.calculate(volatility.calculate(bars))
    r = both.groupBy(*SERIES).agg(
        F.avg("volatility").alias("mean_volatility"), F.avg("natr").alias("mean_natr"), F.avg("bb_width").alias("mean_bb_width"),
        F.max_by(F.struct(*newest), "ts").alias("_n"), F.sum("volume_usd").alias("_usd"),
        F.min("ts").alias("_t0"), F.max("ts").alias("_t1"), F.max("close").alias("_hi"), F.min("close").alias("_lo"))
    r = r.select("*", "_n.*").drop("_n")
    hours = (F.unix_micros(F.col("_t1").cast("timestamp")) - F.unix_micros(F.col("_t0").cast("timestamp"))) / 3.6e9
    span = F.col("_hi") - F.col("_lo")
    r = r.withColumns({
        "average_volume_per_hour": ratio("_usd", hours),
        "range_price_pct": ratio(F.col("_hi") - F.col("close"), "close"),
        "current_position": F.when(span > 0, ratio(F.col("close") - F.col("_lo"), span)).otherwise(0.5)})
    leaning = F.coalesce((F.col("buy_pressure_divergence") + 1) / 2, F.lit(0.5))
    r = r.withColumn("_score", F.col("mean_natr") * F.col("average_volume_per_hour")
                     * F.greatest(F.lit(0.1), leaning * F.col("volume_surge"))
                     * (1 - F.abs(F.col("current_position") - 0.5)))
    r = r.withColumn("_best", across(F.max("_score")))
    score = F.when(F.col("_best") > 0, F.col("_score") / F.col("_best")).otherwise(0.0)
    return r.withColumn("normalized_score", score).drop(
        "_score", "_best", "_usd", "_t0", "_t1", "_hi", "_lo")


def select_markets(report: DataFrame, volume_quantile: float = 0.5, natr_quantile: float = 0.5, top: int = 20) -> DataFrame:
    """Active and volatile markets, highest position first."""
    r = report.withColumns({"_v": across(F.percentile("average_volume_per_hour", volume_quantile)),
                            "_n": across(F.percentile("mean_natr", natr_quantile))})
    r = r.filter((F.col("average_volume_per_hour") > F.col("_v")) & (F.col("mean_natr") > F.col("_n"))).drop("_v", "_n")
    return r.orderBy(F.desc("current_position"), "trading_pair").limit(top)


def momentum_lists(report: DataFrame, threshold: float = 0.05, quantile: float = 0.8, top: int = 5) -> DataFrame:
    """bullish/bearish divergence and accumulation/distribution zones, top rows of each list."""
    div, acc, dist = (F.col(c) for c in ("buy_pressure_divergence", "accumulation_score", "distribution_score"))
    r = report.withColumns({"_a": across(F.percentile(acc, quantile)), "_d": across(F.percentile(dist, quantile))})
    lists = {"bullish": (div > threshold, div), "bearish": (div < -threshold, -div),
             "accumulation": (acc > F.col("_a"), acc), "distribution": (dist > F.col("_d"), dist)}
    entry = F.array(*[F.when(cond, F.struct(F.lit(n).alias("list"), key.alias("_key"))) for n, (cond, key) in lists.items()])
    r = r.withColumn("_e", F.explode(F.filter(entry, lambda e: e.isNotNull()))).select("*", "_e.*")
    return top_per_group(r, ["list"], [F.desc("_key"), F.asc("trading_pair")], top).drop("_e", "_key", "_a", "_d", "rank")


def screener_24(bars: DataFrame, n: int = 24, recent: int = 6) -> DataFrame:
    """Screener over the last 24 bars of each series that has as many.

    The tail comes from the series' last bars by a salted top-n, not from a sort of the series.
    """
    tail = top_per_group(bars.select(*SERIES, "ts", "high", "low", "close", "volume"), [*SERIES], [F.desc("ts")], n)
    count = bars.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("data_points"))
    new, old = F.col("rank") <= recent, F.col("rank") > recent
    t = tail.groupBy(*SERIES).agg(
        F.max_by("close", "ts").alias("price"), F.min_by("close", "ts").alias("_first"),
        F.sum("volume").alias("volume_24h_base"), F.stddev_samp("close").alias("_sd"),
        F.max("high").alias("high_24h"), F.min("low").alias("low_24h"),
        F.avg(F.when(new, F.col("volume"))).alias("_rv"), F.avg(F.when(old, F.col("volume"))).alias("_ev"))
    t = join_series(t, count).filter(F.col("data_points") >= n)
    price, span = F.col("price"), F.col("high_24h") - F.col("low_24h")
    t = t.withColumns({
        "volume_24h_usd": F.col("volume_24h_base") * price,
        "price_change_24h_pct": F.when(F.col("_first") > 0, ratio(100 * (price - F.col("_first")), "_first")).otherwise(0.0),
        "volatility_pct": F.when(price > 0, ratio(100 * F.col("_sd"), price)).otherwise(0.0),
        "position_in_range": F.when(span > 0, ratio(price - F.col("low_24h"), span)).otherwise(0.5),
        "volume_trend_pct": F.when(F.col("_ev") > 0, ratio(100 * (F.col("_rv") - F.col("_ev")), "_ev")).otherwise(0.0)})
    t = t.withColumn("composite_score", F.col("volume_24h_usd") / 1e6 * F.col("volatility_pct") / 100
                     * (1 + F.abs("price_change_24h_pct") / 100))
    return rank_rows(t.drop("_first", "_sd", "_rv", "_ev"), [F.desc("volume_24h_usd"), F.asc("trading_pair")], "volume_rank")


def screener_summary(report: DataFrame) -> DataFrame:
    """A06"""
    change = F.struct("price_change_24h_pct", "trading_pair")
    return report.agg(
        F.sum("volume_24h_usd").alias("total_volume"), F.avg("price_change_24h_pct").alias("mean_change"),
        F.max_by("trading_pair", change).alias("biggest_gainer"), F.min_by("trading_pair", change).alias("biggest_loser"))


def change_category(c: str = "price_change_24h_pct") -> Column:
    """C12"""
    x = F.col(c)
    return (F.when(x > 5, "Strong Gain").when(x > 1, "Moderate Gain").when(x > -1, "Stable")
            .when(x > -5, "Moderate Loss").otherwise("Strong Loss"))


def quartile_category(c: str = "volume_24h_usd") -> Column:
    """Label by the report's own quartiles."""
    q = {p: across(F.percentile(c, p)) for p in (0.25, 0.5, 0.75)}
    x = F.col(c)
    return F.when(x > q[0.75], "Very High").when(x > q[0.5], "High").when(x > q[0.25], "Medium").otherwise("Low")


# --- statistics over reports ---------------------------------------------------------------------

def correlation_matrix(report: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long form, every unordered column pair in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    row = report.agg(*[F.corr(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"_{i}").alias("correlation"))
                      for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(cells).alias("_c")).select("_c.*")


def linear_regression(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Slope, intercept, r, standard error and two-sided p-value, from one moment aggregate."""
    from tickloom.functions.stats import student_t_two_sided
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    m = df.groupBy(*keys).agg(
        F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"), F.corr(a, b).alias("r"),
        F.regr_count(b, a).alias("n"), F.regr_sxx(b, a).alias("_sxx"), F.regr_syy(b, a).alias("_syy"))
    dof = F.col("n") - 2
    err = F.sqrt(F.greatest(ratio((1 - F.col("r") * F.col("r")) * F.col("_syy"), F.col("_sxx") * dof), F.lit(0.0)))
    m = m.withColumn("stderr", err)
    return m.withColumn("p_value", student_t_two_sided(ratio("slope", "stderr"), dof)).drop("_sxx", "_syy")


def histogram(df: DataFrame, x: str, bins: int = 50, keys: Sequence[str] = SERIES) -> DataFrame:
    """Counts in equal-width bins between min and max (the maximum falls in the last bin)."""
    d = df.filter(F.col(x).isNotNull())
    ends = d.groupBy(*keys).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    pos = ratio(F.col(x) - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    b = F.least(F.lit(bins - 1), F.floor(F.coalesce(pos, F.lit(0.0)) * bins)).cast("int")
    return join_series(d, ends, keys).groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """A10"""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def describe(df: DataFrame, x: str) -> DataFrame:
    """A10: count, mean, std, min and max of a column."""
    return df.agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
                  F.min(x).alias("min"), F.max(x).alias("max"))


def signal_statistics(signals: DataFrame) -> DataFrame:
    """Counts per side, transitions (the first bar counts as one) and mean duration."""
    s = prefix_scan(signals.select(*SERIES, "ts", "signal"), {"_p": ("prev", "signal")})
    turned = ~F.col("signal").eqNullSafe(F.col("_p"))
    out = s.groupBy(*SERIES).agg(
        F.count_if(F.col("signal") == 1).alias("buy_signals"), F.count_if(F.col("signal") == -1).alias("sell_signals"),
        F.count_if(F.col("signal") == 0).alias("neutral"), F.count_if(turned).alias("transitions"),
        F.count(F.lit(1)).alias("_n"))
    return out.withColumn("mean_duration", ratio("_n", "transitions")).drop("_n")


def range_today_and_week(bars: DataFrame, as_of: Column) -> DataFrame:
    """High-low range in percent of today and of the last 7 days of data."""
    last = bars.groupBy(*SERIES).agg(F.max("ts").alias("_last"))
    today = F.to_date("ts") == F.to_date(as_of)
    week = F.col("ts") >= F.col("_last") - F.make_dt_interval(days=F.lit(7))
    hi = lambda c: F.max(F.when(c, F.col("high")))
    lo = lambda c: F.min(F.when(c, F.col("low")))
    out = join_series(bars, last).groupBy(*SERIES).agg(
        hi(today).alias("_th"), lo(today).alias("_tl"), hi(week).alias("week_high"), lo(week).alias("week_low"))
    return out.select(
        *SERIES, F.coalesce("_th", F.lit(0.0)).alias("today_high"), F.coalesce("_tl", F.lit(0.0)).alias("today_low"),
        F.coalesce(ratio(100 * (F.col("_th") - F.col("_tl")), "_tl"), F.lit(0.0)).alias("today_range_pct"),
        "week_high", "week_low", ratio(100 * (F.col("week_high") - F.col("week_low")), "week_low").alias("week_range_pct"))


def daily_net_volume(daily: DataFrame) -> DataFrame:
    """Net volume, running net and buy share of each day."""
    d = daily.withColumn("net_volume", F.col("buy_volume") - F.col("sell_volume"))
    d = prefix_scan(d, {"cumulative_net": ("sum", "net_volume")})
    return d.withColumn("buy_pressure_pct", ratio(100 * F.col("buy_volume"), F.col("buy_volume") + F.col("sell_volume")))


def funding_metrics(history: DataFrame, as_of: Column, hours: int = 72, n: int = 8) -> DataFrame:
    """Mean of the last 8 rates and of the last 72 hours, newest rate and mark."""
    h = history.filter(F.col("funding_time") >= as_of - F.make_dt_interval(hours=F.lit(hours)))
    at = F.struct("funding_time", "id")
    whole = h.groupBy("symbol").agg(
        F.avg("funding_rate").alias("avg_funding_72h"), F.max_by("funding_rate", at).alias("current_funding_rate"),
        F.max_by("mark_price", at).alias("mark_price"))
    tail = top_per_group(h, ["symbol"], [F.desc("funding_time"), F.desc("id")], n)
    return whole.join(tail.groupBy("symbol").agg(F.avg("funding_rate").alias("avg_funding_24h")), "symbol")


def cluster_metrics(clusters: DataFrame, bars: DataFrame, top: int = 3) -> DataFrame:
    """Mean volume and std/mean stability per market, top markets per cluster by volume."""
    m = bars.groupBy(*SERIES).agg(
        F.avg("volume").alias("avg_volume"), ratio(F.stddev_samp("volume"), F.avg("volume")).alias("volume_stability"))
    df = join_series(clusters, m, how="left").fillna(0.0, ["avg_volume"])
    return top_per_group(df, ["cluster"], [F.desc("avg_volume"), F.asc("trading_pair"), F.asc("connector")], top)


def representative_markets(clusters: DataFrame, bars: DataFrame, top: int = 1) -> DataFrame:
    """Volume, volatility and liquidity normalised over all markets, weighted 0.6/0.2/0.2, best
    markets per cluster."""
    b = prefix_scan(bars, {"_p": ("prev", "close")})
    usd = F.col("volume") * F.col("close")
    m = b.groupBy(*SERIES).agg(
        F.avg(usd).alias("avg_usd_volume"), ratio(F.stddev_samp(usd), F.avg(usd)).alias("volume_stability"),
        F.stddev_samp(ratio("close", "_p") - 1).alias("volatility"), F.avg("close").alias("price_mean"),
        F.count(F.lit(1)).alias("n_trades"),
        ratio(F.max("high") - F.min("low"), F.avg("close")).alias("price_range"))
    m = m.withColumn("liquidity_score", F.col("avg_usd_volume") / (F.col("volatility") + 1e-10))
    df = join_series(clusters, m, how="left")
    scaled = {}
    for c in ("avg_usd_volume", "volatility", "liquidity_score"):
        lo, hi = across(F.min(c)), across(F.max(c))
        scaled[c] = F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(0.0)
    df = df.withColumn("composite_score", scaled["avg_usd_volume"] * 0.6 + (1 - scaled["volatility"]) * 0.2
                       + scaled["liquidity_score"] * 0.2)
    return top_per_group(df, ["cluster"], [F.desc("composite_score"), F.asc("trading_pair"), F.asc("connector")], top)


def cluster_return_stats(clusters: DataFrame, bars: DataFrame) -> DataFrame:
    """Normalised price (close / first close) statistics per cluster."""
    b = prefix_scan(bars.select(*SERIES, "ts", "close"), {"_f": ("first", "close")})
    b = join_series(b.withColumn("normalised", ratio("close", "_f")), clusters)
    return b.groupBy("cluster").agg(
        F.avg("normalised").alias("mean"), F.stddev_samp("normalised").alias("std"),
        F.count(F.lit(1)).alias("count"), F.countDistinct(*SERIES).alias("pairs"))


def relationship_counts(pairs: DataFrame) -> DataFrame:
    """Numbers of pairs by p-value and correlation band and by quadrant."""
    p, c = F.col("p_value"), F.col("correlation")
    strong, linked = F.abs(c) > 0.7, p < 0.05
    return pairs.agg(
        F.count_if(linked).alias("p_below_005"), F.count_if(p < 0.1).alias("p_below_010"),
        F.count_if(strong).alias("corr_above_07"), F.count_if(F.abs(c) > 0.3).alias("corr_above_03"),
        F.count_if(strong & linked).alias("both"), F.count_if(strong & ~linked).alias("corr_only"),
        F.count_if(~strong & linked).alias("coint_only"), F.count_if(~strong & ~linked).alias("neither"))


def accepted_pairs(directed: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Pairs of a venue whose both directions pass, with the mean p-value; with cuts, per cut."""
    return directed.groupBy("connector", *(["cut"] if "cut" in directed.columns else []),
                            F.least("base", "quote").alias("pair1"), F.greatest("base", "quote").alias("pair2")).agg(
        F.bool_and(F.col("p_value") < threshold).alias("_ok"), F.count(F.lit(1)).alias("_n"),
        F.avg("p_value").alias("coint_value")).filter(F.col("_ok") & (F.col("_n") == 2)).drop("_ok", "_n")


def position_metrics(bars: DataFrame, lookbacks: Sequence[int]) -> DataFrame:
    """One row per series and lookback; position 0 is at the high here, 1 at the low."""
    tail = top_per_group(bars.select(*SERIES, "ts", "high", "low", "close"), [*SERIES], [F.desc("ts")], max(lookbacks))
    d = tail.withColumn("period", F.explode(F.array(*[F.lit(n) for n in lookbacks]))).filter(F.col("rank") <= F.col("period"))
    m = d.groupBy(*SERIES, "period").agg(F.max("high").alias("max_price"), F.min("low").alias("min_price"),
                                         F.max_by("close", "ts").alias("current_price"))
    drop = F.col("max_price") - F.col("current_price")
    return m.withColumns({
        "position_from_high": F.coalesce(ratio(drop, F.col("max_price") - F.col("min_price")), F.lit(0.0)),
        "range_price_pct": ratio(drop, "current_price")})


# --- tasks ---------------------------------------------------------------------------------------

def task_metrics(runs: DataFrame, as_of: Column | None = None, days: int = 7, interval: str | None = None) -> DataFrame:
    """Counts, success rate and durations per task, optionally per time bucket."""
    r = runs if as_of is None else runs.filter(F.col("started_at") >= as_of - F.make_dt_interval(days=F.lit(days)))
    keys = ["task_name"]
    if interval:
        r = r.withColumn("bucket", F.window("started_at", interval)["start"])
        keys.append("bucket")
    done, failed = F.col("status") == "completed", F.col("status") == "failed"
    m = r.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_executions"), F.count_if(done).alias("successful_executions"),
        F.count_if(failed).alias("failed_executions"), F.round(F.avg("duration_seconds"), 2).alias("avg_duration"),
        F.max("duration_seconds").alias("max_duration"), F.min("duration_seconds").alias("min_duration"))
    return m.withColumn("success_rate", ratio(100 * F.col("successful_executions"), "total_executions"))


def duration_anomalies(runs: DataFrame, k: float = 3.0) -> DataFrame:
    """Runs further than k standard deviations from their task's mean duration."""
    s = runs.groupBy("task_name").agg(F.avg("duration_seconds").alias("mean_duration"),
                                      F.stddev_samp("duration_seconds").alias("std_duration"))
    away = F.abs(F.col("duration_seconds") - F.col("mean_duration"))
    return runs.join(s, "task_name").filter(away > k * F.col("std_duration"))


def schedule_state(runs: DataFrame) -> DataFrame:
    """Last run, counters and mean duration of completed runs, recomputed in one aggregate."""
    done = F.col("status") == "completed"
    return runs.groupBy("task_name").agg(
        F.max("started_at").alias("last_run"), F.count(F.lit(1)).alias("run_count"),
        F.count_if(done).alias("success_count"), F.count_if(F.col("status") == "failed").alias("failure_count"),
        F.avg(F.when(done & (F.col("duration_seconds") != 0), F.col("duration_seconds"))).alias("average_duration_seconds"))


# --- rules and pools -----------------------------------------------------------------------------

def split_pair(df: DataFrame) -> DataFrame:
    parts = F.split("trading_pair", "-")
    return df.withColumns({"base": parts[0], "quote": F.try_element_at(parts, F.lit(2)),
                           "symbol": F.replace("trading_pair", F.lit("-"), F.lit(""))})


def filter_rules(rules: DataFrame, base: str | None = None, quote: str | None = None, pair: str | None = None,
                 max_order_size=None, max_notional=None) -> DataFrame:
    """Trading rules by base, quote, pair and upper bounds of the minimum sizes."""
    r = split_pair(rules)
    for cond in ((base and F.col("base") == base), (quote and F.col("quote") == quote), (pair and F.col("trading_pair") == pair),
                 (max_order_size is not None and F.col("min_order_size") <= F.lit(max_order_size).cast("decimal(38,18)")),
                 (max_notional is not None and F.col("min_notional_size") <= F.lit(max_notional).cast("decimal(38,18)"))):
        if isinstance(cond, Column):
            r = r.filter(cond)
    return r


def clean_pools(pools: DataFrame, as_of: Column, quote: str | None = "SOL") -> DataFrame:
    """Text to numbers, names to base/quote, creation date, zero-safe ratios, quote filter."""
    p = pools.withColumns({c: F.col(c).try_cast("double") for c in (
        "fdv_usd", "volume_usd_h24", "reserve_in_usd", "transactions_h24_buys", "transactions_h24_sells")})
    name = F.split("name", "/")
    safe = lambda a, b: F.when(F.col(b) != 0, ratio(a, b)).otherwise(0.0)
    p = p.withColumns({
        "base": F.trim(name[0]), "quote": F.trim(F.try_element_at(name, F.lit(2))),
        "pool_created_at": as_of - F.make_dt_interval(days=F.col("age_days").cast("int")),
        "volume_liquidity_ratio": safe("volume_usd_h24", "reserve_in_usd"),
        "fdv_liquidity_ratio": safe("fdv_usd", "reserve_in_usd"),
        "fdv_volume_ratio": safe("fdv_usd", "volume_usd_h24")})
    return p.filter(F.col("quote") == quote) if quote else p


def filter_pools(pools: DataFrame, created_after: Column | None = None, created_before: Column | None = None,
                 fdv: tuple[float, float] = (70e3, 5e6), volume: float = 150e3, liquidity: float = 50e3,
                 transactions: float = 300, open_interval: bool = False) -> DataFrame:
    """Age, valuation, volume, liquidity and activity. ``open_interval`` excludes the bounds."""
    v = F.col("fdv_usd")
    more = (lambda a, b: a > b) if open_interval else (lambda a, b: a >= b)
    cond = more(v, F.lit(fdv[0])) & more(F.lit(fdv[1]), v) & more(F.col("volume_usd_h24"), F.lit(volume)) & more(
        F.col("reserve_in_usd"), F.lit(liquidity))
    if transactions:
        cond = cond & (F.col("transactions_h24_buys") >= transactions) & (F.col("transactions_h24_sells") >= transactions)
    if created_after is not None:
        cond = cond & (F.col("pool_created_at") > created_after)
    if created_before is not None:
        cond = cond & (F.col("pool_created_at") < created_before)
    return pools.filter(cond)


def pool_summary(sets: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Total and filtered counts per source set (top pools, new pools, ...)."""
    out = None
    for name, (every, kept) in sets.items():
        both = every.select(F.lit(0).alias("_k")).unionByName(kept.select(F.lit(1).alias("_k")))
        one = both.agg(F.count_if(F.col("_k") == 0).alias("total"), F.count_if(F.col("_k") == 1).alias("filtered")).select(
            F.lit(name).alias("source"), "total", "filtered")
        out = one if out is None else out.unionByName(one)
    return out


# --- trials --------------------------------------------------------------------------------------

def tidy_trials(trials: DataFrame) -> DataFrame:
    """Complete rows only, parameter and attribute prefixes removed."""
    strip = lambda c: c.removeprefix("params_").removeprefix("user_attrs_")
    return trials.na.drop("any").toDF(*[strip(c) for c in trials.columns])


def good_trials(trials: DataFrame, value: float = 0.5, executors: int = 40) -> DataFrame:
    """C08"""
    return trials.filter((F.col("value") > value) & (F.col("total_executors") > executors)).orderBy(F.desc("value"))


def best_trials(trials: DataFrame, study: Sequence[str], params: Sequence[str]) -> DataFrame:
    """The best trial per study and its parameters; the earlier trial wins a tie."""
    return latest_rows(trials.select(*study, "trial", "value", *params), study,
                       F.struct("value", -F.col("trial")))


def valid_signals(signals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """C14: (valid, quarantined): value in [-1, 1] and a known category."""
    ok = F.coalesce(F.col("value").between(-1.0, 1.0) & F.col("category").isin("tf", "mr", "pt"), F.lit(False))
    return signals.filter(ok), signals.filter(~ok)


# --- pair-grid candidates ------------------------------------------------------------------------

def valid_candidates(c: DataFrame, max_step: float = 0.001, ratio_bounds=(0.5, 2.0), max_distance: float = 0.4,
                     max_notional: float = 20.0) -> DataFrame:
    """Nine conditions on both legs' grids; base is the long leg, quote the short one."""
    d = c
    for leg in ("base", "quote"):
        rng = ratio(f"{leg}_end_price", f"{leg}_start_price") - 1
        d = d.withColumn(f"{leg}_range", rng)
        gone = ratio(ratio(f"{leg}_price", f"{leg}_start_price") - 1, f"{leg}_range")
        d = d.withColumns({f"{leg}_distance": gone if leg == "base" else 1 - gone,
                           f"{leg}_level_amount": ratio("total_amount_quote", f"{leg}_levels")})
    cond = F.lit(True)
    for leg in ("base", "quote"):
        start, end, price = (F.col(f"{leg}_{x}") for x in ("start_price", "end_price", "price"))
        cond = (cond & (F.col(f"{leg}_step") <= max_step) & (F.col(f"{leg}_range") > 0) & (F.col(f"{leg}_distance") < max_distance)
                & (start < price) & (price < end) & (start > 0) & (end > 0) & (F.col(f"{leg}_level_amount") <= max_notional))
    return d.filter(cond & ratio("base_range", "quote_range").between(*ratio_bounds))


def adjust_candidates(c: DataFrame, notionals: DataFrame, as_of: Column, total_amount: float) -> DataFrame:
    """C11: identifier from connector, pairs, ISO week and the time floored to 10 minutes; minimum
    order = 1.5 x the larger minimum notional; risk parameters overwritten."""
    n = notionals.select("trading_pair", F.col("min_notional").alias("_n"))
    d = c.join(n.withColumnsRenamed({"trading_pair": "base_trading_pair", "_n": "_bn"}), "base_trading_pair")
    d = d.join(n.withColumnsRenamed({"trading_pair": "quote_trading_pair", "_n": "_qn"}), "quote_trading_pair")
    floored = F.date_trunc("hour", as_of) + F.make_dt_interval(
        mins=(F.floor(F.minute(as_of) / 10) * 10).cast("int"))
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), as_of).cast("string"), F.lit("||isoweek"), F.weekofyear(as_of).cast("string"))
    tag = F.concat(F.extract(F.lit("DAYOFWEEK_ISO"), as_of).cast("string"), F.lit("-"), F.date_format(floored, "HHmm"))
    return d.withColumns({
        "id": F.concat(F.concat_ws("||", F.replace("connector_name", F.lit("_"), F.lit("-")), "base_trading_pair",
                                   "quote_trading_pair", week), F.lit("_"), tag),
        "total_amount_quote": F.lit(total_amount),
        "min_order_amount_quote": F.greatest(F.col("_bn") * 1.5, F.col("_qn") * 1.5)}).drop("_bn", "_qn")


def with_open_interest(bars: DataFrame, scale_over: DataFrame, oi: DataFrame, share: float = 0.2) -> DataFrame:
    """Open interest on the bar's time, min-max scaled into ``share`` of the price range."""
    price = bars.groupBy(*SERIES).agg(F.min("low").alias("_lo"), F.max("high").alias("_hi"))
    reach = scale_over.groupBy(*SERIES).agg(F.min("sum_open_interest").alias("_a"), F.max("sum_open_interest").alias("_b"))
    d = join_series(join_series(bars, price), reach)
    d = join_series(d, oi.select(*SERIES, "ts", "sum_open_interest"), [*SERIES, "ts"], "left")
    unit = (F.col("sum_open_interest") - F.col("_a")) / (F.col("_b") - F.col("_a") + 1e-8)
    return d.withColumn("oi_scaled", unit * (F.col("_hi") - F.col("_lo")) * share + F.col("_lo")).drop("_a", "_b", "_lo", "_hi")
