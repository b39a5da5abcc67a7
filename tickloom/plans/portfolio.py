"""Fill ledger, portfolio and control decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


from tickloom.operators.joins import latest_rows
from tickloom.operators.layout import magnitude_slice, prefix_scan
from tickloom.plans.screeners import top_per_group

LEDGER_KEYS = ("config_file_path", "market", "symbol")


def fill_ledger(fills: DataFrame, order: Sequence[str], keys: Sequence[str] = LEDGER_KEYS,
                segment_seconds: int = 90 * 86400) -> DataFrame:
    """Running inventory, fees and PnL of each market in time order.

    A slice gives one row of totals, so it must hold many fills to save anything; 90 days as in the other sums of fills.

    The first fill has no previous one, so its per-fill columns are NULL.
    """
    sign = F.when(F.col("trade_type") == "BUY", 1).otherwise(-1)
    d = fills.withColumn("net_amount", F.col("amount") * sign)
    d = d.withColumns({"net_amount_quote": F.col("net_amount") * F.col("price"), "quote_volume": F.col("price") * F.col("amount")})
    d = prefix_scan(d, {"cum_fees_in_quote": ("sum", "trade_fee_in_quote"), "cum_net_amount": ("sum", "net_amount"),
                        "_paid": ("sum", "net_amount_quote"), "_prev_price": ("prev", "price")}, keys, order, segment_seconds)
    d = d.withColumn("unrealized_trade_pnl", -F.col("_paid"))
    d = d.withColumn("inventory_cost", F.col("cum_net_amount") * F.col("price"))
    d = d.withColumn("realized_trade_pnl", F.col("unrealized_trade_pnl") + F.col("inventory_cost"))
    d = d.withColumn("net_realized_pnl", F.col("realized_trade_pnl") - F.col("cum_fees_in_quote"))
    # change against the previous fill, from its price and the inventory before this fill
    held = F.col("cum_net_amount") - F.col("net_amount")
    gross = held * (F.col("price") - F.col("_prev_price"))
    return d.withColumns({
        "gross_pnl": gross, "trade_fee": F.when(F.col("_prev_price").isNotNull(), F.col("trade_fee_in_quote")),
        "realized_pnl": gross - F.col("trade_fee_in_quote")}).drop("_paid", "_prev_price")


def pnl_stops(perf: DataFrame, as_of: Column, max_drawdown: float = 1.0, max_profit: float = 99.0, time_limit: float = 1e11,
              early_from: float = 1e11, early_to: float = 1e12, early_drawdown: float = 1.0, early_profit: float = 1.0) -> DataFrame:
    """Controllers to stop, with the first rule that fired; works on a stream as well."""
    pnl = F.col("global_pnl_pct") / 100
    age = F.unix_micros(as_of.cast("timestamp")) / 1e6 - F.unix_micros(F.col("started_at").cast("timestamp")) / 1e6
    early = age.between(early_from, early_to)
    why = (F.when(pnl >= max_profit, "take_profit").when(pnl <= -max_drawdown, "stop_loss").when(age >= time_limit, "time_limit")
           .when(early & (pnl >= early_profit), "early_take_profit").when(early & (pnl <= -early_drawdown), "early_stop_loss"))
    return perf.withColumn("stop_reason", why).filter(F.col("stop_reason").isNotNull())


def signal_map(signals: DataFrame) -> DataFrame:
    """The newest signal per pair, the larger absolute value on equal time."""
    s = latest_rows(signals.select("trading_pair", "ts", "value"), ["trading_pair"],
                    F.struct("ts", F.abs("value"), "value"))
    return s.withColumn("signal_direction", F.when(F.col("value") > 0, "long").otherwise("short"))


def keep_or_stop(controllers: DataFrame, signals: DataFrame, min_runtime_hours: float = 1.0, min_pnl_pct: float = -3.0,
                 stop_on_opposing: bool = True) -> DataFrame:
    """Decision (inactive, keep, stop) and reason per controller."""
    c = controllers.join(signal_map(signals).select("trading_pair", "signal_direction"), "trading_pair", "left")
    opposing = F.coalesce(F.col("signal_direction") != F.col("direction"), F.lit(False)) & F.lit(stop_on_opposing)
    young = F.col("runtime_hours") < min_runtime_hours
    poor = F.col("pnl_pct") < min_pnl_pct
    return c.withColumns({
        "decision": F.when(F.col("manual_kill_switch"), "inactive").when(young, "keep").when(opposing | poor, "stop").otherwise("keep"),
        "reason": F.when(F.col("manual_kill_switch"), "already stopped").when(young, "within minimum runtime")
        .when(opposing, "opposing signal").when(poor, "poor pnl")
        .when(F.col("signal_direction") == F.col("direction"), "matching signal").otherwise("no signal")})


def archivable_bots(controllers: DataFrame) -> DataFrame:
    """Bots none of whose controllers is active any more."""
    return controllers.groupBy("bot_name").agg(
        F.count_if(F.col("active")).alias("active_controllers"), F.count_if(~F.col("active")).alias("stopped_controllers")
    ).filter(F.col("active_controllers") == 0)


def new_deployments(signals: DataFrame, running: DataFrame, stopped: DataFrame, capacity: Column | int, top_per_side: int = 5) -> DataFrame:
    """Best signals per side, without markets running or just stopped in that direction,
    longs first, up to the free capacity."""
    s = signals.withColumns({"direction": F.when(F.col("value") > 0, "long").otherwise("short"), "strength": F.abs("value")})
    best = top_per_group(s, ["direction"], [F.desc("strength"), F.asc("trading_pair")], top_per_side)
    free = best.join(running.select("trading_pair", "direction"), ["trading_pair", "direction"], "left_anti").join(
        stopped.select("trading_pair", "direction"), ["trading_pair", "direction"], "left_anti")
    # at most 2 * top_per_side rows are left here
    w = Window.orderBy("direction", "rank")
    return free.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= capacity).drop("rank")


def min_notionals(rules: DataFrame, prices: DataFrame, increment_venue: str) -> DataFrame:
    """Minimum notional per pair: increment x last price on one venue, the rule elsewhere."""
    j = rules.join(prices, "trading_pair", "left")
    return j.withColumn("min_notional", F.when(
        F.col("connector") == increment_venue, F.col("min_base_increment") * F.col("last_price")).otherwise(F.col("min_notional_size")))


def candidate_cut(candidates: DataFrame, max_controllers: int) -> DataFrame:
    """P07"""
    return candidates.orderBy(F.desc("score"), "config_id").limit(max_controllers)


def bot_slots(active: DataFrame, max_bots: int) -> DataFrame:
    """How many bots run and whether one more fits."""
    return active.agg(F.countDistinct("bot_name").alias("running")).withColumn("has_slot", F.col("running") < max_bots)


def top_signals(signals: DataFrame, n: int = 3) -> DataFrame:
    """Direction, intensity and rank of the strongest signals per side."""
    s = signals.withColumns({"direction": F.when(F.col("value") > 0, "long").otherwise("short"), "intensity": F.abs("value")})
    return top_per_group(s, ["direction"], [F.desc("intensity"), F.asc("trading_pair")], n)


def bot_rollup(perf: DataFrame) -> DataFrame:
    """Strategies, PnL and volume per bot."""
    return perf.groupBy("bot_name").agg(F.count(F.lit(1)).alias("strategies"), F.sum("global_pnl_quote").alias("pnl"),
                                        F.sum("volume_traded").alias("volume"))


def winners_and_losers(perf: DataFrame) -> DataFrame:
    """All winners and all losers with their rank by size within each side (a two-level count over
    slices of magnitude, so a side is not sorted in one task)."""
    side = F.when(F.col("global_pnl_quote") > 0, "winner").when(F.col("global_pnl_quote") < 0, "loser")
    p = perf.withColumn("outcome", side).filter(F.col("outcome").isNotNull())
    p = p.withColumn("_down", -F.abs("global_pnl_quote"))
    ranked = prefix_scan(p, {"rank": ("count", F.lit(1))}, ["outcome"], ["_down", "controller_id"], segment=magnitude_slice("_down"))
    return ranked.drop("_down")


def portfolio(balances: DataFrame) -> DataFrame:
    """Balances worth at least 1, exchanges by total, then by value, with a running number.

    The number is a two-level count: position inside the exchange plus the sizes of the exchanges
    before it (one row per exchange), so positions of an exchange are spread over value slices.
    """
    b = balances.filter((F.col("units") > 0) & (F.col("value") >= 1))
    b = b.withColumn("_down", -F.col("value"))
    b = prefix_scan(b, {"_n": ("count", F.lit(1))}, ["exchange"], ["_down", "token"], segment=magnitude_slice("_down"))
    totals = b.groupBy("exchange").agg(F.sum("value").alias("exchange_total"), F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy(F.desc("exchange_total"), "exchange").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    return b.join(totals, "exchange").withColumn("position", F.col("_n") + F.col("_before")).drop("_n", "_before", "_size", "_down")


def nested_balances(accounts: DataFrame) -> DataFrame:
    """A18 input: exchange -> list of holdings, exploded to one row per holding."""
    return accounts.select("account", F.explode("exchanges").alias("exchange", "_items")).select(
        "account", "exchange", F.inline("_items"))


def unused_configs(configs: DataFrame, used: DataFrame, recycle: bool = False) -> DataFrame:
    """J11"""
    return configs if recycle else configs.join(used.select("config_id"), "config_id", "left_anti")


def tradable_configs(configs: DataFrame, exchange_pairs: DataFrame) -> DataFrame:
    """Configs with either leg listed on the exchange: two semi-joins, no OR join."""
    listed = exchange_pairs.select("trading_pair").distinct()
    a = configs.join(listed.withColumnRenamed("trading_pair", "base_trading_pair"), "base_trading_pair", "left_semi")
    b = configs.join(listed.withColumnRenamed("trading_pair", "quote_trading_pair"), "quote_trading_pair", "left_semi")
    return a.select(*configs.columns).unionByName(b.select(*configs.columns)).dropDuplicates(["config_id"])


def common_pairs(configs: DataFrame, exchange_pairs: DataFrame) -> DataFrame:
    """Pairs named by a config that the exchange lists."""
    named = configs.select(F.col("base_trading_pair").alias("trading_pair")).union(configs.select("quote_trading_pair"))
    return named.intersect(exchange_pairs.select("trading_pair"))


