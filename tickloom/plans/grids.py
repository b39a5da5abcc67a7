"""Order ladders and grids (G14-G18): level tables built from small per-row arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.functions.columns import ratio
from tickloom.operators.joins import latest_rows


MAKER_SPREADS = (0.01, 0.02, 0.04, 0.08)
MAKER_WEIGHTS = (0.1, 0.2, 0.4, 0.8)


def maker_ladder(prices: DataFrame, amount: float, spreads=MAKER_SPREADS, weights=MAKER_WEIGHTS) -> DataFrame:
    """Buy levels p(1-s) and sell levels p(1+s), the amount split by weight share."""
    levels = F.array(*[
        F.struct(F.lit(side).alias("side"), F.lit(i).alias("level"), F.lit(1 + sign * s).alias("factor"),
                 F.lit(amount * w / sum(weights)).alias("amount"))
        for side, sign in (("BUY", -1), ("SELL", 1)) for i, (s, w) in enumerate(zip(spreads, weights))])
    df = prices.withColumn("_l", F.explode(levels))
    price = F.col("price") * F.col("_l.factor")
    return df.select(*prices.columns, "_l.side", "_l.level", price.alias("level_price"), "_l.amount",
                     (F.col("_l.amount") * price).alias("amount_quote"))


def executors_to_refresh(executors: DataFrame, as_of: Column, refresh_seconds: float,
                         top_refresh_seconds: float | None = None) -> DataFrame:
    """Active, not trading executors older than the limit (a shorter one may hold for level 0)."""
    age = F.unix_micros(as_of.cast("timestamp")) / 1e6 - F.unix_micros(F.col("created_at").cast("timestamp")) / 1e6
    stale = age > refresh_seconds
    if top_refresh_seconds is not None:
        stale = stale | ((F.col("level") == 0) & (age > top_refresh_seconds))
    return executors.filter(F.col("is_active") & ~F.col("is_trading") & stale)


def _sized(ranges: DataFrame, min_spread: float) -> DataFrame:
    """The active ranges that hold a level, with their number of levels: the smaller of what the price step and the
    order size allow."""
    r = ranges.filter(F.col("active"))
    span = F.col("end_price") - F.col("start_price")
    step = F.greatest(F.col("min_price_increment"), F.lit(min_spread) * F.col("mid_price"))
    n = F.floor(F.least(ratio(span, step), ratio("total_amount", "min_amount"))).cast("bigint")
    r = r.withColumn("n_levels", n).filter(F.col("n_levels") > 0)
    return r.withColumn("step", span / F.col("end_price") / F.col("n_levels"))


def _level_numbers() -> Column:
    return F.sequence(F.lit(0).cast("bigint"), F.col("n_levels") - 1)


def _level_id(level: Column) -> Column:
    return F.concat_ws("_P", F.col("range_id"), level)


def _level_price(level: Column) -> Column:
    share = F.coalesce(ratio(level, F.col("n_levels") - 1), F.lit(0.0))
    return F.col("start_price") + (F.col("end_price") - F.col("start_price")) * share


def grid_levels(ranges: DataFrame, min_spread: float = 0.001) -> DataFrame:
    """Linear price levels of each active range.

    ``ranges``: range_id, side, start_price, end_price, total_amount, mid_price, min_price_increment,
    min_amount.
    """
    r = _sized(ranges, min_spread).withColumn("level", F.explode(_level_numbers()))
    return r.withColumns({
        "level_id": _level_id(F.col("level")), "price": _level_price(F.col("level")),
        "amount": F.col("total_amount") / F.col("n_levels") / F.col("mid_price")})


def grid_orders(ranges: DataFrame, active_level_ids: DataFrame, activation: float = 0.01, max_open_orders: int = 5,
                keys: tuple[str, ...] = ("grid_id",), min_spread: float = 0.001, digits: int = 9) -> DataFrame:
    """The levels to open now: inside the activation bound, not open yet, nearest to mid first.

    The open ids join as one array per grid. Each range sorts its own free levels (those of ``grid_levels``, prices
    rounded to ``digits``) and gives the nearest only, so the levels are neither shuffled nor sorted as rows.
    """
    mid, side = F.col("mid_price"), F.col("side")
    opened = active_level_ids.groupBy(*keys).agg(F.collect_set("level_id").alias("_open"))
    r = _sized(ranges, min_spread).withColumns({
        "_low": F.when(side == "BUY", mid * (1 - activation)), "_high": F.when(side == "SELL", mid * (1 + activation))})
    r = r.join(opened, list(keys), "left")
    levels = F.transform(_level_numbers(), lambda i: F.struct(F.round(_level_price(i), digits).alias("price"), i.alias("level")))
    inside = F.filter(levels, lambda x: (x["price"] >= F.col("_low")) | (x["price"] <= F.col("_high")))
    offers = F.transform(inside, lambda x: F.struct(
        F.abs(x["price"] - mid).alias("_far"), _level_id(x["level"]).alias("level_id"), x["level"].alias("level"), x["price"].alias("price")))
    free = F.when(F.col("_open").isNull(), offers).otherwise(
        F.filter(offers, lambda x: ~F.array_contains("_open", x["level_id"])))
    r = r.withColumn("_near", F.explode(F.slice(F.sort_array(free), 1, max_open_orders))).drop("_open", "_low", "_high")
    r = r.select("*", "_near.*").drop("_near")
    w = Window.partitionBy(*keys).orderBy("_far", "level_id")
    r = r.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max_open_orders).drop("_far")
    price = F.col("price")
    behind = ((F.col("side") == "BUY") & (price > mid)) | ((F.col("side") == "SELL") & (price < mid))
    return r.withColumns({
        "amount": F.col("total_amount") / F.col("n_levels") / mid,
        "entry_price": F.when(behind, mid).otherwise(price),
        "take_profit": F.when(behind, F.greatest(F.col("step") * 2, F.abs(price - mid) / mid + F.col("step")))
        .otherwise(F.col("step"))})


def grid_stops(executors: DataFrame, ranges: DataFrame, mids: DataFrame, activation: float = 0.01,
               key: str = "grid_id") -> DataFrame:
    """Executors of switched-off ranges, and placed orders that left the activation bound."""
    off = executors.filter(F.col("is_active")).join(
        ranges.filter(~F.col("active")).select(key, "range_id"), [key, "range_id"], "left_semi")
    placed = executors.filter(F.col("is_active") & ~F.col("is_trading")).join(mids, key)
    mid = F.col("mid_price")
    out = placed.filter(((F.col("side") == "BUY") & (F.col("entry_price") <= mid * (1 - activation)))
                        | ((F.col("side") == "SELL") & (F.col("entry_price") >= mid * (1 + activation))))
    return off.select(key, "executor_id").unionByName(out.select(key, "executor_id")).distinct()


# Grid offsets as a share of the price range, per side.
TREND_OFFSETS = {"long": (-0.25, 0.75, -0.35), "short": (-0.75, 0.25, 0.35)}


def trend_grids(signals: DataFrame, features: DataFrame, stamp: Column) -> DataFrame:
    """One grid per signalled market from its newest feature (price, range_pct)."""
    f = latest_rows(features.select("trading_pair", "ts", "price", "range_pct"), ["trading_pair"]).drop("ts")
    df = signals.join(f, "trading_pair")
    side = F.when(F.col("value") > 0, "long").otherwise("short")
    df = df.withColumn("direction", side)
    out = {}
    for i, name in enumerate(("start_price", "end_price", "limit_price")):
        offset = F.when(F.col("direction") == "long", TREND_OFFSETS["long"][i]).otherwise(TREND_OFFSETS["short"][i])
        out[name] = F.col("price") * (1 + offset * F.col("range_pct"))
    out["config_id"] = F.concat_ws("_", F.lit("tf"), F.replace(F.lower("trading_pair"), F.lit("-"), F.lit("_")),
                                   F.col("direction"), stamp)
    out["side"] = F.when(F.col("direction") == "long", 1).otherwise(2)
    return df.withColumns(out)


def pair_grid_configs(pairs: DataFrame, total_amount: float = 1000.0) -> DataFrame:
    """Two legs per accepted pair; start and end sorted, limit not below zero, opposite sides,
    half the amount each. ``pairs``: base, quote and start/end/limit price per leg."""
    leg = lambda name, side: F.struct(
        F.lit(name).alias("leg"), F.col(name).alias("trading_pair"), F.lit(side).alias("side"),
        F.least(f"{name}_start_price", f"{name}_end_price").alias("start_price"),
        F.greatest(f"{name}_start_price", f"{name}_end_price").alias("end_price"),
        F.greatest(F.col(f"{name}_limit_price"), F.lit(0.0)).alias("limit_price"))
    df = pairs.withColumn("config_id", F.concat_ws(
        "_", F.replace("base", F.lit("-"), F.lit("")), F.replace("quote", F.lit("-"), F.lit("")), F.lit("coint_config")))
    return df.select("config_id", F.explode(F.array(leg("base", "BUY"), leg("quote", "SELL"))).alias("_l")).select(
        "config_id", "_l.*", F.lit(total_amount / 2).alias("amount_quote"))


