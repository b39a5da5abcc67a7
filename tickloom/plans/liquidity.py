"""Order books, AMM bins and swap quotes.

A book side may be deep, so running depth is a two-level scan over slices of relative price, best price first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions.columns import ratio
from tickloom.operators.layout import magnitude_slice, prefix_scan

BOOK = ("trading_pair", "side")


def _away() -> Column:
    """Ascending order of a side: best ask is the lowest price, best bid the highest."""
    return F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price"))


def with_depth(book: DataFrame) -> DataFrame:
    """Levels with running amount, running quote value and position from the best price; levels of one
    price are ordered by amount."""
    df = book.withColumn("_away", _away())
    return prefix_scan(
        df, {"cum_amount": ("sum", "amount"), "cum_quote": ("sum", F.col("price") * F.col("amount")),
             "level": ("count", F.lit(1))},
        BOOK, ["_away", "amount"], segment=magnitude_slice("_away")).drop("_away")


def depth_snapshot(book: DataFrame, depth: int) -> DataFrame:
    """The best ``depth`` levels per side."""
    return with_depth(book).filter(F.col("level") <= depth)


def _take_side(is_buy: bool) -> Column:
    return F.col("side") == ("ask" if is_buy else "bid")


def price_for_volume(book: DataFrame, volume: float, is_buy: bool, quote: bool = False) -> DataFrame:
    """First level whose running amount (or quote value) reaches ``volume``.

    The price is NULL when the book is too thin; the result volume is capped by the depth.
    """
    cum = "cum_quote" if quote else "cum_amount"
    side = with_depth(book.filter(_take_side(is_buy)))
    return side.groupBy("trading_pair").agg(
        F.min_by("price", F.when(F.col(cum) >= volume, F.col("level"))).alias("result_price"),
        F.least(F.lit(float(volume)), F.max(cum)).alias("result_volume"))


def volume_for_price(book: DataFrame, price: Column, is_buy: bool) -> DataFrame:
    """Base and quote volume available up to ``price``, with the crossed-book diagnosis."""
    p, level = F.col("query_price"), F.col("price")
    b = book.withColumn("query_price", price)
    reach = _take_side(is_buy) & (level <= p if is_buy else level >= p)
    out = b.groupBy("trading_pair", "query_price").agg(
        F.sum(F.when(reach, F.col("amount"))).alias("result_volume"),
        F.sum(F.when(reach, level * F.col("amount"))).alias("result_quote_volume"),
        F.max(F.when(F.col("side") == "bid", level)).alias("best_bid"),
        F.min(F.when(F.col("side") == "ask", level)).alias("best_ask"))
    bid, ask, q = F.col("best_bid"), F.col("best_ask"), F.col("query_price")
    crossed = F.col("result_volume").isNull()
    # The reasons, with the asked price and the best one on that side.
    if is_buy:
        first, second = (q > ask, "Buy price %s exceeds best ask %s", ask), (
            q < bid, "Buy price %s below best bid %s - no liquidity available", bid)
    else:
        first, second = (q < bid, "Sell price %s below best bid %s", bid), (
            q > ask, "Sell price %s above best ask %s - no liquidity available", ask)
    reason = lambda way: F.format_string(way[1], q.cast("string"), way[2].cast("string"))
    return out.withColumns({
        "crossed_book": crossed, "mid_price": (bid + ask) / 2,
        "crossed_reason": F.when(crossed & first[0], reason(first)).when(crossed & second[0], reason(second)),
        "suggested_price": F.when(crossed & first[0], first[2]).when(crossed & second[0], second[2])})


def vwap_for_volume(book: DataFrame, volume: float, is_buy: bool) -> DataFrame:
    """Average price of the first ``volume`` units, best level first."""
    side = with_depth(book.filter(_take_side(is_buy)))
    taken = F.greatest(F.lit(0.0), F.least(F.col("amount"), volume - (F.col("cum_amount") - F.col("amount"))))
    return side.withColumn("_t", taken).groupBy("trading_pair").agg(
        ratio(F.sum(F.col("price") * F.col("_t")), F.sum("_t")).alias("vwap"), F.sum("_t").alias("result_volume"))


def book_summary(book: DataFrame, window: float = 0.8) -> DataFrame:
    """Best prices, spread, mid, totals per side, and depth within +- ``window`` of mid."""
    bid, ask = F.col("side") == "bid", F.col("side") == "ask"
    value = F.col("price") * F.col("amount")
    best = book.groupBy("trading_pair").agg(
        F.max(F.when(bid, F.col("price"))).alias("best_bid"), F.min(F.when(ask, F.col("price"))).alias("best_ask"),
        F.sum(F.when(bid, F.col("amount"))).alias("bid_amount"), F.sum(F.when(ask, F.col("amount"))).alias("ask_amount"),
        F.sum(F.when(bid, value)).alias("bid_value"), F.sum(F.when(ask, value)).alias("ask_value"))
    best = best.withColumns({
        "spread": F.col("best_ask") - F.col("best_bid"), "mid_price": (F.col("best_ask") + F.col("best_bid")) / 2,
        "spread_pct": ratio(100 * (F.col("best_ask") - F.col("best_bid")), "best_bid")})
    near = book.join(best.select("trading_pair", "mid_price"), "trading_pair").filter(
        (bid & (F.col("price") >= F.col("mid_price") * (1 - window)))
        | (ask & (F.col("price") <= F.col("mid_price") * (1 + window))))
    depth = near.groupBy("trading_pair").agg(F.count(F.lit(1)).alias("levels_in_window"),
                                             F.sum("amount").alias("amount_in_window"))
    return best.join(depth, "trading_pair", "left")


def bin_values(bins: DataFrame, price: Column) -> DataFrame:
    return bins.withColumns({"current_price": price,
                             "total_value": F.col("quote_amount") + F.col("base_amount") * price})


def pool_analysis(bins: DataFrame, pools: DataFrame, reach: int = 5, top: int = 5) -> DataFrame:
    """Per pool total liquidity, price range, share in the active +-5 bins, top bins.

    ``pools``: pool, price, active_bin_id. Top bins come from a bounded top-k aggregate.
    """
    b = bins.withColumnRenamed("price", "bin_price").join(pools, "pool")
    b = b.withColumn("total_value", F.col("quote_amount") + F.col("base_amount") * F.col("price"))
    near = F.abs(F.col("bin_id") - F.col("active_bin_id")) <= reach
    out = b.groupBy("pool").agg(
        F.sum("base_amount").alias("base_liquidity"), F.sum("quote_amount").alias("quote_liquidity"),
        F.sum("total_value").alias("total_liquidity"), F.count(F.lit(1)).alias("num_bins"),
        F.min("bin_price").alias("min_price"), F.max("bin_price").alias("max_price"),
        F.sum(F.when(near, F.col("total_value")).otherwise(0.0)).alias("_near"))
    return out.withColumn("liquidity_concentration",
                          F.coalesce(ratio(100 * F.col("_near"), "total_liquidity"), F.lit(0.0))).drop("_near")


def top_bins(bins: DataFrame, price: Column, n: int = 5) -> DataFrame:
    """The n most valuable bins per pool."""
    from tickloom.plans.screeners import top_per_group
    return top_per_group(bin_values(bins, price), ["pool"], [F.desc("total_value"), F.asc("bin_id")], n)


def price_range_distribution(bins: DataFrame, pools: DataFrame, ranges=(5, 10, 15, 20)) -> DataFrame:
    """Share of a pool's liquidity within +-r % of its price; 0 for an empty pool."""
    b = bins.withColumnRenamed("price", "bin_price").join(pools.select("pool", "price"), "pool")
    b = b.withColumn("_v", F.col("quote_amount") + F.col("base_amount") * F.col("price"))
    inside = {r: (F.col("bin_price") >= F.col("price") * (1 - r / 100)) & (F.col("bin_price") <= F.col("price") * (1 + r / 100))
              for r in ranges}
    sums = b.groupBy("pool").agg(F.sum("_v").alias("_all"), *[
        F.sum(F.when(c, F.col("_v")).otherwise(0.0)).alias(f"_r{r}") for r, c in inside.items()])
    rows = F.array(*[F.struct(F.lit(r).alias("range_pct"),
                              F.coalesce(ratio(100 * F.col(f"_r{r}"), "_all"), F.lit(0.0)).alias("share_pct")) for r in ranges])
    return sums.select("pool", F.explode(rows).alias("_d")).select("pool", "_d.*")


def bin_detail(bins: DataFrame, pools: DataFrame) -> DataFrame:
    """Distance from price, share of the pool and active flag per bin."""
    b = bins.withColumnRenamed("price", "bin_price").join(pools, "pool")
    b = b.withColumn("total_value", F.col("base_amount") * F.col("price") + F.col("quote_amount"))
    whole = b.groupBy("pool").agg(F.sum("total_value").alias("_all"))
    return b.join(whole, "pool").withColumns({
        "is_active_bin": F.col("bin_id") == F.col("active_bin_id"),
        "distance_from_price": ratio(100 * (F.col("bin_price") - F.col("price")), "price"),
        "liquidity_share_pct": ratio(100 * F.col("total_value"), "_all")}).drop("_all")


def sqrt_price(sqrt_price_x96: Column, decimals0: Column, decimals1: Column) -> Column:
    """Price of token0 in token1 from the pool's fixed-point square root."""
    root = sqrt_price_x96.cast("double") / F.lit(2.0 ** 96)
    return F.pow(root, F.lit(2.0)) * F.pow(F.lit(10.0), (decimals0 - decimals1).cast("double"))


def pool_usd(pools: DataFrame, token: str, weth_usd: Column, cex: DataFrame) -> DataFrame:
    """USD price of ``token`` and TVL by pool composition, difference to the CEX mid.

    ``pools``: pool, token0, token1, balance0, balance1, price (token1 per token0), trading_pair.
    """
    t0, t1 = F.col("token0"), F.col("token1")
    eth, usd0 = (t0 == "WETH") & (t1 == token), (t0 == "USDC") & (t1 == token)
    usd1 = (t1 == "USDC") & (t0 == token)
    df = pools.withColumns({
        "price_usd": F.when(eth, ratio(weth_usd, "price")).when(usd0, ratio(F.lit(1.0), "price")).when(usd1, F.col("price")),
        "tvl": F.when(eth, F.col("balance0") * weth_usd * 2).when(usd0, F.col("balance0") * 2).when(usd1, F.col("balance1") * 2)})
    df = df.join(cex.select("trading_pair", F.col("mid_price").alias("cex_price")), "trading_pair", "left")
    return df.withColumn("diff_pct", ratio(100 * (F.col("price_usd") - F.col("cex_price")), "cex_price"))


def compare_quotes(quotes: DataFrame) -> DataFrame:
    """Price per venue (input per output, lower is better), best venue and % over best.

    The best price is a map-side combined minimum joined back, so a quote with many venues is not
    sorted in one task.
    """
    q = quotes.withColumn("price", F.when(F.col("amount_in") == 0, 0.0).otherwise(ratio("amount_in", "amount_out")))
    best = q.groupBy("quote_id").agg(F.min("price").alias("best_price"),
                                     F.min_by("venue", F.struct("price", "venue")).alias("best_venue"))
    return q.join(best, "quote_id").withColumn(
        "over_best_pct", (ratio("price", "best_price") - 1) * 100)


def swap_amounts(raw: DataFrame) -> DataFrame:
    """Base-unit amounts to token units, execution price and USD value, as decimals."""
    d = "decimal(38,18)"

    def scale(a: str, n: str) -> Column:
        """Whole tokens and remainder apart: one decimal division would keep six digits only."""
        units, one = F.col(a).cast("decimal(38,0)"), F.pow(F.lit(10.0), F.col(n)).cast("decimal(19,0)")
        rest = (units % one).cast("decimal(18,0)")
        return (((units - rest) / one).cast("decimal(20,0)").cast(d) + (rest / one).cast(d)).cast(d)

    out = raw.withColumns({"from_amount": scale("from_units", "from_decimals"), "to_amount": scale("to_units", "to_decimals")})
    return out.withColumns({
        "execution_price": F.when(F.col("to_amount") == 0, F.lit(0).cast(d)).otherwise(
            ratio("from_amount", "to_amount").cast(d)),
        "value_in_usd": (F.col("from_amount") * F.col("from_price").cast("decimal(18,6)")).cast(d)})
