"""Triple-barrier labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions.columns import ratio
from tickloom.operators import rolling as R
from tickloom.operators.blocks import first_crossings
from tickloom.operators.layout import POS, SERIES, own_rows, renumber, segmented


def volatility_target(bars: DataFrame, span: int | None = 100) -> DataFrame:
    """Rolling std over close (1 % without a span); rows before the window is full are dropped."""
    return renumber(_placed_target(bars, span))


def _placed_target(bars: DataFrame, span: int | None) -> DataFrame:
    """The same with the place that a bar had among all bars, where that is known."""
    if not span:
        return bars.withColumn("target", F.lit(0.01))
    df, p = segmented(bars, span)
    df = df.withColumn("target", ratio(R.std("close", span, p), "close"))
    return own_rows(df).filter(F.col("target").isNotNull())


def first_touch(events: DataFrame, bars: DataFrame, tp: Column | None, sl: Column | None, limit_seconds: int,
                keys: Sequence[str] = SERIES, event_keys: Sequence[str] = ()) -> DataFrame:
    """First strict take-profit or stop-loss touch in [ts, ts + limit], the start bar included.

    ``events``: keys, ``event_keys`` (e.g. a trial), ts, close, side. ``tp`` and ``sl`` are
    return thresholds over event columns. The price at the close time is the last bar at or before
    it; a row with side 0 only meets its own bar. Each event stays one row: its touches come from block
    summaries, not from the bars of its band. An event without bars in its band has no touch and no return.
    """
    side, seconds = F.col("side"), F.lit(float(limit_seconds))
    e = events.withColumns({
        "tl": F.col("ts") + F.make_dt_interval(secs=seconds),
        "_reach": F.col("ts") + F.when(side != 0, F.make_dt_interval(secs=seconds)).otherwise(F.make_dt_interval(secs=F.lit(0.0))),
        "_tp": tp.cast("double") if tp is not None else F.lit(None).cast("double"),
        "_sl": sl.cast("double") if sl is not None else F.lit(None).cast("double")})
    ret = lambda price: (ratio(price, "close") - 1) * side
    out = first_crossings(e, bars, "close", "_reach", {"_up": lambda v: ret(v) > F.col("_tp"), "_down": lambda v: ret(v) < -F.col("_sl")},
                          limit_seconds, keys)
    out = out.withColumns({"take_profit_time": F.col("_up.t"), "stop_loss_time": F.col("_down.t")})
    t, s, tl = F.col("take_profit_time"), F.col("stop_loss_time"), F.col("tl")
    out = out.withColumn("close_time", F.least(tl, t, s))
    took, stopped = F.coalesce(F.col("close_time") == t, F.lit(False)), F.coalesce(F.col("close_time") == s, F.lit(False))
    exit_price = F.when(took, F.col("_up.v")).when(stopped, F.col("_down.v")).otherwise(F.col("last.v"))
    return out.withColumns({"close_type": F.when(took, 1).when(stopped, -1).otherwise(0), "ret": ret(exit_price)}).drop(
        "_up", "_down", "last", "_tp", "_sl", "_reach")


def triple_barrier(bars: DataFrame, tp: float = 1.0, sl: float = 1.0, limit_seconds: int = 5, std_span: int | None = 100,
                   trade_cost: float = 0.0006) -> DataFrame:
    """Labels every bar that has a target; bars with side 0 close at the time barrier with return 0."""
    events = _placed_target(bars, std_span)
    events = events.select(*SERIES, "ts", "close", "side", "target", *[c for c in (POS,) if c in events.columns])
    out = first_touch(events, bars, tp * F.col("target") if tp > 0 else None, sl * F.col("target") if sl > 0 else None, limit_seconds)
    return out.withColumns({
        "real_class": F.signum(F.col("ret") - trade_cost).cast("int"),
        "tp": F.col("close") * (1 + F.col("target") * tp * F.col("side")),
        "sl": F.col("close") * (1 - F.col("target") * sl * F.col("side"))})
