"""Time-aware joins (J01, J08, J09) and pair joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions.columns import epoch_micros
from tickloom.operators.layout import SERIES, join_series, prefix_scan


def asof_join(left: DataFrame, right: DataFrame, values: Sequence[str], keys: Sequence[str] = SERIES,
              ts: str = "ts", tie: str | None = None, segment_seconds: int | None = None) -> DataFrame:
    """The latest right row at or before each left row.

    Both sides are stacked and the last right row is carried forward by a two-level scan: one
    shuffle on (key, time slice), no per-key task.
    """
    extra = [tie] if tie and tie not in (*keys, ts) else []
    payload = F.struct(*values)
    r = right.select(*keys, ts, F.lit(0).alias("_side"), payload.alias("_right"), *extra)
    l = left.withColumn("_side", F.lit(1))
    both = l.unionByName(r, allowMissingColumns=True)
    out = prefix_scan(both, {"_match": ("last", "_right")}, keys, [ts, "_side", *extra], segment_seconds)
    return out.filter(F.col("_side") == 1).select(*left.columns, *[F.col(f"_match.{v}").alias(v) for v in values])


def band_join(events: DataFrame, bars: DataFrame, start: str, end: str, width_seconds: int,
              keys: Sequence[str] = SERIES, ts: str = "ts") -> DataFrame:
    """Bars with start <= ts <= end of the event, through an equi-join on time buckets.

    An event is copied to the buckets its band touches (two when the width is the band length), so
    tasks are bounded by bucket, not by symbol. The result is one row per (event, bar); ``blocks`` answers
    questions about a band (first touch, sums, extremes) without them. Apart from ``keys`` the two sides share no names.
    """
    unit = width_seconds * 1_000_000
    first = F.floor(epoch_micros(start) / unit)
    last = F.floor(epoch_micros(end) / unit)
    e = events.withColumn("_bucket", F.explode(F.sequence(first, last)))
    b = bars.withColumn("_bucket", F.floor(epoch_micros(ts) / unit))
    return join_series(e, b, [*keys, "_bucket"]).filter(F.col(ts).between(F.col(start), F.col(end))).drop("_bucket")


def latest_rows(df: DataFrame, keys: Sequence[str] = SERIES, order: Column | None = None) -> DataFrame:
    """One row per key, the newest; a map-side combined aggregate instead of a sort."""
    rest = [c for c in df.columns if c not in keys]
    order = order if order is not None else F.col("ts")
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_v")).select(*keys, "_v.*")


def group_pairs(df: DataFrame, group: Sequence[str], item: str, values: Sequence[str],
                blocks: int = 16) -> DataFrame:
    """J05/Q-L: unordered pairs (item1 < item2) of the same group with both sides' values.

    The result is quadratic in the number of items (symbols of a venue) by definition. Items are
    hashed to blocks and joined block by block, so a large group is spread over blocks^2/2 tasks.
    """
    block = F.pmod(F.hash(item), F.lit(blocks)).cast("int")
    side = df.select(*group, F.col(item), *values).withColumn("_blk", block)
    left = side.select(*group, F.col(item).alias("item1"), *[F.col(v).alias(f"{v}1") for v in values], F.col("_blk").alias("_b1"))
    left = left.withColumn("_b2", F.explode(F.array(*[F.lit(i) for i in range(blocks)])))
    right = side.select(*group, F.col(item).alias("item2"), *[F.col(v).alias(f"{v}2") for v in values], F.col("_blk").alias("_b2"))
    right = right.withColumn("_b1", F.explode(F.array(*[F.lit(i) for i in range(blocks)])))
    return left.join(right, [*group, "_b1", "_b2"]).filter(F.col("item1") < F.col("item2")).drop("_b1", "_b2")
