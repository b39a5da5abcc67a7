"""Exact quantiles per key without gathering a key's values in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.operators.layout import SERIES, prefix_scan

SPLITS = 32


def exact_quantiles(df: DataFrame, wanted: dict[str, tuple[Column, float]],
                    keys: Sequence[str] = SERIES) -> DataFrame:
    """One row per key with the linear-interpolated quantile of each wanted (expression, q).

    Equal values are counted map-side; the distinct values are cut in slices at approximate
    quantiles and ranked by a two-level running count, so a hot key is spread over ``SPLITS`` tasks.
    """
    keys = list(keys)
    items = F.array(*[F.struct(F.lit(n).alias("_name"), e.cast("double").alias("_value"))
                      for n, (e, _) in wanted.items()])
    counts = (
        df.select(*keys, F.explode(items).alias("_i")).select(*keys, "_i.*")
        .filter(F.col("_value").isNotNull()).groupBy(*keys, "_name", "_value")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    series = [*keys, "_name"]
    cuts = F.array(*[F.lit(i / SPLITS) for i in range(1, SPLITS)])
    counts = counts.withColumn("_of", F.struct(*series))  # never NULL, so a NULL key is joined like any other
    shape = counts.groupBy("_of").agg(
        F.percentile_approx("_value", cuts, 2000).alias("_cuts"), F.sum("_n").alias("_total"))
    placed = counts.join(shape, "_of").drop("_of").withColumn(
        "_slice", F.size(F.filter("_cuts", lambda c: c < F.col("_value"))))
    ranked = prefix_scan(placed.drop("_cuts"), {"_cum": ("sum", "_n")}, series, ["_value"],
                         segment=F.col("_slice"))
    q = F.create_map(*[F.lit(x) for n, (_, v) in wanted.items() for x in (n, float(v))])
    ranked = ranked.withColumn("_r", q[F.col("_name")] * (F.col("_total") - 1))
    low = F.floor("_r")
    high = F.least(low + 1, F.col("_total") - 1)
    ends = ranked.groupBy(*series).agg(
        F.first("_r").alias("_r"),
        F.min(F.when(F.col("_cum") > low, F.col("_value"))).alias("_lo"),
        F.min(F.when(F.col("_cum") > high, F.col("_value"))).alias("_hi"))
    value = F.col("_lo") + (F.col("_r") - F.floor("_r")) * (F.col("_hi") - F.col("_lo"))
    ends = ends.withColumn("_v", value)
    return ends.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == n, F.col("_v"))).alias(n) for n in wanted])
