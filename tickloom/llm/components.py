"""Connected components by alternating large-star and small-star rounds.

Every round rewires each node to the smallest node in reach; the edges end as one star per component
around its smallest node. Each round is cut by a reliable checkpoint and only sums of hashes come to the
driver. Rounds grow with the logarithm of a component's diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import cut


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of an edge that is not its component's smallest; ids are not null."""
    e = cut(edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter("hi <> lo").distinct())
    seen, now = None, _signature(e)
    while now != seen and now[0]:
        seen = now
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select("lo", "hi"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # pairs that come twice are dropped at the end of the round: a shuffle less, and never more pairs than ``both``
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        chained = large.join(least, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        e = cut(chained.union(least.select("hi", F.col("m").alias("lo"))).distinct())
        now = _signature(e)
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
