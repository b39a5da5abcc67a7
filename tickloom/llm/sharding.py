"""Sharding by proportional stratified interleaving.

Rows of each source are ranked in a seeded shuffle; a row's fractional rank is (rank - 1/2) / rows of
its source. All rows are sorted by fractional rank and cut into shards of equal row counts, so every
shard holds each source in the proportion of the whole.

Both ranks are two-level: rows fall into slices (by shuffle hash, then by fractional rank), slice
counts are added up, and only rows of one slice are numbered together. A source with a third of all
rows is spread over as many slices as any.

Nulls: a null source is a source of its own; a null doc_id is shuffled like any value; a null text has
size 1 and the CRC-32 of no bytes (0). Repeated rows each get a slot. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that are numbered together on average, i.e. one sorted slice.
SLICE_ROWS = 20_000


def _slice(position: Column, slices: int) -> Column:
    return F.least(F.floor(position * slices), F.lit(slices - 1)).cast("int")


def _ranked(df: DataFrame, groups: list[str], position: str, order: list[str], slices: int) -> DataFrame:
    """Add ``_rank`` (from 0 within ``groups``) and ``_n`` (rows of the group); ``position`` in [0, 1) is
    the leading sort column. Group columns must not be null."""
    df = df.withColumn("_slice", _slice(F.col(position), slices))
    counts = df.groupBy(*groups, "_slice").agg(F.count(F.lit(1)).alias("_c"))
    if groups:
        ahead = Window.partitionBy(*groups)
    else:  # one row per slice
        ahead = Window.partitionBy(F.lit(0))
    counts = counts.select(
        *groups, "_slice",
        (F.sum("_c").over(ahead.orderBy("_slice")) - F.col("_c")).alias("_before"),
        F.sum("_c").over(ahead).alias("_n"))
    within = Window.partitionBy(*groups, "_slice").orderBy(position, *order)
    return (df.withColumn("_in_slice", F.row_number().over(within) - 1)
            .join(counts, [*groups, "_slice"])
            .withColumn("_rank", F.col("_before") + F.col("_in_slice"))
            .drop("_in_slice", "_before", "_slice"))


def stratified_shards(docs: DataFrame, shards: int = 8, seed: int = 17, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One row per document: doc_id, source, size, text_crc32, frac_rank, shard, slot.

    Shard sizes differ by one row at most. ``slot`` counts from 0 within the shard, in sort order."""
    text = F.col("text")
    rows = docs.select(
        F.col("doc_id"), F.col("source"), F.struct("source").alias("_stratum"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"))
    mixed = F.xxhash64("doc_id", "source", "text_crc32", F.lit(seed))
    # 53 bits of the hash as a number in [0, 1)
    rows = rows.withColumn("_pos", F.shiftrightunsigned(mixed, 11) / F.lit(float(1 << 53)))
    slices = max(1, -(-docs.count() // slice_rows))
    order = ["doc_id", "text_crc32"]
    ranked = _ranked(rows, ["_stratum"], "_pos", order, slices)
    ranked = ranked.withColumn("frac_rank", (F.col("_rank") + 0.5) / F.col("_n")).drop("_rank", "_n")
    total = _ranked(ranked, [], "frac_rank", ["_pos", "source", *order], slices)
    # row r is in shard r * shards div n, whose first row is ceil(shard * n / shards)
    return total.withColumn("shard", F.expr(f"(_rank * {shards}) div _n").cast("int")).select(
        "doc_id", "source", "size", "text_crc32", "frac_rank", "shard",
        (F.col("_rank") - F.expr(f"(shard * _n + {shards - 1}) div {shards}")).cast("long").alias("slot"))
