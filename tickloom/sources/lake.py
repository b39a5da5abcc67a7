"""Bar, trade, feature and signal tables on shared storage.

Tables are Parquet, partitioned so that the usual filters prune folders: bars by connector and
interval, trades and open interest by day, features and signals by name and day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tickloom.functions.columns import no_nan, ratio
from tickloom.operators.layout import SERIES, prefix_scan

BAR_NUMBERS = ("open", "high", "low", "close", "volume", "quote_asset_volume", "n_trades", "taker_buy_base_volume", "taker_buy_quote_volume")


#: Files of one folder in one write, at most.
WRITERS = 8


def typed_bars(df: DataFrame) -> DataFrame:
    """Numeric columns cast strictly (a bad number is an error), NaN to NULL."""
    return df.withColumns({c: F.col(c).cast("bigint") if c == "n_trades" else no_nan(F.col(c).cast("double"))
                           for c in BAR_NUMBERS if c in df.columns})


def read_bar_files(spark: SparkSession, folder: str, connector: str | None = None, pair: str | None = None, interval: str | None = None) -> DataFrame:
    """Files named connector|pair|interval.parquet; the filters pick files by name before reading."""
    part = lambda v: v if v is not None else "*"
    glob = "|".join(part(v) for v in (connector, pair, interval)) + ".parquet"
    df = spark.read.option("pathGlobFilter", glob).parquet(folder)
    name = F.split(F.regexp_replace(F.url_decode(F.col("_metadata.file_name")), r"\.parquet$", ""), r"\|")
    df = df.withColumns({"connector": name[0], "trading_pair": name[1], "interval": name[2]})
    if "timestamp" in df.columns:
        df = df.withColumn("ts", F.timestamp_seconds(F.col("timestamp").cast("double")).cast("timestamp_ntz")).drop("timestamp")
    return typed_bars(df)


def read_bars(spark: SparkSession, path: str, connector: str | None = None, pair: str | None = None, interval: str | None = None) -> DataFrame:
    """S01 on the partitioned layout: connector and interval prune folders, pair prunes row groups."""
    df = spark.read.parquet(path)
    for c, v in (("connector", connector), ("interval", interval), ("trading_pair", pair)):
        if v is not None:
            df = df.filter(F.col(c) == v)
    return typed_bars(df)


def write_bars(bars: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Snappy Parquet by connector and interval. Rows are clustered by pair and week, not by
    pair alone, so a hot pair spreads over writers and files stay sorted for min/max pruning."""
    week = F.date_trunc("week", "ts")
    (bars.repartition("connector", "interval", "trading_pair", week)
     .sortWithinPartitions("connector", "interval", "trading_pair", "ts")
     .write.mode(mode).partitionBy("connector", "interval").option("compression", "snappy").parquet(path))


def write_daily(df: DataFrame, path: str, keys: tuple[str, ...] = ("connector",), mode: str = "append", ts: str = "ts") -> None:
    """Append to a table partitioned by ``keys`` and day. The rows of one folder are dealt to
    up to ``WRITERS`` tasks by the hash of the row, so a hot venue's day has no single writer."""
    df = df.withColumn("day", F.to_date(ts))
    part = F.pmod(F.xxhash64(*df.columns), F.lit(WRITERS))
    df.repartition(*keys, "day", part).write.mode(mode).partitionBy(*keys, "day").option("compression", "snappy").parquet(path)


def read_daily(spark: SparkSession, path: str, start=None, end=None) -> DataFrame:
    """Whole days are pruned by folder."""
    df = spark.read.parquet(path)
    if start is not None:
        df = df.filter(F.col("day") >= F.to_date(F.lit(start)))
    if end is not None:
        df = df.filter(F.col("day") <= F.to_date(F.lit(end)))
    return df


def write_features(features: DataFrame, path: str) -> None:
    """S10"""
    write_daily(features, path, ("feature_name",))


def write_learning_set(features: DataFrame, path: str) -> None:
    """The classifier's feature table, by venue and day."""
    write_daily(features, path, ("connector",), "overwrite")


def write_signals(signals: DataFrame, path: str) -> None:
    write_daily(signals, path, ("signal_name",))


def newest_first(df: DataFrame, limit: int | None = None, ts: str = "ts", *ties: str) -> DataFrame:
    """Sort by time, newest first; with a limit Spark keeps a bounded top per task."""
    out = df.orderBy(F.desc(ts), *ties)
    return out.limit(limit) if limit else out


def find_features(features: DataFrame, name: str | None = None, pair: str | None = None, connector: str | None = None,
                  start: Column | None = None, end: Column | None = None, limit: int | None = None) -> DataFrame:
    """Inclusive time range, newest first."""
    for c, v in (("feature_name", name), ("trading_pair", pair), ("connector_name", connector)):
        if v is not None:
            features = features.filter(F.col(c) == v)
    if start is not None:
        features = features.filter(F.col("ts") >= start)
    if end is not None:
        features = features.filter(F.col("ts") <= end)
    return newest_first(features, limit, "ts", "trading_pair")


def find_signals(signals: DataFrame, name: str | None = None, pair: str | None = None, category: str | None = None,
                 low: float | None = None, high: float | None = None, limit: int | None = None) -> DataFrame:
    """S12"""
    for c, v in (("signal_name", name), ("trading_pair", pair), ("category", category)):
        if v is not None:
            signals = signals.filter(F.col(c) == v)
    if low is not None:
        signals = signals.filter(F.col("value") >= low)
    if high is not None:
        signals = signals.filter(F.col("value") <= high)
    return newest_first(signals, limit, "ts", "trading_pair")


def retained(df: DataFrame, as_of: Column, days: int, ts: str = "ts") -> DataFrame:
    """Rows young enough to stay."""
    return df.filter(F.col(ts) >= as_of - F.make_dt_interval(days=F.lit(days)))


def without(df: DataFrame, cond: Column) -> DataFrame:
    """delete = keep the rows for which the condition is not true."""
    return df.filter(~F.coalesce(cond, F.lit(False)))


def rewrite_without(spark: SparkSession, path: str, target: str, cond: Column, partitions: list[str]) -> None:
    """Write what is left of a table to ``target`` (a table cannot be read and replaced at once)."""
    without(spark.read.parquet(path), cond).write.mode("overwrite").partitionBy(*partitions).parquet(target)


def inventory(bars: DataFrame, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """Rows, first and last bar, mean volume, return deviation, low and high per series."""
    b = prefix_scan(bars, {"_p": ("prev", "close")}, keys)
    return b.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first_bar"), F.max("ts").alias("last_bar"), F.avg("volume").alias("mean_volume"),
        F.stddev_samp(ratio("close", "_p") - 1).alias("return_std"), F.min("low").alias("low"), F.max("high").alias("high"))


def cleared(bars: DataFrame, pair: str | None = None, interval: str | None = None) -> DataFrame:
    """The lake without a pair and/or an interval; nothing given clears everything."""
    cond = F.lit(True)
    if pair is not None:
        cond = cond & (F.col("trading_pair") == pair)
    if interval is not None:
        cond = cond & (F.col("interval") == interval)
    return without(bars, cond)


def export_frame(df: DataFrame, exported_at: Column, metadata: dict[str, str]) -> DataFrame:
    """Doubles rounded to 8 decimals, metadata and export time as columns."""
    numbers = {f.name: F.round(f.name, 8) for f in df.schema.fields if f.dataType.typeName() == "double"}
    return df.withColumns(numbers | {k: F.lit(v) for k, v in metadata.items()} | {"export_timestamp": exported_at})


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
