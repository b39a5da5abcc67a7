"""Feed payloads to typed frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MICRO = 1e6


def millis(c: str) -> Column:
    return F.timestamp_millis(F.col(c).cast("bigint")).cast("timestamp_ntz")


def trades(raw: DataFrame) -> DataFrame:
    """Aggregate-trade payload (T, p, q, m, a; f and l are dropped)."""
    keep = [c for c in ("connector", "trading_pair") if c in raw.columns]
    return raw.select(*keep, F.col("a").cast("bigint").alias("id"), millis("T").alias("ts"), F.col("p").cast("double").alias("price"),
                      F.col("q").cast("double").alias("volume"), F.col("m").cast("boolean").alias("sell_taker"))


def open_interest(raw: DataFrame) -> DataFrame:
    """Numbers that do not parse become NULL; ``symbol`` is dropped."""
    out = raw.withColumnsRenamed({"sumOpenInterest": "sum_open_interest", "sumOpenInterestValue": "sum_open_interest_value",
                                  "CMCCirculatingSupply": "cmc_circulating_supply"}).drop("symbol")
    numbers = [c for c in ("sum_open_interest", "sum_open_interest_value", "cmc_circulating_supply", "count") if c in out.columns]
    return out.withColumns({c: F.col(c).try_cast("double") for c in numbers}).withColumn("ts", millis("timestamp")).drop("timestamp")


def funding_history(raw: DataFrame) -> DataFrame:
    """S07"""
    return raw.select("symbol", millis("fundingTime").alias("funding_time"), F.col("fundingRate").cast("double").alias("funding_rate"),
                      F.col("markPrice").cast("double").alias("mark_price"))


def _scaled(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return df.withColumns({c: F.col(c) / MICRO for c in columns})


def orders(raw: DataFrame) -> DataFrame:
    """Fixed-point amounts, epoch milliseconds."""
    return _scaled(raw, ("amount", "price")).withColumns({c: millis(c) for c in ("creation_timestamp", "last_update_timestamp")})


def fills(raw: DataFrame) -> DataFrame:
    return _scaled(raw, ("amount", "price", "trade_fee_in_quote")).withColumn("timestamp", millis("timestamp"))


EXECUTOR_CONFIG = "struct<side:string,trading_pair:string,entry_price:double,controller_id:string,level_id:string>"
EXECUTOR_INFO = "struct<level_id:string,close_type:string,order_ids:array<string>,held_position_orders:array<string>>"


def executors(raw: DataFrame, controller_id: str | None = None) -> DataFrame:
    """JSON columns decoded; the controller filter is a plain predicate, so it reaches the source."""
    out = raw if controller_id is None else raw.filter(F.col("controller_id") == controller_id)
    return out.withColumns({"config": F.from_json("config", EXECUTOR_CONFIG), "custom_info": F.from_json("custom_info", EXECUTOR_INFO)})


def health(**relations: DataFrame) -> DataFrame:
    """Status text per relation and one row for all of them."""
    rows = None
    for name, df in relations.items():
        one = df.agg(F.count(F.lit(1)).alias("records")).withColumn("relation", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    text = F.when(F.col("records") > 0, "Correct").otherwise("Error - No records matched")
    rows = rows.select("relation", text.alias("status"), (F.col("records") > 0).alias("ok"))
    every = rows.agg(F.bool_and("ok").alias("ok")).select(
        F.lit("all").alias("relation"), F.when(F.col("ok"), "Correct").otherwise("Error - No records matched").alias("status"), "ok")
    return rows.unionByName(every)
