"""Registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import centroids, mixing
from tickloom.llm.common import table
from tickloom.llm.forest import nearest
from tickloom.llm.langid import language_id
from tickloom.llm.licences import licence_scan
from tickloom.llm.packing import pack
from tickloom.llm.paragraphs import removals
from tickloom.llm.periodic import periodic_runs
from tickloom.llm.secrets import secret_scan
from tickloom.llm.sharding import stratified_shards
from tickloom.llm.simhash import simhash_components
from tickloom.llm.tiles import cosine_links
from tickloom.llm.tokens import token_counts

#: The ranks of the vocabulary in byte_bpe_50k.json.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")

Query = Callable[[SparkSession, str], DataFrame]


def op1_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(table(spark, sf_dir, "documents"))


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), VOCABULARY, public_tokenizers.PATTERN, with_ids=False)


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mixed(table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "source", "lang", "topic", "tokens",
                      F.round("probability", 6).alias("probability"), "kept")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stratified_shards(table(spark, sf_dir, "documents"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "source", "frac_rank")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cosine_links(table(spark, sf_dir, "embeddings"))


def op11_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def planted_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with a periodic tail in every tenth text (h = crc32 of the decimal doc_id, g = h div 10): from word
    g mod n on, the first words of that tail are repeated."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")
    n = F.size(words)
    a = F.pmod(g, F.greatest(n, F.lit(1)))
    p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
    tail = F.flatten(F.array_repeat(F.slice(words, (a + 1).cast("int"), p.cast("int")), F.ceil((n - a) / p).cast("int")))
    changed = F.array_join(F.concat(F.slice(words, 1, a.cast("int")), F.slice(tail, 1, (n - a).cast("int"))), " ")
    return docs.withColumn("text", F.when((h % 10 == 0) & (n > 0), changed).otherwise(F.col("text")))


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = periodic_runs(planted_repeats(table(spark, sf_dir, "documents")))
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    # runs come by start and period, so the first of equals stays
    best = F.aggregate("runs", none, lambda b, r: F.when(
        b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"], F.lit("\n")))
    digest = F.sha2(F.replace(F.array_join(lines, ""), F.lit(",\n"), F.lit("\n")), 256)
    best = runs.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), digest.alias("runs_sha256"),
                       F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return best.select("doc_id", "n_runs", "b.start", "b.length", "b.period",
                       F.floor(F.col("b.length") * 1000 / F.col("b.period")).alias("exponent_milli"),
                       "runs_sha256", "collapsed_sha256")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = centroids.clusters(table(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_paragraphs, op2_licences, op3_simhash, op4_packing, op5_neighbours, op6_mixing, op7_language, op8_shards,
    op9_secrets, op10_embeddings, op11_tokens, op12_periodic, op13_centroids)}
ORACLE_SQL: dict[str, str] = {"op6_mixing": mixing.oracle_sql(), "op13_centroids": centroids.oracle_sql()}
