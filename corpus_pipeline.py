"""Corpus pipeline: language, near-duplicates, secrets, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``,
extra ones included. ``run`` writes each stage's result as Parquet in the shared checkpoint folder and gives it
to the next as ``docs``.

Decisions: documents without an identified language go, and those of which no language holds ``MIN_LEAD`` of the
letters; of each group of near-duplicates the document of the smallest doc_id stays; secrets are replaced in the
text; documents are sampled to the raked weights; what is left is packed.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import langid, mixing, nearcopies, packing, secrets
from tickloom.llm.common import table, written
from tickloom.llm.queries import VOCABULARY

#: The share of a document's letters that its leading language must hold.
MIN_LEAD = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents of an identified language."""
    model = langid.learn(docs.filter(~langid.held_out("doc_id")))
    found = langid.identified(model, docs["text"])
    row = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), found.alias("found"))
    known = row.filter((F.col("found.lang_pred") != langid.UNKNOWN) & (F.col("found.score") >= MIN_LEAD))
    return known.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: fingerprints at most two bits apart, found with pivot distance
    tables as in op3, or Jaccard similarity of five-word shingles 0.8 or more."""
    return nearcopies.first_of_near(docs)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts; every document stays."""
    return secrets.redacted(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample documents by their calibrated probabilities."""
    return mixing.sampled(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a packed sequence, with its token ids."""
    return packing.pack(docs, VOCABULARY, public_tokenizers.PATTERN)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", secret_redaction),
          ("mixture", mixture), ("packing", packed)]
#: Models, fingerprints and tokenisers are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
