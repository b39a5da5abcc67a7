"""Learning set to classifier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions.columns import ratio
from tickloom.operators.layout import prefix_scan
from tickloom.session import ensure_checkpoint_dir


def standard_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / population deviation of the whole set, from one aggregate row."""
    stats = df.agg(F.struct(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).alias("_s"))
    s = stats.scalar()
    return df.withColumn("_s", s).withColumns({c: ratio(F.col(c) - F.col(f"_s.m_{c}"), F.col(f"_s.s_{c}")) for c in columns}).drop("_s")


def id_hash(*keys: str) -> Column:
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))


def balance_classes(df: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    """Class 0 cut to half the number of the others, chosen by the hash of the row's key.

    The rank of a row within class 0 is a two-level count over hash slices, so the class is not
    sorted in one task.
    """
    d = df.withColumn("_h", id_hash(*keys))
    others = d.filter(F.col(label) != 0).agg(F.floor(F.count(F.lit(1)) / 2)).scalar()
    zero = prefix_scan(d.filter(F.col(label) == 0), {"_n": ("count", F.lit(1))}, [label], ["_h", *keys], segment=F.substring("_h", 1, 2))
    return zero.filter(F.col("_n") <= others).drop("_n", "_h").unionByName(d.filter(F.col(label) != 0).drop("_h"))


def split(df: DataFrame, keys: Sequence[str], train_below: str = "99999999") -> tuple[DataFrame, DataFrame]:
    """60/40 by the first 32 bits of the key hash; the same rows whatever the partitioning."""
    h = F.substring(id_hash(*keys), 1, 8)
    return df.filter(h < train_below), df.filter(h >= train_below)


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Weight n / (classes * class size), as for balanced class weights."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_k"))
    total = sizes.agg(F.struct(F.sum("_k").alias("n"), F.count(F.lit(1)).alias("c"))).scalar()
    sizes = sizes.withColumn("_t", total).withColumn("weight", F.col("_t.n") / (F.col("_t.c") * F.col("_k")))
    return df.join(sizes.select(label, "weight"), label)


def train_forest(df: DataFrame, columns: Sequence[str], label: str = "label", trees: int = 500, depth: int = 3, seed: int = 42) -> PipelineModel:
    """Scaling and random forest as one model; the label is shifted to 0..2.

    Fitting reads the set once per tree level, so it is written to the checkpoint folder first.
    """
    ensure_checkpoint_dir(df.sparkSession)
    d = class_weights(df.checkpoint(), label).withColumn("_y", (F.col(label) + 1).cast("double"))
    d = d.checkpoint()
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(columns), outputCol="_raw", handleInvalid="skip"),
        StandardScaler(inputCol="_raw", outputCol="_x", withMean=True),
        RandomForestClassifier(featuresCol="_x", labelCol="_y", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed),
    ]).fit(d)


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Class probabilities for -1, 0 and 1 and the predicted class."""
    p = vector_to_array(F.col("probability"))
    out = model.transform(df)
    return out.withColumns({"p_short": p[0], "p_none": p[1], "p_long": p[2], "predicted": (F.col("prediction") - 1).cast("int")}).drop(
        "_raw", "_x", "rawPrediction", "probability", "prediction")


def classification_report(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Precision, recall, f1 and support per class from the confusion counts."""
    cells = df.groupBy(label, predicted).agg(F.count(F.lit(1)).alias("n"))
    side = F.explode(F.array(F.struct(F.col(label).alias("class"), F.lit(True).alias("actual")),
                             F.struct(F.col(predicted).alias("class"), F.lit(False).alias("actual"))))
    rows = cells.withColumn("_s", side).select("_s.*", "n", (F.col(label) == F.col(predicted)).alias("hit"))
    m = rows.groupBy("class").agg(
        F.sum(F.when(F.col("actual"), F.col("n")).otherwise(0)).alias("support"), F.sum(F.when(~F.col("actual"), F.col("n")).otherwise(0)).alias("_p"),
        F.sum(F.when(F.col("hit") & F.col("actual"), F.col("n")).otherwise(0)).alias("_tp"))
    m = m.withColumns({"precision": F.coalesce(ratio("_tp", "_p"), F.lit(0.0)), "recall": F.coalesce(ratio("_tp", "support"), F.lit(0.0))})
    f1 = F.coalesce(ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return m.withColumn("f1", f1).drop("_p", "_tp")


def prediction_messages(scored: DataFrame, target: str = "target_pct") -> DataFrame:
    """One JSON message per newest bar."""
    body = F.to_json(F.struct("trading_pair", "ts", F.array("p_short", "p_none", "p_long").alias("probabilities"), F.col(target).alias("target_pct")))
    return scored.select(F.col("trading_pair").alias("key"), body.alias("value"))
