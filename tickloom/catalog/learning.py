"""M*: scaling, balancing, training, report."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.catalog.labels import BAR, barriers
from tickloom.catalog.registry import query
from tickloom.operators.layout import SERIES
from tickloom.plans import learning as M
from tickloom.plans.features import LearningSet
from tickloom.session import ensure_checkpoint_dir


@query("m01_scaled", "l_orderkey:i l_linenumber:i l_partkey:i q:6 p:6", sql="""SELECT *, (l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER () AS q,
(l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER () AS p FROM lineitem""")
def m01(view):
    d = view("lineitem").withColumnsRenamed({"l_quantity": "q", "l_extendedprice": "p"})
    return M.standard_scale(d, ["q", "p"])


LABELLED = "SELECT event_id, CASE WHEN value > 90 THEN 1 WHEN value < 5 THEN -1 ELSE 0 END AS label FROM events"


def labelled(view):
    return view("events").select("event_id", F.when(F.col("value") > 90, 1).when(F.col("value") < 5, -1).otherwise(0).alias("label"))


@query("m02_balanced", "event_id:i label:i", ctes={"l": LABELLED}, sql="""SELECT event_id, label FROM l WHERE label <> 0
UNION ALL (SELECT event_id, label FROM l WHERE label = 0 ORDER BY md5(CAST(event_id AS VARCHAR)), event_id LIMIT (SELECT count(*) // 2 FROM l WHERE label <> 0))""")
def m02(view):
    return M.balance_classes(labelled(view), ["event_id"])


@query("m03_split", "event_id:i part", ctes={"l": LABELLED}, sql="SELECT event_id, CASE WHEN substr(md5(CAST(event_id AS VARCHAR)), 1, 8) < '99999999' THEN 'train' ELSE 'test' END AS part FROM l")
def m03(view):
    train, test = M.split(labelled(view), ["event_id"])
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query("m05_report", "class:i precision:6 recall:6 f1:6 support:i", ctes={"l": "SELECT l.*, CASE WHEN l.event_id % 3 = 0 THEN 0 ELSE label END AS predicted FROM (" + LABELLED + ") l",
       "c": "SELECT DISTINCT label AS class FROM l",
       "m": """SELECT class, count_if(label = class) AS support, count_if(label = class AND predicted = class) / nullif(count_if(predicted = class), 0) AS precision,
count_if(label = class AND predicted = class) / nullif(count_if(label = class), 0) AS recall FROM l JOIN c ON true GROUP BY class"""},
       sql="SELECT *, 2 * precision * recall / nullif(precision + recall, 0) AS f1 FROM m")
def m05(view):
    d = labelled(view).withColumn("predicted", F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("label")))
    return M.classification_report(d)


@query("m04_forest_report", "class:i precision:4 recall:4 f1:4 support:i", "bars_1h")
def m04(view):
    features = LearningSet().calculate(view("bars_1h"))
    labels = barriers(view).select(*SERIES, "ts", F.col("close_type").alias("label"))
    d = features.join(labels, [*SERIES, "ts"]).na.drop(subset=LearningSet.columns()).select(*SERIES, "ts", "label", *LearningSet.columns())
    ensure_checkpoint_dir(d.sparkSession)
    d = d.checkpoint()
    train, test = M.split(d, ["trading_pair", "ts"])
    model = M.train_forest(M.balance_classes(train, [*SERIES, "ts"]), LearningSet.columns())
    return M.classification_report(M.score(model, test))


@query("a10_label_distribution", "close_type:i n:i", "bars_1h", ctes=BAR, sql="SELECT close_type, count(*) AS n FROM barrier GROUP BY 1")
def a10_labels(view):
    return barriers(view).groupBy("close_type").agg(F.count(F.lit(1)).alias("n"))
