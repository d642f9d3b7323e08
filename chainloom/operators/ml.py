"""Splits, random forest and ROC points of labelled feature rows."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEED = 20


def split(rows: DataFrame, ratios: dict[int, float] | None = None, key: str = "sample", seed: int = SEED) -> DataFrame:
    """Rows with ``is_train``: of each label (0, 1) the first share by a seeded hash of the key.

    The place in a label comes from its counts by hash range, so no label is sorted in one task."""
    ratios = ratios or {0: 0.9, 1: 0.9}
    marked = rows.withColumn("hash", F.xxhash64(F.lit(seed), F.col(key).cast("string"))).withColumn("range", F.shiftright("hash", 52))
    sizes = marked.groupBy("label", "range").agg(F.count("*").alias("size"))
    w = Window.partitionBy("label").orderBy("range")
    starts = sizes.select("label", "range", (F.sum("size").over(w) - F.col("size")).alias("start"), F.sum("size").over(Window.partitionBy("label")).alias("total"))
    place = F.row_number().over(Window.partitionBy("label", "range").orderBy("hash", key)) + F.col("start")
    share = F.when(F.col("label") == 1, ratios[1]).otherwise(ratios[0])
    placed = marked.join(F.broadcast(starts), ["label", "range"])  # at most 4096 ranges a label
    return placed.withColumn("is_train", place <= F.floor(share * F.col("total"))).drop("hash", "range", "start", "total")


def fit_forest(train: DataFrame, features: list[str], trees: int = 100, depth: int = 10, seed: int = SEED):
    """(assembler, model)."""
    assembler = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    model = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed).fit(assembler.transform(train))
    return assembler, model


def scored(fitted, rows: DataFrame) -> DataFrame:
    """Rows with ``score`` (probability of label 1) and ``prediction``."""
    assembler, model = fitted
    return model.transform(assembler.transform(rows)).withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability")


def accuracy(rows: DataFrame) -> DataFrame:
    return rows.agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"))


#: Bins that scores are summed by before any order over all of them is needed.
ROC_BINS = 4096


def roc(rows: DataFrame) -> DataFrame:
    """(threshold, fp, tp): rates at each distinct score, and the point before all.

    Running sums are taken within bins of scores and over the sums of bins, so no task orders all scores."""
    by = rows.groupBy("score").agg(F.sum((F.col("label") == 1).cast("long")).alias("p"), F.sum((F.col("label") != 1).cast("long")).alias("n"))
    ends = rows.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    width = F.try_divide(F.col("score") - F.col("lo"), F.col("hi") - F.col("lo"))
    binned = by.crossJoin(F.broadcast(ends)).select("score", "p", "n", F.least(F.lit(ROC_BINS - 1), F.floor(F.coalesce(width, F.lit(0.0)) * ROC_BINS)).cast("int").alias("bin"))
    sums = binned.groupBy("bin").agg(F.sum("p").alias("bp"), F.sum("n").alias("bn"))  # at most ROC_BINS rows
    above, whole = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = lambda c: F.coalesce(c, F.lit(0))
    sums = sums.select("bin", zero(F.sum("bp").over(above)).alias("before_p"), zero(F.sum("bn").over(above)).alias("before_n"), F.sum("bp").over(whole).alias("all_p"), F.sum("bn").over(whole).alias("all_n"))
    w = Window.partitionBy("bin").orderBy(F.desc("score"))
    inside = binned.select("score", "bin", F.sum("p").over(w).alias("cp"), F.sum("n").over(w).alias("cn")).join(F.broadcast(sums), "bin")
    points = inside.select(F.col("score").alias("threshold"), F.try_divide(F.col("cn") + F.col("before_n"), F.col("all_n")).alias("fp"), F.try_divide(F.col("cp") + F.col("before_p"), F.col("all_p")).alias("tp"))
    return points.unionByName(rows.sparkSession.createDataFrame([(float("inf"), 0.0, 0.0)], "threshold double, fp double, tp double"))


def area_under_roc(rows: DataFrame) -> float:
    return BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="score").evaluate(rows)


def evaluate(rows: DataFrame, features: list[str], key: str = "sample", trees: int = 100, depth: int = 10) -> DataFrame:
    """One row: train and test sizes, accuracy and area under the ROC of a forest on the held-back rows."""
    parts = split(rows, key=key).persist()
    try:
        fitted = fit_forest(parts.where("is_train"), features, trees, depth)
        test = scored(fitted, parts.where("not is_train")).persist()
        sizes = parts.agg(F.sum(F.col("is_train").cast("long")), F.sum((~F.col("is_train")).cast("long"))).first()
        row = (sizes[0], sizes[1], accuracy(test).first()[0], area_under_roc(test))
        test.unpersist()
    finally:
        parts.unpersist()
    return rows.sparkSession.createDataFrame([row], "n_train long, n_test long, accuracy double, auc double")
