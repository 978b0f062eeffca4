"""The matcher: boosted trees over the 23 features, and prediction."""

from __future__ import annotations

import json

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave import values as V
from kinweave.operators import trees
from kinweave.sources.sinks import shared_path

#: The random-negative and the hard-negative trainers, with the rounds and depth of the method.
BASELINE = {"maxIter": 600, "maxDepth": 8, "stepSize": 0.08, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"}
PRODUCTION = {"maxIter": 350, "maxDepth": 6, "stepSize": 0.07, "subsamplingRate": 0.85, "featureSubsetStrategy": "0.85", "minInstancesPerNode": 5}
#: Rounds without gain on the validation rows after which BASELINE's training counts as over.
PATIENCE = 50


def _vectors(features: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=V.FEATURES, outputCol="features").transform(features)


def train(features: DataFrame, params: dict = PRODUCTION, seed: int = 42, validation: DataFrame | None = None, patience: int = PATIENCE) -> GBTClassificationModel:
    """``features``: the 23 columns and ``label``; the rarer class weighs as much as the other in sum. With ``validation`` (the same columns) the model ends at its best round."""
    spark = features.sparkSession
    counts = features.agg(F.sum("label").alias("p"), F.count(F.lit(1)).alias("n")).first()
    ratio = (counts["n"] - counts["p"]) / counts["p"] if counts["p"] else 1.0
    rows = lambda df: _vectors(df).select("features", F.col("label").cast("double").alias("label"), F.when(F.col("label") == 1, F.lit(float(ratio))).otherwise(F.lit(1.0)).alias("weight"))
    if parts := trees.tasks(spark, counts["n"], params):
        fitted = trees.fit(features, V.FEATURES, float(ratio), counts["n"], params, seed, parts)
    else:
        # Hundreds of rounds need their lineage cut.
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(shared_path(spark))
        fitted = GBTClassifier(weightCol="weight", seed=seed, **params).fit(rows(features))
    if validation is None:
        return fitted
    return first_rounds(fitted, best_round(fitted.evaluateEachIteration(rows(validation)), patience))


def best_round(losses: list[float], patience: int) -> int:
    """How many rounds early stopping keeps: up to the least loss before ``patience`` rounds pass without a lower one. (Spark's own ``validationTol`` stops at the first such round.)"""
    best = 0
    for k, loss in enumerate(losses):
        if loss < losses[best]:
            best = k
        elif k - best >= patience:
            break
    return best + 1


def first_rounds(model: GBTClassificationModel, n: int) -> GBTClassificationModel:
    own, gateway = model._java_obj, SparkSession.active().sparkContext._gateway
    ml = gateway.jvm.org.apache.spark.ml
    kept, weights = gateway.new_array(ml.regression.DecisionTreeRegressionModel, n), gateway.new_array(gateway.jvm.double, n)
    for k, (tree, weight) in enumerate(zip(own.trees(), own.treeWeights())):
        if k < n:
            kept[k], weights[k] = tree, weight
    return GBTClassificationModel(ml.classification.GBTClassificationModel(own.uid(), kept, weights, own.numFeatures(), 2))


def predict(model: GBTClassificationModel, features: DataFrame) -> DataFrame:
    return model.transform(_vectors(features)).withColumn("probability", vector_to_array("probability")[1]).drop("features", "rawPrediction", "prediction")


def select(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.where(F.col("probability") >= threshold)


def importances(model: GBTClassificationModel, spark: SparkSession, top: int = 10) -> DataFrame:
    rows = [(f, float(w)) for f, w in zip(V.FEATURES, model.featureImportances.toArray(), strict=True)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(top)


def save_model(model: GBTClassificationModel, path: str, config: dict, spark: SparkSession) -> None:
    """The model and, beside it, its configuration as JSON."""
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(config | {"features": V.FEATURES}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")


def load_model(path: str, spark: SparkSession) -> tuple[GBTClassificationModel, dict]:
    config = json.loads("".join(r[0] for r in spark.read.text(f"{path}/config").collect()))
    return GBTClassificationModel.load(f"{path}/model"), config
