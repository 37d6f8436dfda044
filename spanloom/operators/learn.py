"""Learned scorers with Spark's own estimators: logistic regression, boosted trees, isotonic maps, and out-of-fold prediction."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fit(estimator, df: DataFrame, features: Sequence[str]) -> Model:
    assembled = VectorAssembler(inputCols=list(features), outputCol="__x", handleInvalid="keep")
    return Pipeline(stages=[assembled, estimator]).fit(df.withColumn("__y", F.col("y").cast("double")))


def fit_logistic(df: DataFrame, features: Sequence[str], penalty: float = 1.0) -> Model:
    """Rows with y (0 or 1). ``penalty`` is the weight of half the squared norm against the sum of losses."""
    n = max(1, df.count())
    return _fit(LogisticRegression(featuresCol="__x", labelCol="__y", regParam=penalty / n, standardization=False, maxIter=200), df, features)


def fit_boosted(df: DataFrame, features: Sequence[str], rounds: int = 50, depth: int = 3, seed: int = 7) -> Model:
    return _fit(GBTClassifier(featuresCol="__x", labelCol="__y", maxIter=rounds, maxDepth=depth, seed=seed), df, features)


def predict(model: Model, df: DataFrame, name: str = "p") -> DataFrame:
    out = model.transform(df.withColumn("__y", F.lit(0.0)))
    return out.withColumn(name, vector_to_array("probability")[1]).select(*df.columns, name)


def fingerprint(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """rows and a sum of row hashes: the same for the same rows in any order and partitioning, whatever their number."""
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("h")).first()
    return {"rows": str(row["n"]), "hash": str(row["h"] or 0)}


def save_model(model: PipelineModel, path: str, *, features: Sequence[str], trained_on: Mapping[str, str], **more: str) -> None:
    """A fitted pipeline below ``path``, with what it was trained on beside it. Both are written by Spark, so the path may be remote.

    The description is written last, so a model without one is unfinished and isn't loaded.
    """
    model.write().overwrite().save(f"{path}/model")
    body = json.dumps({"features": list(features), "trained_on": dict(trained_on), **more}, sort_keys=True)
    SparkSession.active().createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load_model(spark: SparkSession, path: str, trained_on: Mapping[str, str] | None = None) -> tuple[PipelineModel, dict]:
    """A stored model and its description. Raises ValueError if it was trained on other rows than ``trained_on`` describes."""
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    if trained_on is not None and about["trained_on"] != dict(trained_on):
        raise ValueError(f"the model was trained on {about['trained_on']}, not {dict(trained_on)}")
    return PipelineModel.load(f"{path}/model"), about


def out_of_fold(df: DataFrame, features: Sequence[str], group: str, fit: Callable[[DataFrame, Sequence[str]], Model] = fit_logistic, folds: int = 5) -> DataFrame:
    """Each row scored by a model of the other folds; a group's rows share a fold."""
    rows = df.withColumn("__f", F.pmod(F.xxhash64(group), F.lit(folds)))
    out = None
    for k in range(folds):
        part = predict(fit(rows.where(F.col("__f") != k), features), rows.where(F.col("__f") == k))
        out = part if out is None else out.unionByName(part)
    return out.drop("__f")


def fit_isotonic(df: DataFrame, score: str, label: str = "y") -> Model:
    """Monotone map of a score to a probability: linear between its knots, flat beyond."""
    return IsotonicRegression(featuresCol="__s", labelCol="__y").fit(df.select(F.col(score).cast("double").alias("__s"), F.col(label).cast("double").alias("__y")))


def apply_isotonic(model: Model, df: DataFrame, score: str, name: str = "calibrated") -> DataFrame:
    return model.transform(df.withColumn("__s", F.col(score).cast("double"))).withColumnRenamed("prediction", name).drop("__s")


def transfer(df: DataFrame, features: Sequence[str], source: str, values: Sequence[str]) -> DataFrame:
    """train, test, auroc: a model of each source's rows scored on each source's rows. values: the few sources, named by the caller."""
    from .stats import auroc

    out = None
    for v in values:
        scored = auroc(predict(fit_logistic(df.where(F.col(source) == v), features), df), "p", "y", [source]).select(F.lit(v).alias("train"), F.col(source).alias("test"), "auroc")
        out = scored if out is None else out.union(scored)
    return out


def best_setting(df: DataFrame, value: str, score: str, group: Sequence[str] = ()) -> DataFrame:
    """The value with the highest score (to ten digits); ties go to the smaller value."""
    return df.groupBy(*group).agg(F.max_by(value, F.struct(F.round(score, 10), -F.col(value))).alias(value), F.max(score).alias(score))


def same_predictions(a: DataFrame, b: DataFrame, key: str, tolerance: float = 1e-9) -> DataFrame:
    """rows, equal: whether two sets of predictions (key, p) are the same within the tolerance."""
    both = a.select(key, F.col("p").alias("x")).join(b.select(key, F.col("p").alias("y")), key, "full")
    return both.agg(F.count("*").alias("rows"), F.bool_and(F.coalesce(F.abs(F.col("x") - F.col("y")) <= tolerance, F.lit(False))).alias("equal"))
