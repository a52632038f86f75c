"""Model search by nested folds, out-of-fold predictions and calibration, on Spark's own estimators."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, UnivariateFeatureSelector, VarianceThresholdSelector, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.operators.neighbours import NearestNeighbours
from attesta.plans.staging import Staging

#: Estimators by name; those that Spark has no form of raise a clear error.
ESTIMATORS: dict[str, Callable[..., Estimator]] = {
    "ridge": lambda alpha=1.0: LinearRegression(regParam=alpha, elasticNetParam=0.0, solver="normal"),
    "elastic_net": lambda alpha=1.0, l1_ratio=0.5: LinearRegression(regParam=alpha, elasticNetParam=l1_ratio),
    "random_forest": lambda trees=50, depth=8, seed=0: RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed),
    "boosting": lambda rounds=30, depth=4, seed=0: GBTRegressor(maxIter=rounds, maxDepth=depth, seed=seed),
    "logistic": lambda alpha=0.0: LogisticRegression(regParam=alpha),
    "linear_svc": lambda alpha=0.0: LinearSVC(regParam=alpha),
    "random_forest_classifier": lambda trees=50, depth=8, seed=0: RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed),
    "boosting_classifier": lambda rounds=30, depth=4, seed=0: GBTClassifier(maxIter=rounds, maxDepth=depth, seed=seed),
    "knn": lambda k=5: NearestNeighbours(k=k),
    "knn_classifier": lambda k=5: NearestNeighbours(k=k, classify=True),
    "gaussian_nb": lambda: NaiveBayes(modelType="gaussian"),
    "mlp": lambda layers=(4, 8, 2), seed=0: MultilayerPerceptronClassifier(layers=list(layers), seed=seed),
}
ABSENT = ("extra_trees", "svr", "svc", "xgboost", "catboost", "lightgbm")


class DependencyUnavailable(RuntimeError):
    """A toolkit or estimator that isn't here; nothing takes its place."""


def estimator(name: str, **options: object) -> Estimator:
    if name in ABSENT:
        raise DependencyUnavailable(f"{name} has no Spark form here; no fallback")
    return ESTIMATORS[name](**options)


def pipeline(features: list[str], model: Estimator, label: str, select: int | None = None, classify: bool = False, least_variance: float = 0.0) -> Pipeline:
    """Median imputation, variance filter, scaling, selection and a model, all fitted on the training rows alone."""
    filled = [f"{f}__filled" for f in features]
    stages = [Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="__raw"), VarianceThresholdSelector(varianceThreshold=least_variance, featuresCol="__raw", outputCol="__varied"), StandardScaler(withMean=True, inputCol="__varied", outputCol="__scaled")]
    last = "__scaled"
    if select:
        selector = UnivariateFeatureSelector(featuresCol="__scaled", outputCol="__chosen", labelCol=label, selectionMode="numTopFeatures").setFeatureType("continuous").setLabelType("categorical" if classify else "continuous").setSelectionThreshold(select)
        stages, last = [*stages, selector], "__chosen"
    return Pipeline(stages=[*stages, model.copy({model.featuresCol: last, model.labelCol: label})])


def score_column(rows: DataFrame) -> Column:
    """The probability of class 1 if there is one, else the prediction."""
    return vector_to_array("probability")[1] if "probability" in rows.columns else F.col("prediction")


def out_of_fold(rows: DataFrame, folds: int, fold: str, make: Callable[[], Pipeline], row_id: str) -> DataFrame:
    """``row_id, fold, prediction``: each row predicted by a model that saw no row of its fold."""
    stage, parts = Staging(rows.sparkSession, "oof"), None
    for k in range(folds):
        fitted = make().fit(rows.where(F.col(fold) != k))
        scored = fitted.transform(rows.where(F.col(fold) == k))
        got = stage.put(scored.select(row_id, F.lit(k).alias(fold), score_column(scored).alias("prediction")), f"fold{k}")
        parts = got if parts is None else parts.unionByName(got)
    return parts


def candidates(space: dict[str, list], n: int, seed: int, anchor: dict | None = None) -> list[dict]:
    """``n`` distinct configurations of a finite space in hash order of the seed, an anchor first."""
    names = sorted(space)
    every = [dict(zip(names, v, strict=True)) for v in product(*[space[k] for k in names])]
    every.sort(key=lambda c: hashlib.sha256(json.dumps([seed, c], sort_keys=True).encode()).hexdigest())
    first = [anchor] if anchor else []
    return (first + [c for c in every if c != anchor])[: min(n, len(every))]


@dataclass(frozen=True)
class Trial:
    trial_id: str
    config: dict
    score: float


def search(rows: DataFrame, folds: int, fold: str, space: dict[str, list], n: int, seed: int, make: Callable[[dict], Pipeline], y: str, row_id: str) -> list[Trial]:
    """Trials by pooled root mean square error over the folds, best first; ties go to the smaller id."""
    done = []
    for k, config in enumerate(candidates(space, n, seed)):
        got = out_of_fold(rows, folds, fold, lambda config=config: make(config), row_id).join(rows.select(row_id, y), row_id)
        done.append(Trial(f"t{k:03d}", config, got.agg(F.sqrt(F.avg((F.col(y) - F.col("prediction")) ** 2)).alias("s")).first()["s"]))
    return sorted(done, key=lambda t: (t.score, t.trial_id))


def calibrate(scores: DataFrame, method: str, y: str, score: str) -> PipelineModel:
    """A map from out-of-fold scores to probabilities: ``sigmoid`` or ``isotonic``."""
    assemble = VectorAssembler(inputCols=[score], outputCol="__score")
    if method == "sigmoid":
        return Pipeline(stages=[assemble, LogisticRegression(featuresCol="__score", labelCol=y)]).fit(scores)
    if method == "isotonic":
        return Pipeline(stages=[assemble, IsotonicRegression(featuresCol="__score", labelCol=y)]).fit(scores.withColumn(y, F.col(y).cast("double")))
    raise ValueError(f"unknown method {method}")


def calibrate_across(scores: DataFrame, folds: int, fold: str, method: str, y: str, score: str, row_id: str) -> DataFrame:
    """``row_id, fold, probability``: each fold's scores by a map that was fitted on the other folds alone."""
    stage, parts = Staging(scores.sparkSession, "calibration"), []
    for k in range(folds):
        fitted = calibrate(scores.where(F.col(fold) != k), method, y, score)
        got = fitted.transform(scores.where(F.col(fold) == k))
        parts.append(stage.put(got.select(row_id, F.col(fold), score_column(got).alias("probability")), f"fold{k}"))
    return reduce(DataFrame.unionByName, parts)


def indicator_score(present: Column, weights: dict[str, float], intercept: float) -> Column:
    """Intercept and the fixed weights of the rules that are present."""
    w = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])
    return F.aggregate(present, F.lit(float(intercept)), lambda s, p: s + F.coalesce(w[p], F.lit(0.0)))
