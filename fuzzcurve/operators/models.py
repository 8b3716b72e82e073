"""Models with Spark's own library: regressors, classifiers, curve models, comparisons.

Gradient-boosted trees here are Spark's; they stand in for other boosting
libraries.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.scalar import triangular
from ..sources.tables import scratch
from .fuzzy import LABELS, column, fit_knots, fold_knots, fuzzify, representation
from .metrics import auroc, regression_metrics

SEED = 17
REGRESSORS = {
    "linear": lambda y: LinearRegression(labelCol=y, regParam=1e-6),
    "forest": lambda y: RandomForestRegressor(labelCol=y, numTrees=20, maxDepth=5, seed=SEED),
    "boosted": lambda y: GBTRegressor(labelCol=y, maxIter=10, maxDepth=3, seed=SEED),
}
CLASSIFIERS = {
    "logistic": lambda y: LogisticRegression(labelCol=y, regParam=1e-6),
    "forest": lambda y: RandomForestClassifier(labelCol=y, numTrees=20, maxDepth=5, seed=SEED),
    "boosted": lambda y: GBTClassifier(labelCol=y, maxIter=10, maxDepth=3, seed=SEED),
}


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df if "features" in df.columns else VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip").transform(df)


def fit_regressor(train: DataFrame, y: str, features: Sequence[str] = (), kind: str = "linear") -> Model:
    return REGRESSORS[kind](y).fit(assemble(train.where(F.col(y).isNotNull()), features))


def fit_classifier(train: DataFrame, y: str, features: Sequence[str] = (), kind: str = "logistic") -> Model:
    return CLASSIFIERS[kind](y).fit(assemble(train.where(F.col(y).isNotNull()), features))


def predict(model: Model, df: DataFrame, features: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``p``, and ``score`` (probability of class 1) for classifiers."""
    out = model.transform(assemble(df, features)).withColumnRenamed("prediction", "p")
    return out.withColumn("score", vector_to_array("probability")[1]) if "probability" in out.columns else out


def curve_regressor(points: DataFrame, features: Sequence[str], with_time: bool = True) -> Model:
    """One model over all resampled points (curve_id, gx, y and statics), with or without time as a feature."""
    return fit_regressor(points, "y", [*features, *(["gx"] if with_time else [])], "boosted")


def grid_models(points: DataFrame, features: Sequence[str], ks: Sequence[int]) -> dict[int, Model]:
    """A linear model for each of a few grid points."""
    return {k: fit_regressor(points.where(F.col("k") == k), "y", features, "linear") for k in ks}


def _moments(rows: Sequence[Column], y: Column, n: str) -> list[Column]:
    """Aggregates of the normal equations: count, means, and covariances of the features among themselves and with ``y``."""
    p = range(len(rows))
    return [
        F.count(y).alias(f"n{n}"), F.avg(y).alias(f"y{n}"), F.array(*[F.avg(x) for x in rows]).alias(f"x{n}"),
        F.array(*[F.covar_pop(rows[min(i, j)], rows[max(i, j)]) for i in p for j in p]).alias(f"xx{n}"), F.array(*[F.covar_pop(x, y) for x in rows]).alias(f"xy{n}"),
    ]


def solve_normal(xx: Sequence[float], xy: Sequence[float]) -> list[float]:
    """Least-squares slopes from covariances; of dependent features the slopes of least norm, on their own scales."""
    a = np.array(xx, float).reshape(len(xy), len(xy))
    scale = np.sqrt(np.diag(a))
    scale[scale == 0] = 1.0
    return (np.linalg.pinv(a / np.outer(scale, scale), rcond=1e-9, hermitian=True) @ (np.array(xy, float) / scale) / scale).tolist()


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _slopes(xx: pd.Series, xy: pd.Series) -> pd.Series:
    return pd.Series([solve_normal(a, b) for a, b in zip(xx, xy)])


def grouped_linear(df: DataFrame, y: str, features: Sequence[str], by: Sequence[str]) -> DataFrame:
    """(by, n, intercept, slopes): a least-squares model for each group, all from one aggregate of its normal equations.

    Only moments are shuffled, a row a group and task; each tiny system is
    then solved once, in the task that has its row. Rows with a null are left
    out.
    """
    own = df.na.drop(subset=[*by, y, *features])
    got = own.groupBy(*by).agg(*_moments([F.col(f).cast("double") for f in features], F.col(y).cast("double"), ""))
    got = got.withColumn("slopes", _slopes("xx", "xy"))
    return got.select(*by, "n", (F.col("y") - _dot(F.col("slopes"), F.col("x"))).alias("intercept"), "slopes")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, z: x * z), F.lit(0.0), lambda s, x: s + x)


def predict_linear(df: DataFrame, model: DataFrame, features: Sequence[str], by: Sequence[str]) -> DataFrame:
    """``df`` with ``p``, by each row's group's model of ``grouped_linear``; null where there is none."""
    x = F.array(*[F.col(f).cast("double") for f in features])
    out = df.join(model.select(*by, F.col("intercept").alias("__a"), F.col("slopes").alias("__b")), list(by), "left")
    return out.withColumn("p", F.col("__a") + _dot(F.col("__b"), x)).drop("__a", "__b")


def compare_representations(df: DataFrame, y: str, features: Sequence[str], fold: str, folds: int, kind: str = "linear", target: str = "regression") -> DataFrame:
    """(representation, fold, n, metric): crisp, fuzzy and hybrid features on the same folds and seed.

    Knots come from each fold's training rows only. Linear regressions of all
    folds and representations are solved from one aggregate (see
    ``_compare_linear``); models of other kinds are fitted one by one.
    """
    if kind == "linear" and target == "regression":
        return _compare_linear(df, y, features, fold, folds)
    out = None
    for i in range(folds):
        train, test = df.where(F.col(fold) != i), df.where(F.col(fold) == i)
        knots = fit_knots(train, features)
        for name in ("crisp", "fuzzy", "hybrid"):
            a, b = (representation(fuzzify(x, knots), features, name) for x in (train, test))
            if target == "regression":
                got = regression_metrics(predict(fit_regressor(a, y, kind=kind), b), y).select("n", F.col("rmse").alias("metric"))
            else:
                got = auroc(predict(fit_classifier(a, y, kind=kind), b), y).select((F.col("n_pos") + F.col("n_neg")).alias("n"), F.col("auroc").alias("metric"))
            row = got.select(F.lit(name).alias("representation"), F.lit(i).alias("fold"), "n", "metric")
            out = row if out is None else out.unionByName(row)
    return out


def _compare_linear(df: DataFrame, y: str, features: Sequence[str], fold: str, folds: int) -> DataFrame:
    """Crisp and fuzzy features are blocks of the hybrid ones, so one system a fold holds all three models.

    The systems of all folds stand side by side in one aggregate: a row counts
    in those of the other folds, with features by their knots.
    """
    rows = scratch(df.select(fold, F.col(y).cast("double").alias("__y"), *features).where(F.col(fold).isNotNull()))
    knots: dict[int, dict[str, list[float]]] = {}
    for f in features:
        for r in fold_knots(rows, f, fold, folds).collect():
            knots.setdefault(r["fold"], {})[f] = [r[f"k{j}"] for j in range(len(LABELS))]
    names = [*features, *[column(f, label) for f in features for label in LABELS]]
    blocks = {"crisp": range(len(features)), "fuzzy": range(len(features), len(names)), "hybrid": range(len(names))}
    vector = {i: [F.col(f"`{f}`").cast("double") for f in features] + [m for f in features for m in triangular(F.col(f"`{f}`").cast("double"), k[f])] for i, k in knots.items() if len(k) == len(features)}
    whole = sum((F.col(f"`{f}`").cast("double") for f in features), F.col("__y")).isNotNull()
    known = rows.where(whole)
    sums = [m for i, x in vector.items() for m in _moments([F.when(F.col(fold) != i, c) for c in x], F.when(F.col(fold) != i, F.col("__y")), str(i))]
    got = known.agg(*sums).first() if vector else None
    said = F.lit(None).cast("array<struct<representation:string,p:double>>")
    for i, x in vector.items():
        if not got[f"n{i}"]:
            continue
        xx = np.array(got[f"xx{i}"]).reshape(len(names), -1)
        each = []
        for name, own in blocks.items():
            own = list(own)
            slopes = solve_normal(xx[np.ix_(own, own)].ravel(), [got[f"xy{i}"][j] for j in own])
            p = sum((b * (x[j] - got[f"x{i}"][j]) for j, b in zip(own, slopes)), F.lit(got[f"y{i}"]))
            each.append(F.struct(F.lit(name).alias("representation"), p.alias("p")))
        said = F.when(F.col(fold) == i, F.array(*each)).otherwise(said)
    told = known.select(F.col(fold).alias("fold"), "__y", F.explode(said).alias("x")).select("fold", "__y", "x.*")
    return regression_metrics(told, "__y", by=["representation", "fold"]).select("representation", "fold", "n", F.col("rmse").alias("metric"))


def importance(df: DataFrame, y: str, features: Sequence[str]) -> DataFrame:
    """(feature, column, weight) of a forest on the hybrid representation, and each feature's share as ``family``."""
    hybrid = representation(fuzzify(df, fit_knots(df, features)), features, "hybrid")
    weights = fit_regressor(hybrid, y, kind="forest").featureImportances.toArray()
    names = [(f, f) for f in features] + [(f, column(f, label)) for f in features for label in LABELS]
    rows = df.sparkSession.createDataFrame([(f, c, float(w)) for (f, c), w in zip(names, weights)], "feature string, name string, weight double")
    family = rows.groupBy("feature").agg(F.sum("weight").alias("family"))
    return rows.join(family, "feature")
