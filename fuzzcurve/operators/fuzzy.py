"""Fuzzy features: knots learned by one aggregate, memberships as plain expressions.

Fitting brings ``sets`` numbers for each feature to the driver; transforming is
one projection with literal knots, on batch or streaming tables alike.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalar import dominant, triangular
from ..sources.tables import linspace
from .profile import tall, value_counts
from .rank import quantiles, quantiles_of_others

LABELS = ("Low", "Medium", "High")
Knots = Mapping[str, Sequence[float]]


def labels_of(n_sets: int) -> tuple[str, ...]:
    """Low, Medium, High for three sets, else Low, Medium 1, ..., High (Low and High for two)."""
    return LABELS if n_sets == 3 else ("Low", *[f"Medium {i}" for i in range(1, n_sets - 1)], "High")


def fit_knots(df: DataFrame, features: Sequence[str], strategy: str = "quantile", transform: str | None = None, probs: Sequence[float] | None = None, n_sets: int = 3, accuracy: int | None = None) -> dict[str, list[float]]:
    """``n_sets`` knots a feature from one row for each curve.

    ``quantile``: the quantiles ``probs``, by default evenly spaced inside
    (0.25, 0.5 and 0.75 for three); ``minmax``: evenly from least to largest;
    ``kmeans``: sorted cluster centres. ``transform='log1p'`` takes the
    logarithm first, and the knots are on that scale. A feature without a
    known value has no knots.
    """
    if n_sets < 2:
        raise ValueError("n_sets must be 2 or more")
    x = {f: F.log1p(F.col(f).cast("double")) if transform == "log1p" else F.col(f).cast("double") for f in features}
    if strategy == "quantile":
        own = df.select(*[c.alias(f) for f, c in x.items()])
        found = quantiles(tall(own, list(features)), ["col"], "value", probs or [i / (n_sets + 1) for i in range(1, n_sets + 1)], accuracy)
        knots = {r["col"]: list(r["q"]) for r in found.collect()}
        return {f: knots.get(f, []) for f in features}
    if strategy == "minmax":
        row = df.agg(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(f) for f, c in x.items()]).first()
        even = lambda lo, hi: [lo + (hi - lo) * i / (n_sets - 1) for i in range(n_sets)]
        return {f: even(*row[f]) if row[f]["lo"] is not None else [] for f in features}
    if strategy == "kmeans":
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.feature import VectorAssembler

        out = {}
        for f, c in x.items():
            data = VectorAssembler(inputCols=["x"], outputCol="v").transform(df.select(c.alias("x")).na.drop())
            out[f] = sorted(float(v[0]) for v in KMeans(k=n_sets, seed=7, featuresCol="v").fit(data).clusterCenters())
        return out
    raise ValueError(f"unknown strategy {strategy}")


def knot_report(spark: SparkSession, knots: Knots, labels: Sequence[str] | None = None) -> DataFrame:
    return spark.createDataFrame([(f, label, float(k)) for f, ks in knots.items() for label, k in zip(labels or labels_of(len(ks)), ks)], "feature string, label string, knot double")


def column(feature: str, label: str) -> str:
    return f"{feature} [{label}]"


def fuzzify(df: DataFrame, knots: Knots, labels: Sequence[str] | None = None, transform: str | None = None) -> DataFrame:
    """``df`` and a membership column for each feature and label; a streaming table will do, since it is a projection."""
    new = {}
    for f, ks in knots.items():
        x = F.col(f).cast("double")
        new |= {column(f, label): m for label, m in zip(labels or labels_of(len(ks)), triangular(F.log1p(x) if transform == "log1p" else x, ks))}
    return df.withColumns(new)


def membership_curve(spark: SparkSession, lo: float, hi: float, knots: Sequence[float], n: int = 400) -> DataFrame:
    return memberships(linspace(spark, lo, hi, n), knots)


def memberships(df: DataFrame, knots: Sequence[float], x: str = "x") -> DataFrame:
    return df.withColumns(dict(zip(("low", "medium", "high"), triangular(F.col(x), knots))))


def dominant_set(df: DataFrame, feature: str, labels: Sequence[str] = LABELS) -> DataFrame:
    return df.withColumn("dominant", dominant([F.col(f"`{column(feature, label)}`") for label in labels], labels))


def dominant_counts(df: DataFrame, feature: str, labels: Sequence[str] = LABELS) -> DataFrame:
    """Rows of each label, labels without rows included."""
    spark = df.sparkSession
    got = value_counts(dominant_set(df, feature, labels), "dominant").withColumnRenamed("dominant", "label")
    every = spark.createDataFrame([(label,) for label in labels], "label string")
    return every.join(got, "label", "left").select("label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def check_partition_of_unity(df: DataFrame, features: Sequence[str], labels: Sequence[str] = LABELS) -> DataFrame:
    sums = F.array(*[F.struct(F.lit(f).alias("feature"), sum((F.col(f"`{column(f, label)}`") for label in labels), F.lit(0.0)).alias("s")) for f in features])
    return df.select(F.explode(sums).alias("p")).groupBy("p.feature").agg(F.min("p.s").alias("lo"), F.max("p.s").alias("hi"))


def saturation(df: DataFrame, feature: str, knots: Sequence[float], label: str = "High", eps: float = 0.999) -> DataFrame:
    return df.agg(F.count_if(F.col(f"`{column(feature, label)}`") >= eps).alias("n_saturated"), F.lit(float(knots[-1])).alias("top_knot"), F.max(F.col(feature)).cast("double").alias("hi"))


def joint_view(df: DataFrame, fx: str, fy: str, labels: Sequence[str] = LABELS) -> DataFrame:
    """(x, y, dominant label of x) of fuzzified rows."""
    return dominant_set(df, fx, labels).select(F.col(fx).alias("x"), F.col(fy).alias("y"), "dominant")


def fold_knots(df: DataFrame, feature: str, fold: str, folds: int, probs: Sequence[float] = (0.25, 0.5, 0.75), accuracy: int | None = None) -> DataFrame:
    """(fold, k0, k1, k2): knots of each fold's training rows, those of the other folds."""
    q = quantiles_of_others(df, fold, folds, feature, list(probs), accuracy)
    return q.select(F.col(fold).alias("fold"), *[F.col("q")[i].alias(f"k{i}") for i in range(len(probs))])


def representation(df: DataFrame, features: Sequence[str], kind: str, labels: Sequence[str] = LABELS, out: str = "features") -> DataFrame:
    """A feature vector: 'crisp' columns, 'fuzzy' memberships or both ('hybrid')."""
    from pyspark.ml.feature import VectorAssembler

    fuzzy = [column(f, label) for f in features for label in labels]
    cols = {"crisp": list(features), "fuzzy": fuzzy, "hybrid": [*features, *fuzzy]}[kind]
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="skip").transform(df)
