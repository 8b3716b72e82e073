"""Models against what they must satisfy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fuzzcurve.operators import fuzzy, models


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=400), rng.uniform(1, 9, size=400)
    y = 2 * a - 0.5 * b + 3 + rng.normal(size=400) * 0.1
    return spark.createDataFrame([(int(i), float(x), float(z), float(v), int(v > 1), int(i % 2), int(i % 4)) for i, (x, z, v) in enumerate(zip(a, b, y))], "id long, a double, b double, y double, c int, fold int, k int").cache()


def test_linear_model_solves_the_normal_equations(points):
    model = models.fit_regressor(points, "y", ["a", "b"], "linear")
    rows = points.toPandas()
    x = np.column_stack([rows["a"], rows["b"], np.ones(len(rows))])
    want = np.linalg.lstsq(x, rows["y"], rcond=None)[0]
    assert np.allclose([*model.coefficients, model.intercept], want, atol=1e-3)


@pytest.mark.parametrize("kind", sorted(models.REGRESSORS))
def test_regressors_beat_the_mean(points, kind):
    out = models.predict(models.fit_regressor(points.where("fold = 0"), "y", ["a", "b"], kind), points.where("fold = 1"), ["a", "b"]).toPandas()
    assert ((out["p"] - out["y"]) ** 2).mean() < 0.5 * out["y"].var()


@pytest.mark.parametrize("kind", sorted(models.CLASSIFIERS))
def test_classifiers_score_between_0_and_1(points, kind):
    out = models.predict(models.fit_classifier(points.where("fold = 0"), "c", ["a", "b"], kind), points.where("fold = 1"), ["a", "b"]).toPandas()
    assert out["score"].between(0, 1).all() and (out["p"] == out["c"]).mean() > 0.8


def test_kmeans_knots_are_a_fixed_point(points):
    """Each knot is the mean of the values nearest to it."""
    knots = fuzzy.fit_knots(points, ["b"], "kmeans")["b"]
    values = np.array([r["b"] for r in points.select("b").collect()])
    nearest = np.abs(values[:, None] - np.array(knots)[None, :]).argmin(axis=1)
    assert knots == sorted(knots) and np.allclose([values[nearest == i].mean() for i in range(3)], knots, atol=0.05)


def test_curve_models(points):
    curves = points.withColumn("gx", F.col("k") / 3)
    with_time = models.predict(models.curve_regressor(curves, ["a", "b"]), curves, ["a", "b", "gx"])
    assert with_time.where("p is null").count() == 0
    assert set(models.grid_models(curves, ["a", "b"], (1, 3))) == {1, 3}


def test_importances_are_shares(points):
    rows = models.importance(points, "y", ["a", "b"]).toPandas()
    assert np.isclose(rows["weight"].sum(), 1) and (rows["weight"] >= 0).all() and len(rows) == 8
    assert np.allclose(rows.groupby("feature")["weight"].sum(), rows.groupby("feature")["family"].first())


def test_representations_share_rows(spark, points):
    rows = models.compare_representations(points, "y", ["a", "b"], "fold", 2).toPandas()
    assert sorted(rows["representation"].unique()) == ["crisp", "fuzzy", "hybrid"] and len(rows) == 6
    assert (rows.groupby("fold")["n"].nunique() == 1).all() and (rows["metric"] > 0).all()
    crisp, hybrid = (rows[rows["representation"] == r]["metric"].mean() for r in ("crisp", "hybrid"))
    assert crisp < 0.2 and hybrid < 0.3  # the truth is linear


def test_grouped_models_equal_single_ones(points):
    """Every group's model from one aggregate is the least-squares model of its rows; dependent features get the least norm."""
    rows = points.toPandas()
    got = {r["k"]: r for r in models.grouped_linear(points, "y", ["a", "b"], ["k"]).collect()}
    for k, own in rows.groupby("k"):
        want = np.linalg.lstsq(np.column_stack([own["a"], own["b"], np.ones(len(own))]), own["y"], rcond=None)[0]
        assert np.allclose([*got[k]["slopes"], got[k]["intercept"]], want) and got[k]["n"] == len(own)
    twice = points.withColumn("d", F.col("a") * 2).withColumn("e", F.lit(1.0))
    features = ["a", "d", "e", "b"]
    one = models.predict_linear(twice, models.grouped_linear(twice, "y", features, ["k"]), features, ["k"]).select("id", "p").toPandas()
    two = models.predict_linear(points, models.grouped_linear(points, "y", ["a", "b"], ["k"]), ["a", "b"], ["k"]).select("id", "p").toPandas()
    assert np.allclose(one.sort_values("id")["p"], two.sort_values("id")["p"])
    none = points.withColumn("y", F.when(F.col("k") > 0, F.col("y")))
    assert {r["k"] for r in models.grouped_linear(none, "y", ["a", "b"], ["k"]).collect()} == {1, 2, 3}


def test_compared_models_equal_those_fitted_one_by_one(points):
    got = {(r["representation"], r["fold"]): r["metric"] for r in models.compare_representations(points, "y", ["a", "b"], "fold", 2).collect()}
    for i in range(2):
        train, test = points.where(F.col("fold") != i), points.where(F.col("fold") == i)
        knots = fuzzy.fit_knots(train, ["a", "b"])
        for name in ("crisp", "fuzzy", "hybrid"):
            a, b = (fuzzy.representation(fuzzy.fuzzify(x, knots), ["a", "b"], name).select("features", "y").collect() for x in (train, test))
            x, z = (np.column_stack([[r["features"].toArray() for r in rows], np.ones(len(rows))]) for rows in (a, b))
            p = z @ np.linalg.lstsq(x, [r["y"] for r in a], rcond=None)[0]
            assert np.isclose(got[name, i], np.sqrt(np.mean((p - [r["y"] for r in b]) ** 2)))


def test_comparison_for_classes(points):
    rows = models.compare_representations(points, "c", ["a", "b"], "fold", 2, "logistic", "class").toPandas()
    assert len(rows) == 6 and (rows["metric"] > 0.8).all()
