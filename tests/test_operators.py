"""Edge curves, invariants and edge tables of the library's operators."""

import math

import pytest
from pyspark.sql import functions as F

from fuzzcurve.functions import scalar
from fuzzcurve.operators import curves, fuzzy, metrics, prep, profile, rank, relate
from fuzzcurve.sources import tables

CURVES = {
    1: [(2, 0.7)],
    2: [(0, 0.1), (1, 0.2), (5, 0.3)],
    3: [(0.5, 0.6), (2, 0.9)],
    4: [(0, 0), (1, 0.5), (2, 0.5), (4, 0.4), (6, 1.2)],
    5: [(0, 0.3)],
    6: [(0, 0), (2, 0.2), (2, 0.4), (10, 0.8)],
    7: [(4, 0.1), (8, 0.9)],
    8: [(0, 0), (1.5, 0.45), (1.5, 0.75), (2.5, 0.6)],
    9: [(0, 0), (1, 0.1), (1, 0.2), (2, 0.3)],
}


@pytest.fixture(scope="module")
def long(spark):
    rows = [(c, i, float(t), float(r)) for c, ps in CURVES.items() for i, (t, r) in enumerate(ps)]
    return spark.createDataFrame([*rows, (10, 0, None, 0.5), (10, 1, 1.0, None), (1, 5, 3.0, float("nan"))], "curve_id long, event_id long, t double, r double")


def expected(points):
    """A plain loop over one curve, written from the definitions."""
    mean = {}
    for t, r in points:
        mean.setdefault(t, []).append(r)
    ts = sorted(mean)
    rs = [sum(mean[t]) / len(mean[t]) for t in ts]

    def at(x):
        if x <= ts[0] or x >= ts[-1]:
            return rs[0] if x <= ts[0] and x < ts[-1] or len(ts) == 1 else rs[-1]
        i = max(j for j, t in enumerate(ts) if t <= x)
        return rs[i] + (x - ts[i]) * (rs[i + 1] - rs[i]) / (ts[i + 1] - ts[i])

    auc = sum((b - a) / ts[-1] * (u + v) / 2 for a, b, u, v in zip(ts, ts[1:], rs, rs[1:])) if ts[-1] > 0 else None
    half = None
    for i, r in enumerate(rs):
        if r >= 0.5:
            half = ts[i] if i == 0 else ts[i - 1] if rs[i] == rs[i - 1] else ts[i - 1] + (0.5 - rs[i - 1]) * (ts[i] - ts[i - 1]) / (r - rs[i - 1])
            break
    return len(ts), ts[-1], rs[-1], max(rs), auc, at(1), at(2), at(3), half


def test_summary_of_edge_curves(long):
    got = {r["curve_id"]: tuple(r)[1:] for r in curves.curve_summary(long).collect()}
    assert set(got) == set(CURVES)
    for c, points in CURVES.items():
        for a, b in zip(got[c], expected(points)):
            assert a == b or a is not None and b is not None and math.isclose(a, b, abs_tol=1e-12), (c, got[c], expected(points))


def test_curves_that_end_at_zero_have_no_area(spark):
    df = spark.createDataFrame([(1, 0, -1.0, 0.2), (1, 1, 0.0, 0.4), (2, 0, 0.0, 0.3)], "curve_id long, event_id long, t double, r double")
    assert {(r["curve_id"], r["n_points"], r["auc_norm"]) for r in curves.curve_summary(df).collect()} == {(1, 2, None), (2, 1, None)}


def test_resample_has_every_grid_point(long):
    rows = curves.resample(long, 50).groupBy("curve_id").agg(F.count("*").alias("n"), F.countDistinct("k").alias("k"), F.min("y").alias("lo")).collect()
    assert {r["curve_id"] for r in rows} == set(CURVES) - {5}
    assert all(r["n"] == r["k"] == 50 and r["lo"] is not None for r in rows)


def test_dips(long):
    assert {r["curve_id"] for r in curves.dips(long).collect() if r["dips"]} == {4, 8}


def test_archetypes_leave_null_out(long):
    got = curves.archetypes(curves.curve_summary(long)).collect()
    assert 5 not in {r["curve_id"] for r in got} and {r["pos"] for r in got} == {0, 1, 3, 4, 6, 7}


def test_empty_tables(spark, long):
    none = long.where("false")
    assert curves.curve_summary(none).count() == 0
    assert curves.archetypes(curves.curve_summary(none)).count() == 0
    assert profile.box_stats(none, "curve_id", "r").count() == 0
    assert {(r["rho"], r["n"]) for r in relate.spearman_matrix(none, ["t", "r"]).collect()} == {(None, 0)}
    assert profile.histogram(none, "r", 3).count() == profile.histogram_log(none, "r").count() == 0
    assert profile.medians(none, ["r"]).first()["median"] is None and fuzzy.fit_knots(none, ["r"]) == {"r": []}


def test_histograms_keep_all_rows(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 1, 2, 3, 5, 8, 10]] + [(None,)], "x double")
    for h in (profile.histogram(df, "x", 9), profile.histogram_log(df, "x", 6)):
        assert h.agg(F.sum("n")).first()[0] == 7
    log = profile.histogram_log(df, "x").orderBy("bin").collect()
    assert len(log) == 21 and math.isclose(log[1]["lo"], 10 ** (1 / 21)) and (log[0]["lo"], log[-1]["hi"]) == (1, 10)
    even = profile.histogram_log(df.withColumn("x", F.col("x") - 1), "x").orderBy("bin").collect()  # one value is 0
    assert len(even) == 22 and sum(r["n"] for r in even) == 7 and all(math.isclose(r["hi"] - r["lo"], 9 / 22) for r in even)
    assert profile.histogram_log(df.where("x = 1"), "x").agg(F.sum("n")).first()[0] == 2


def test_distinct_counts_nulls_as_values(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, 2), (None, 2)], "a int, b int")
    assert profile.distinct_composite(df, ["a", "b"]).first()[0] == 3


def test_memberships(spark):
    df = tables.literal_rows(spark, [5, 12, 25, 34, 46, 120])
    got = [tuple(round(v, 3) for v in r[1:]) for r in fuzzy.memberships(df, [12, 31, 46]).collect()]
    assert got == [(1, 0, 0), (1, 0, 0), (0.316, 0.684, 0), (0, 0.8, 0.2), (0, 0, 1), (0, 0, 1)]
    equal = fuzzy.memberships(tables.literal_rows(spark, [0, 1, 2]), [1, 1, 1]).collect()
    assert [sum(r[1:]) for r in equal] == [1, 1, 1]
    null = spark.createDataFrame([(None,)], "x double")
    assert fuzzy.memberships(null, [1, 2, 3]).first()[1:] == (None, None, None)


def test_first_label_wins_ties(spark):
    df = tables.literal_rows(spark, [21.5]).select(F.col("x").alias("f"))
    assert fuzzy.dominant_set(fuzzy.fuzzify(df, {"f": [12, 31, 46]}), "f").first()["dominant"] == "Low"


def test_average_rank_with_ties(spark):
    import pandas as pd

    values = [3, 1, 2, 2, 5, 5, 5, 0]
    got = sorted((r["v"], r["k"]) for r in rank.average_rank(spark.createDataFrame([("g", float(v)) for v in values], "g string, v double"), ["g"], "v", "k").collect())
    assert got == sorted(zip(map(float, values), pd.Series(values).rank()))


def test_distributed_rank(spark):
    df = spark.range(1000).select("id", (F.col("id") * 37 % 11).cast("double").alias("v"))
    ranked, n = rank.distributed_rank(df, ["v", "id"])
    rows = ranked.orderBy("pos").collect()
    assert n == 1000 and [r["pos"] for r in rows] == list(range(1000)) and ranked.columns == ["id", "v", "pos"]
    assert [(r["v"], r["id"]) for r in rows] == sorted((r["v"], r["id"]) for r in rows)
    assert rank.distributed_rank(df.where("false"), ["v", "id"])[1] == 0


def test_distributed_rank_with_hot_ties(spark, monkeypatch):
    """Nine rows in ten share a value; partitions are cut by the key as well, and as small as Spark is told."""
    n = 20_000
    df = spark.range(n).select(F.format_string("k%07d", F.col("id") * 7919 % n).alias("key"), F.when(F.col("id") % 10 == 0, F.col("id") / 7).otherwise(F.lit(100.0)).alias("v"))
    parts, real = [], rank._placed
    monkeypatch.setattr(rank, "_placed", lambda rows, order: parts.append(real(rows, order)) or parts[-1])
    told = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "50"}
    before = {key: spark.conf.get(key) for key in told}
    for key, value in told.items():
        spark.conf.set(key, value)
    try:
        ranked, count = rank.distributed_rank(df, ["v", "key"])
        rows = ranked.orderBy("pos").collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert count == n and [r["pos"] for r in rows] == list(range(n))
    assert [(r["v"], r["key"]) for r in rows] == sorted((r["v"], r["key"]) for r in rows)
    assert parts[0].groupBy("__part").count().agg(F.max("count")).first()[0] < n / 15


def by_hand(values, p):
    values = sorted(values)
    at = p * (len(values) - 1)
    i = int(at)
    return values[i] + (values[min(i + 1, len(values) - 1)] - values[i]) * (at - i)


@pytest.mark.parametrize("small, limit", [(10**18, 1 << 16), (-1, 1 << 16), (-1, 40)])
def test_quantiles_are_exact(spark, monkeypatch, small, limit):
    """Ties, hot values, single rows and nulls, against the sorted list: in one aggregate, in one round and in many."""
    import random

    monkeypatch.setattr(rank, "SMALL_BYTES", small)
    monkeypatch.setattr(rank, "LIMIT", limit)
    monkeypatch.setattr(rank, "scanned_bytes", lambda df: 0)
    rng = random.Random(3)
    groups = {"a": [rng.random() for _ in range(30_000)], "b": [7.0] * 20_000 + [rng.random() * 9 for _ in range(4000)], "bb": [rng.random() for _ in range(800)], "c": [3.0], "d": [1.0, 2.0], "e": [float(rng.randrange(5)) for _ in range(999)], "g": [math.inf, -math.inf, 1.0, 2.0, 3.0]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("a", None), ("f", None), (None, 1.0), (None, None)], "g string, v double").repartition(4)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r["g"]: (r["q"], r["n"]) for r in rank.quantiles(df, ["g"], "v", probs).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        for p, q in zip(probs, got[g][0]):
            want = by_hand(vs, p)
            assert math.isclose(q, want, abs_tol=1e-12) or math.isnan(want) or g == "g", (g, p)
        assert got[g][1] == len(vs)
    assert rank.quantiles(df, [], "v", [0.5]).first()["n"] == sum(map(len, groups.values())) + 1
    assert rank.quantiles(df.where("g = 'f'"), [], "v", [0.5]).count() == rank.quantiles(df.where("g = 'f'"), ["g"], "v", [0.5]).count() == 0
    near = rank.quantiles(df.where("g = 'a'"), ["g"], "v", [0.5], accuracy=100).first()["q"][0]
    assert abs(near - 0.5) < 0.05


def test_no_window_orders_more_than_the_limit(spark, monkeypatch):
    """A million distinct values, and as many rows of one value among them."""
    monkeypatch.setattr(rank, "LIMIT", 2000)
    monkeypatch.setattr(rank, "SMALL_BYTES", -1)
    held, real = [], rank._cells
    monkeypatch.setattr(rank, "_cells", lambda rows, keys: held.append(real(rows, keys).groupBy(*keys).count().agg(F.max("count")).first()[0]) or real(rows, keys))
    n = 1_000_000
    df = spark.range(2 * n).select(F.when(F.col("id") < n, F.col("id") * 7919 % n).otherwise(n // 3).cast("double").alias("v"))
    row = rank.quantiles(df, [], "v", [0.1, 0.5, 0.9]).first()
    assert row["n"] == 2 * n and held[-1] <= 2000
    assert all(math.isclose(a, b, rel_tol=1e-12) for a, b in zip(row["q"], (199999.9, n // 3, 799999.1)))


@pytest.mark.parametrize("small", [10**18, -1])
def test_quantiles_of_other_folds(spark, monkeypatch, small):
    import random

    monkeypatch.setattr(rank, "SMALL_BYTES", small)
    monkeypatch.setattr(rank, "LIMIT", 100)
    monkeypatch.setattr(rank, "scanned_bytes", lambda df: 0)
    rng = random.Random(4)
    rows = [(rng.choice([0, 0, 0, 1, 2, 3]), rng.choice([rng.random(), 0.5, rng.gauss(0, 3)])) for _ in range(8000)] + [(None, 9.0), (1, None)]
    df = spark.createDataFrame(rows, "fold int, v double")
    got = {r["fold"]: r for r in rank.quantiles_of_others(df, "fold", 5, "v", [0.25, 0.5, 0.9]).collect()}
    assert set(got) == set(range(5))
    for i, r in got.items():
        own = [v for f, v in rows if f is not None and f != i and v is not None]
        assert r["n"] == len(own) and all(math.isclose(q, by_hand(own, p), abs_tol=1e-12) for q, p in zip(r["q"], (0.25, 0.5, 0.9)))
    plan = rank.quantiles_of_others(df, "fold", 5, "v", [0.5])._jdf.queryExecution().optimizedPlan().toString()
    assert small < 0 or "Generate explode(array(named_struct(fold, 0" in plan or "Generate" not in plan.split("Aggregate")[-1]
    assert rank.quantiles_of_others(df.where("false"), "fold", 5, "v", [0.5]).count() == 0
    scaled = {(r["fold"], r["v"]): r["scaled"] for r in prep.fold_scale(df, "v", "fold", 5).collect()}
    import statistics

    for i in range(4):
        own = [v for f, v in rows if f is not None and f != i and v is not None]
        v = next(v for f, v in rows if f == i and v is not None)
        assert math.isclose(scaled[i, v], (v - statistics.fmean(own)) / statistics.stdev(own), rel_tol=1e-9)


@pytest.mark.parametrize("name", ["describe_static", "median_curve", "box_by_method", "trend_binned", "fold_knots", "fold_impute", "log_knots"])
def test_queries_in_rounds_equal_sql(spark, duck, monkeypatch, name):
    from conftest import SF, same_rows
    from fuzzcurve.plans import queries as q

    monkeypatch.setattr(rank, "SMALL_BYTES", -1)
    monkeypatch.setattr(rank, "LIMIT", 30)
    same_rows(q.QUERIES[name](spark, SF), duck.execute(q.ORACLES[name]).df())


def test_spearman_ranks_once_where_rows_agree(spark, monkeypatch):
    import random

    import pandas as pd

    rng = random.Random(6)
    draw = lambda gap: None if rng.random() < gap else rng.choice([rng.random(), float(rng.randrange(4))])
    tables_, real = [], relate.rank_table
    monkeypatch.setattr(relate, "rank_table", lambda df, by, value, out: tables_.append(df.select("k").distinct().count()) or real(df, by, value, out))
    for gap in (0.0, 0.3):
        rows = [tuple(draw(gap * (c % 3)) for c in range(5)) + (None,) for _ in range(300)] + [(1.0, None, None, None, None, None)] * bool(gap)
        names = list("abcdef")
        got = {(r["a"], r["b"]): (r["rho"], r["n"]) for r in relate.spearman_matrix(spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)), names).collect()}
        frame = pd.DataFrame(rows, columns=names, dtype=float)
        assert len(got) == 21
        for i, a in enumerate(names):
            for b in names[i:]:
                both = frame[[a, b]].dropna() if a != b else frame[[a]].dropna()
                rho = both[a].rank().corr(both[b].rank()) if len(both) else float("nan")
                assert got[a, b][1] == len(both)
                assert (got[a, b][0] is None) == (len(both) == 0) and (not len(both) or math.isclose(got[a, b][0], rho, abs_tol=1e-9))
    assert tables_[0] == 5 and tables_[1] > 5  # without nulls one ranking for each column


def test_describe_keeps_columns_without_values(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None)], "x double, y double")
    got = {r["col"]: r.asDict() for r in profile.describe(df, ["x", "y"]).collect()}
    assert got["x"]["q2"] == 2.0 and got["y"]["n"] == 0 and got["y"]["mean"] is None
    assert {r["n"] for r in profile.describe(df.where("false"), ["x", "y"]).collect()} == {0}


def test_level_tables(spark):
    """A hundred thousand levels: the dictionary is a table, the vectors are sparse."""
    n = 100_000
    df = spark.range(2 * n).select("id", F.format_string("l%07d", F.col("id") % n * 7919 % n).alias("c")).unionByName(spark.createDataFrame([(-1, None), (-2, "no level")], "id long, c string"))
    levels = tables.scratch(prep.level_table(df.where("id >= 0"), "c"))
    assert levels.count() == n and levels.where("level = 'l0000005'").first()["index"] == 5
    coded = prep.encode_levels(df, "c", levels)
    some = {r["id"]: r["encoded"] for r in coded.where("id in (-1, -2, 3, 100003)").collect()}
    at = 3 * 7919 % n
    assert some[-1] is None and some[-2].size == n and not some[-2].indices.size
    assert some[3] == some[100003] and list(some[3].indices) == [at] and coded.columns == ["id", "c", "encoded"]


def test_bucketed_tables_need_no_exchange(spark, long):
    spark.sql("DROP TABLE IF EXISTS kept_curves")
    tables.save_curves(long.select("curve_id", "event_id", "t", "r"), "kept_curves", 4)
    back = tables.saved_curves(spark, "kept_curves")
    got = curves.curve_summary(back, dealt=True)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    key = lambda r: (r["curve_id"], r["n_points"], r["duration"])
    assert sorted(map(key, got.collect())) == sorted(map(key, curves.curve_summary(long).collect()))
    spark.sql("DROP TABLE kept_curves")


def test_top_categories_without_labels(spark):
    df = spark.createDataFrame([(None, 300.7, 9.0, 2.25), (None, 300.7, 9.0, 2.25), (None, 18.2, 1.0, -0.5)], "drug string, mw double, tpsa double, logp double")
    key = ["mw", "tpsa", "logp"]
    want = [("MW300/LogP2.2", 2), ("MW18/LogP-0.5", 1)]
    assert [tuple(r) for r in profile.top_categories(df, "drug", key=key).collect()] == want
    assert [tuple(r) for r in profile.top_categories(df.drop("drug"), "drug", key=key).collect()] == want
    assert [tuple(r) for r in profile.top_categories(df.fillna("x"), "drug", key=key).collect()] == [("x", 3)]


def test_levels_and_sets(spark):
    df = spark.createDataFrame([(f"l{i:04}", float(i)) for i in range(1500)] + [(None, None)], "c string, x double")
    assert len(prep.fit_levels(df, "c")) == 1500
    assert fuzzy.labels_of(3) == ("Low", "Medium", "High") and fuzzy.labels_of(2) == ("Low", "High")
    knots = fuzzy.fit_knots(df, ["x"], "minmax", n_sets=4)
    assert knots == {"x": [0.0, 1499 / 3, 1499 * 2 / 3, 1499.0]}
    assert "x [Medium 2]" in fuzzy.fuzzify(df, knots).columns


def test_tables_in_and_out(spark, long, tmp_path):
    tables.write_result(long, str(tmp_path / "out"))
    back = tables.load_curves(spark, str(tmp_path / "out"))
    assert back.count() == long.count() and back.where(F.isnan("r")).count() == 0
    long.select("curve_id", "t", "r").coalesce(1).write.option("header", True).csv(str(tmp_path / "csv"))
    read = tables.load_curves(spark, str(tmp_path / "csv"), tables.CURVE_SCHEMA, "csv")
    assert read.schema == tables.CURVE_SCHEMA and read.where("r is not null").count() == long.where("r is not null and not isnan(r)").count()


def test_metadata_keeps_row_count(spark, long):
    meta = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (2, None, 0)], "curve_id long, drug string, o int")
    out, flag = tables.attach_metadata(long, meta, "curve_id", ["drug"], "o")
    assert out.count() == long.count() and flag.first()[0] is True
    assert out.where("curve_id = 1").first()["drug"] == "a"
    assert tables.attach_metadata(long, None, "curve_id", ["drug"])[1].first()[0] is False


def test_folds_are_disjoint_by_group(spark):
    df = spark.createDataFrame([(i, i % 7, "x") for i in range(100)] + [(100, None, "x")], "id long, g long, h string")
    rows = prep.group_folds(df, ["g", "h"], 3).collect()
    assert len(rows) == 101
    by = {}
    for r in rows:
        by.setdefault(r["g"], set()).add(r["fold"])
    assert by.pop(None) == {None} and all(len(f) == 1 for f in by.values())


def test_undersample_balances_training_rows_only(spark):
    df = spark.createDataFrame([(i, int(i % 10 == 0), i % 7 > 0) for i in range(1000)], "id long, y int, train boolean")
    out = prep.undersample(df, "y", "id", train="train")
    n = {(r["train"], r["y"]): r["count"] for r in out.groupBy("train", "y").count().collect()}
    least = df.where("train and y = 1").count()
    assert n.get((True, 0), 0) == n.get((True, 1), 0) == least
    assert sum(v for (t, _), v in n.items() if not t) == df.where("not train").count()


def test_undersample_keeps_rows_without_label_or_flag(spark):
    rows = [(1, 0, True), (2, 1, True), (3, 0, True), (4, None, True), (5, 1, None), (6, 0, False), (7, None, None)]
    df = spark.createDataFrame(rows, "id long, y int, train boolean")
    assert {r["id"] for r in prep.undersample(df, "y", "id", train="train").collect()} - {1, 3} == {2, 4, 5, 6, 7}
    assert prep.undersample(df, "y", "id", train="train").count() == 6


def test_folds_of_long_numbers(spark):
    """Groups that agree in their first twelve digits are dealt in the order of the whole number."""
    df = spark.createDataFrame([(10**14 + i,) for i in range(20)], "g long")
    assert {r["g"] - 10**14: r["fold"] for r in prep.group_folds(df, ["g"], 5).collect()} == {i: i % 5 for i in range(20)}


def test_metrics(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8), (None, 1.0)], "y int, score double")
    assert metrics.auroc(df).first()["auroc"] == 0.75
    perfect = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (4.0, 4.0)], "y double, p double")
    m = metrics.regression_metrics(perfect).first()
    assert m["rmse"] == 0 and m["r2"] == 1


def test_scalars(spark):
    row = spark.range(1).select(scalar.ellipsis(F.lit("x" * 28)).alias("a"), scalar.bracketed(F.lit("f [Low]")).alias("b"), scalar.key_label(F.lit(300.7), F.lit(2.25)).alias("c"), scalar.curve_label(F.lit(3), F.lit(None)).alias("d")).first()
    assert tuple(row) == ("x" * 26 + "…", "Low", "MW300/LogP2.2", "#3")


def test_fuzzify_stream(spark, tmp_path):
    """Memberships are a projection, so a streaming table gets them too."""
    spark.range(5).select(F.col("id").cast("double").alias("f")).write.parquet(str(tmp_path / "in"))
    stream = fuzzy.fuzzify(spark.readStream.schema("f double").parquet(str(tmp_path / "in")), {"f": [1, 2, 3]})
    job = stream.writeStream.format("memory").queryName("fuzzy").start()
    job.processAllAvailable()
    job.stop()
    assert spark.table("fuzzy").count() == 5
