"""The library's queries, each (spark, sf_dir) -> DataFrame, and the same in SQL.

Doubles are rounded to 6 places on both sides. SQL starts with the fixture
views it names (``sources.fixtures.SQL``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions import scalar
from ..operators import curves, fuzzy, metrics, models, prep, profile, relate
from ..sources import fixtures, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
STATICS = ["c_nationkey", "c_acctbal"]


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to ``places``; -0.0 as 0.0."""
    return df.withColumns({f.name: F.round(F.col(f"`{f.name}`"), places) + 0.0 for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)})


def query(sql: str | None = None, views: Sequence[str] = ()):
    """Register a query; ``sql`` may go on from WITH clauses of its own, after the views."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql is not None:
            head = ", ".join(fixtures.SQL[v] for v in views)
            body = sql.strip()
            if body.startswith("WITH "):
                body = f"WITH {head}, {body[5:]}" if head else body
            elif head:
                body = f"WITH {head} {body}"
            ORACLES[f.__name__] = body
        return f

    return add


SEGMENTS = """C AS (SELECT curve_id, t, avg(r) AS r FROM {v} WHERE t IS NOT NULL AND r IS NOT NULL GROUP BY curve_id, t),
S AS (SELECT *, lag(t) OVER w AS pt, lag(r) OVER w AS pr, lead(t) OVER w AS nt, lead(r) OVER w AS nr, min(t) OVER (PARTITION BY curve_id) AS tmin, max(t) OVER (PARTITION BY curve_id) AS tmax FROM C WINDOW w AS (PARTITION BY curve_id ORDER BY t))"""
AT = "max(CASE WHEN pt IS NULL AND t > {x} THEN r WHEN nt IS NULL AND t <= {x} THEN r WHEN t <= {x} AND nt > {x} THEN r + ({x} - t) * (nr - r) / (nt - t) END)"
AUC = "CASE WHEN max(tmax) > 0 THEN coalesce(sum((t - pt) / tmax * (r + pr) / 2), 0) END"
HALF = "arg_min(CASE WHEN pt IS NULL THEN t WHEN pr = r THEN pt ELSE pt + (0.5 - pr) * (t - pt) / (r - pr) END, t) FILTER (WHERE r >= 0.5)"
SUMMARY = SEGMENTS + f""",
Y AS (SELECT curve_id, count(*) AS n_points, max(t) AS duration, arg_max(r, t) AS r_final, max(r) AS r_max, {AUC} AS auc_norm, {AT.format(x=1)} AS rel_24h, {AT.format(x=2)} AS rel_48h, {AT.format(x=3)} AS rel_72h, {HALF} AS t_half FROM S GROUP BY curve_id)"""
SIX = "curve_id, n_points, round(duration, 6) AS duration, round(r_final, 6) AS r_final, round(r_max, 6) AS r_max, round(auc_norm, 6) AS auc_norm"


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.curve_summary(fixtures.cumulative(spark, sf_dir), dealt=True)  # its running sums are dealt by curve


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.load_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("curve_id"), *STATICS, "c_mktsegment")


def _with_statics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(spark, sf_dir).join(_customers(spark, sf_dir), "curve_id")


# curves


@query(f"WITH {SUMMARY.format(v='E')} SELECT {SIX} FROM Y", ["E"])
def curve_summary(spark, sf_dir):
    return _summary(spark, sf_dir).select("curve_id", "n_points", "duration", "r_final", "r_max", "auc_norm")


@query(f"WITH {SUMMARY.format(v='E')} SELECT curve_id, round(rel_24h, 6) AS rel_24h, round(rel_48h, 6) AS rel_48h, round(rel_72h, 6) AS rel_72h FROM Y", ["E"])
def early_values(spark, sf_dir):
    return _summary(spark, sf_dir).select("curve_id", "rel_24h", "rel_48h", "rel_72h")


@query(f"WITH {SUMMARY.format(v='E')} SELECT curve_id, round(t_half, 6) AS t_half FROM Y", ["E"])
def t_half(spark, sf_dir):
    return _summary(spark, sf_dir).select("curve_id", "t_half")


@query(f"WITH {SUMMARY.format(v='V')} SELECT {SIX}, round(rel_24h, 6) AS rel_24h, round(t_half, 6) AS t_half FROM Y", ["V"])
def noisy_summary(spark, sf_dir):
    return curves.curve_summary(fixtures.noisy(spark, sf_dir)).drop("rel_48h", "rel_72h")


@query(f"WITH {SUMMARY.format(v='O')}, F AS (SELECT curve_id, arg_min(c_nationkey, event_id) AS c_nationkey, round(arg_min(c_acctbal, event_id), 6) AS c_acctbal, arg_min(c_mktsegment, event_id) AS c_mktsegment FROM O GROUP BY curve_id) SELECT {SIX}, c_nationkey, c_acctbal, c_mktsegment FROM Y LEFT JOIN F USING (curve_id)", ["O"])
def summary_with_static(spark, sf_dir):
    o = fixtures.orders_long(spark, sf_dir)
    statics = profile.first_per_key(o.select("curve_id", "event_id", *STATICS, "c_mktsegment"), "curve_id", "event_id").drop("event_id")
    return curves.curve_summary(o, statics).select("curve_id", "n_points", "duration", "r_final", "r_max", "auc_norm", *STATICS, "c_mktsegment")


def _grid_sql(v: str, scale: str, cond: str) -> str:
    t, nt = scale.format(t="t"), scale.format(t="nt")
    return f"""WITH {SEGMENTS.format(v=v)}, N AS (SELECT curve_id, r, nr, pt, {t} AS x, {nt} AS nx FROM S WHERE {cond}),
K AS (SELECT *, unnest(range(CASE WHEN pt IS NULL THEN 0 ELSE CAST(ceil(x * 49) AS BIGINT) END, CASE WHEN nx IS NULL THEN 50 ELSE CAST(ceil(nx * 49) AS BIGINT) END)) AS k FROM N),
R AS (SELECT curve_id, CAST(k AS INTEGER) AS k, k / 49.0 AS gx, CASE WHEN nx IS NULL OR k / 49.0 <= x THEN r ELSE r + (k / 49.0 - x) * (nr - r) / (nx - x) END AS y FROM K)"""


MAXED, MINMAXED = ("{t} / tmax", "tmax > 0"), ("({t} - tmin) / (tmax - tmin)", "tmax > tmin")


@query(f"WITH {SUMMARY.format(v='V')} SELECT {SIX}, round(rel_24h, 6) AS rel_24h, round(t_half, 6) AS t_half FROM Y", ["V"])
def saved_summary(spark, sf_dir):
    """The summary of a table that was saved dealt and sorted by curve, and is read without an exchange."""
    path = tables.shared_path(spark, "saved_curves")
    table = path.rsplit("/", 1)[-1].replace("-", "_")
    tables.save_curves(fixtures.noisy(spark, sf_dir), table, int(spark.conf.get("spark.sql.shuffle.partitions")), path)
    return curves.curve_summary(tables.saved_curves(spark, table), dealt=True).drop("rel_48h", "rel_72h")


@query(_grid_sql("E", *MAXED) + " SELECT curve_id, k, round(gx, 6) AS gx, round(y, 6) AS y FROM R", ["E"])
def resample_grid(spark, sf_dir):
    return curves.resample(fixtures.cumulative(spark, sf_dir), dealt=True)


@query(_grid_sql("E", *MAXED) + " SELECT k, round(min(gx), 6) AS gx, round(quantile_cont(y, 0.5), 6) AS median, count(*) AS n FROM R GROUP BY k", ["E"])
def median_curve(spark, sf_dir):
    return curves.median_curve(fixtures.cumulative(spark, sf_dir), dealt=True)


@query(_grid_sql("O", *MINMAXED) + " SELECT curve_id, k, round(gx, 6) AS gx, round(y, 6) AS y FROM R", ["O"])
def minmax_resample(spark, sf_dir):
    return curves.resample(fixtures.orders_long(spark, sf_dir), norm="minmax")


@query(_grid_sql("E", *MAXED) + " SELECT curve_id, CAST(count(*) AS INTEGER) AS length, string_agg(CAST(CAST(round(y * 1000) AS BIGINT) AS VARCHAR), ',' ORDER BY k) AS ys FROM R GROUP BY curve_id", ["E"])
def target_arrays(spark, sf_dir):
    wide = curves.to_wide(curves.resample(fixtures.cumulative(spark, sf_dir), dealt=True))
    return wide.select("curve_id", F.size("ys").alias("length"), F.array_join(F.transform("ys", lambda y: F.round(y * 1000).cast("long").cast("string")), ",").alias("ys"))


@query("WITH D AS (SELECT curve_id, r - lag(r) OVER (PARTITION BY curve_id ORDER BY t, event_id) AS d FROM O), B AS (SELECT curve_id, coalesce(bool_or(d < -1e-9), false) AS dips FROM D GROUP BY curve_id) SELECT count(*) FILTER (WHERE dips) AS n_dip, count(*) FILTER (WHERE NOT dips) AS n_monotone FROM B", ["O"])
def dip_counts(spark, sf_dir):
    return curves.dip_counts(fixtures.orders_long(spark, sf_dir))


@query("SELECT count(*) FILTER (WHERE r <= 1) AS n_within, count(*) FILTER (WHERE r > 1) AS n_over, count(r) AS n FROM V", ["V"])
def over_limit(spark, sf_dir):
    return profile.split_over(fixtures.noisy(spark, sf_dir), "r")


@query(f"WITH {SUMMARY.format(v='V')} SELECT count(*) FILTER (WHERE r_max > 0.8) AS n_over, count(*) AS n FROM Y", ["V"])
def exceed_count(spark, sf_dir):
    return curves.curve_summary(fixtures.noisy(spark, sf_dir)).agg(F.count_if(F.col("r_max") > 0.8).alias("n_over"), F.count("*").alias("n"))


PICKS = SUMMARY + """, A AS (SELECT curve_id, auc_norm, row_number() OVER (ORDER BY auc_norm, curve_id) - 1 AS pos, count(*) OVER () AS n FROM Y WHERE auc_norm IS NOT NULL),
K AS (SELECT curve_id, auc_norm, pos, CASE WHEN pos < 2 THEN 'slow' WHEN pos >= n - 2 THEN 'fast' ELSE 'median' END AS kind FROM A WHERE pos IN (0, 1, n // 2 - 1, n // 2, n - 2, n - 1))"""


@query(f"WITH {PICKS.format(v='E')} SELECT curve_id, round(auc_norm, 6) AS value, pos, kind FROM K", ["E"])
def archetypes(spark, sf_dir):
    return curves.archetypes(_summary(spark, sf_dir))


@query(f"WITH {PICKS.format(v='E')}, M AS (SELECT E.*, max(t) OVER (PARTITION BY curve_id) AS m FROM E) SELECT M.curve_id, kind, round(CASE WHEN m > 0 THEN t / m ELSE t END, 6) AS x, round(r, 6) AS r, '#' || M.curve_id || coalesce(' · ' || c_mktsegment, '') AS label FROM M JOIN K USING (curve_id) LEFT JOIN customer ON c_custkey = M.curve_id", ["E"])
def archetype_curves(spark, sf_dir):
    e = fixtures.cumulative(spark, sf_dir)
    rows = curves.archetype_curves(e, curves.archetypes(_summary(spark, sf_dir)))
    return rows.join(_customers(spark, sf_dir), "curve_id", "left").select("curve_id", "kind", "x", "r", scalar.curve_label(F.col("curve_id"), F.col("c_mktsegment")).alias("label"))


@query("WITH N AS (SELECT curve_id, t, r, row_number() OVER (PARTITION BY curve_id ORDER BY t, event_id) AS k, count(*) OVER (PARTITION BY curve_id) AS n FROM E) SELECT curve_id, CAST(k AS INTEGER) AS k, round(t, 6) AS t, round(r, 6) AS r FROM N WHERE k = least(3, n)", ["E"])
def nth_point(spark, sf_dir):
    return curves.nth_point(fixtures.cumulative(spark, sf_dir))


@query("SELECT curve_id, event_id, round(CASE WHEN t = 0 THEN 0.05 ELSE t END, 6) AS t, round(r, 6) AS r FROM V", ["V"])
def floor_zero(spark, sf_dir):
    return fixtures.noisy(spark, sf_dir).withColumn("t", scalar.floor_zero(F.col("t")))


@query("SELECT curve_id, event_id, round(greatest(0.0, least(1.0, r)), 6) AS r FROM V", ["V"])
def clip_release(spark, sf_dir):
    return fixtures.noisy(spark, sf_dir).select("curve_id", "event_id", scalar.clip(F.col("r")).alias("r"))


@query("SELECT curve_id, event_id, round(t, 6) AS t, round(r, 6) AS r FROM (SELECT l_orderkey AS curve_id, l_linenumber AS event_id, CAST(l_quantity AS DOUBLE) AS t, CAST(l_discount AS DOUBLE) AS r FROM lineitem)")
def load_curves(spark, sf_dir):
    names = {"curve_id": "l_orderkey", "event_id": "l_linenumber", "t": "l_quantity", "r": "l_discount"}
    rows = tables.load_curves(spark, f"{sf_dir}/lineitem.parquet")
    return rows.select(*[F.col(old).cast("double" if new in ("t", "r") else rows.schema[old].dataType).alias(new) for new, old in names.items()])


# profiles


@query("SELECT count(*) AS n_rows, CAST(7 AS BIGINT) AS n_cols, count(DISTINCT curve_id) AS n_keys FROM O", ["O"])
def shape(spark, sf_dir):
    return profile.shape(fixtures.orders_long(spark, sf_dir), "curve_id")


@query("SELECT count(*) AS n, count(c_mktsegment) AS n_labelled, bool_or(c_mktsegment IS NOT NULL) AS has_labels, false AS has_labels_without FROM orders LEFT JOIN (SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 3 > 0) ON o_custkey = c_custkey")
def attach_metadata(spark, sf_dir):
    o = tables.load_table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "key")
    meta = tables.load_table(spark, sf_dir, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("key"), "c_mktsegment")
    joined, flag = tables.attach_metadata(o, meta, "key", ["c_mktsegment"])
    _, without = tables.attach_metadata(o, None, "key", ["c_mktsegment"])
    out = joined.agg(F.count("*").alias("n"), F.count("c_mktsegment").alias("n_labelled"))
    return out.join(F.broadcast(flag)).join(F.broadcast(without.withColumnRenamed("has_labels", "has_labels_without")))


@query("SELECT 'p_size' AS col, CAST(min(p_size) AS DOUBLE) AS lo, CAST(max(p_size) AS DOUBLE) AS hi FROM P UNION ALL SELECT 'p_retailprice', min(p_retailprice), max(p_retailprice) FROM P", ["P"])
def min_max(spark, sf_dir):
    return profile.ranges(fixtures.parts(spark, sf_dir), ["p_size", "p_retailprice"])


@query("SELECT 'c_acctbal' AS col, bool_or(c_acctbal IS NOT NULL) AS any_known, bool_and(c_acctbal > 0) AS all_positive FROM O UNION ALL SELECT 'r', bool_or(r IS NOT NULL), bool_and(r > 0) FROM O", ["O"])
def column_predicates(spark, sf_dir):
    return profile.predicates(fixtures.orders_long(spark, sf_dir), ["c_acctbal", "r"])


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN o_totalprice END AS price, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 250000 AND c_acctbal > 0")
def complete_rows(spark, sf_dir):
    o, c = tables.load_table(spark, sf_dir, "orders"), tables.load_table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey")
    rows = o.select("o_orderkey", "o_custkey", F.when(F.col("o_totalprice") > 250000, F.col("o_totalprice")).alias("price")).join(c.select("o_custkey", "c_name", F.when(F.col("c_acctbal") > 0, 1).alias("ok")), "o_custkey", "left")
    return rows.na.drop("any", subset=["price", "ok"]).select("o_orderkey", "price", "c_name")


_DESCRIBE = "SELECT '{c}' AS col, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(CAST(min({c}) AS DOUBLE), 6) AS lo, round(quantile_cont({c}, 0.25), 6) AS q1, round(quantile_cont({c}, 0.5), 6) AS q2, round(quantile_cont({c}, 0.75), 6) AS q3, round(CAST(max({c}) AS DOUBLE), 6) AS hi FROM P"


@query(" UNION ALL ".join(_DESCRIBE.format(c=c) for c in ("p_size", "p_retailprice")), ["P"])
def describe_static(spark, sf_dir):
    return profile.describe(fixtures.parts(spark, sf_dir), ["p_size", "p_retailprice"])


@query("SELECT 'p_size' AS col, round(quantile_cont(p_size, 0.5), 6) AS median FROM P UNION ALL SELECT 'p_retailprice', round(quantile_cont(p_retailprice, 0.5), 6) FROM P", ["P"])
def median_static(spark, sf_dir):
    return profile.medians(fixtures.parts(spark, sf_dir), ["p_size", "p_retailprice"])


def _hist_sql(source: str, col: str, edges: str, bins: int) -> str:
    return f"""WITH X AS (SELECT min({col}) AS lo, max({col}) AS hi FROM {source}), B AS (SELECT CAST(i AS INTEGER) AS bin, CASE WHEN i = 0 THEN lo ELSE {edges.format(i='i')} END AS a, CASE WHEN i = {bins - 1} THEN hi ELSE {edges.format(i='(i + 1)')} END AS z FROM X, (SELECT unnest(range({bins})) AS i))
SELECT bin, round(a, 6) AS lo, round(z, 6) AS hi, count({col}) AS n FROM B LEFT JOIN {source} ON {col} >= a AND ({col} < z OR bin = {bins - 1} AND {col} <= z) GROUP BY bin, a, z"""


@query(_hist_sql("P", "p_retailprice", "lo + (hi - lo) * {i} / 30", 30), ["P"])
def hist_linear(spark, sf_dir):
    return profile.histogram(fixtures.parts(spark, sf_dir), "p_retailprice", 30)


@query(f"WITH {SUMMARY.format(v='E')} SELECT n_points AS value, count(*) AS n FROM Y WHERE n_points >= 4 GROUP BY 1", ["E"])
def hist_int(spark, sf_dir):
    return profile.histogram_int(_summary(spark, sf_dir), "n_points")


def _log_sql(source: str, col: str) -> str:
    """Log edges where all values are positive, else linear ones."""
    edge = "CASE WHEN {i} = 0 THEN lo WHEN {i} = bins THEN hi WHEN lo > 0 THEN pow(10, log10(lo) + {i} * ((log10(hi) - log10(lo)) / bins)) ELSE lo + (hi - lo) * {i} / bins END"
    return f"""WITH X AS (SELECT CAST(min({col}) AS DOUBLE) AS lo, CAST(max({col}) AS DOUBLE) AS hi, CASE WHEN min({col}) > 0 THEN 21 ELSE 22 END AS bins FROM {source}), B AS (SELECT CAST(i AS INTEGER) AS bin, bins, {edge.format(i='i')} AS a, {edge.format(i='(i + 1)')} AS z FROM (SELECT *, unnest(range(bins)) AS i FROM X))
SELECT bin, round(a, 6) AS lo, round(z, 6) AS hi, count({col}) AS n FROM B LEFT JOIN {source} ON {col} >= a AND ({col} < z OR bin = bins - 1 AND {col} <= z) GROUP BY bin, a, z"""


@query(_log_sql("V", "r"), ["V"])
def hist_log(spark, sf_dir):
    return profile.histogram_log(fixtures.noisy(spark, sf_dir), "r")


@query(_log_sql("P", "p_retailprice"), ["P"])
def hist_log_positive(spark, sf_dir):
    return profile.histogram_log(fixtures.parts(spark, sf_dir), "p_retailprice")


@query(_log_sql("customer", "c_acctbal"))
def hist_log_fallback(spark, sf_dir):
    return profile.histogram_log(tables.load_table(spark, sf_dir, "customer"), "c_acctbal")


@query("SELECT p_brand, count(*) AS n FROM P WHERE p_brand IS NOT NULL GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 15", ["P"])
def top_categories(spark, sf_dir):
    return profile.top_categories(fixtures.parts(spark, sf_dir), "p_brand")


@query("SELECT 'MW' || CAST(trunc(p_retailprice) AS INTEGER) || '/LogP' || CAST(p_size AS INTEGER) || '.0' AS label, count(*) AS n FROM P GROUP BY p_retailprice, p_type, p_size ORDER BY n DESC, p_retailprice, p_type, p_size LIMIT 15", ["P"])
def top_keys(spark, sf_dir):
    return profile.top_categories(fixtures.parts(spark, sf_dir), None, key=["p_retailprice", "p_type", "p_size"])


@query("SELECT p_brand, p_type, p_size, count(*) AS n FROM P WHERE p_brand IS NOT NULL AND p_type IS NOT NULL AND p_size IS NOT NULL GROUP BY ALL", ["P"])
def drug_space(spark, sf_dir):
    return profile.group_sizes(fixtures.parts(spark, sf_dir), ["p_brand", "p_type", "p_size"])


@query("SELECT count(*) AS n_distinct FROM (SELECT DISTINCT p_brand, p_type, p_size FROM P)", ["P"])
def distinct_fingerprint(spark, sf_dir):
    return profile.distinct_composite(fixtures.parts(spark, sf_dir), ["p_brand", "p_type", "p_size"])


@query("SELECT p_type, count(*) AS n FROM P WHERE p_type IS NOT NULL GROUP BY 1", ["P"])
def value_counts(spark, sf_dir):
    return profile.value_counts(fixtures.parts(spark, sf_dir), "p_type")


@query("SELECT id, p_brand, round(p_retailprice, 3) AS price FROM P ORDER BY id LIMIT 8", ["P"])
def head_rounded(spark, sf_dir):
    return fixtures.parts(spark, sf_dir).orderBy("id").limit(8).select("id", "p_brand", F.round("p_retailprice", 3).alias("price"))


@query("""SELECT id, replace(replace(p_brand, 'Brand', 'B'), '#', ' ') AS short, CASE WHEN length(p_brand || ' ' || p_type || ' of size ' || CAST(p_size AS INTEGER)) > 27 THEN substr(p_brand || ' ' || p_type || ' of size ' || CAST(p_size AS INTEGER), 1, 26) || '…' ELSE p_brand || ' ' || p_type || ' of size ' || CAST(p_size AS INTEGER) END AS cut,
'MW' || CAST(trunc(p_retailprice) AS INTEGER) || '/LogP' || CAST(p_size AS INTEGER) || '.0' AS label, '#' || id || coalesce(' · ' || p_type, '') AS name FROM P""", ["P"])
def label_text(spark, sf_dir):
    long = F.concat_ws(" ", "p_brand", "p_type", F.lit("of size"), F.col("p_size").cast("int").cast("string"))
    return fixtures.parts(spark, sf_dir).select("id", scalar.replace_all(F.col("p_brand"), [("Brand", "B"), ("#", " ")]).alias("short"), scalar.ellipsis(long).alias("cut"), scalar.key_label(F.col("p_retailprice"), F.col("p_size")).alias("label"), scalar.curve_label(F.col("id"), F.col("p_type")).alias("name"))


_BOX = """WITH Q AS (SELECT {k}, quantile_cont({v}, 0.25) AS q1, quantile_cont({v}, 0.5) AS med, quantile_cont({v}, 0.75) AS q3, count(*) AS n FROM O WHERE {k} IS NOT NULL AND {v} IS NOT NULL GROUP BY {k})
SELECT Q.{k}, round(q1, 6) AS q1, round(med, 6) AS med, round(q3, 6) AS q3, round(min({v}), 6) AS whisk_lo, round(max({v}), 6) AS whisk_hi, n FROM Q JOIN O ON O.{k} = Q.{k} AND {v} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY Q.{k}, q1, med, q3, n"""


@query(_BOX.format(k="c_nationkey", v="r"), ["O"])
def box_by_ratio(spark, sf_dir):
    return profile.box_stats(fixtures.orders_long(spark, sf_dir), "c_nationkey", "r").orderBy("c_nationkey")


@query(_BOX.format(k="c_mktsegment", v="r"), ["O"])
def box_by_method(spark, sf_dir):
    return profile.box_stats(fixtures.orders_long(spark, sf_dir), "c_mktsegment", "r").orderBy(F.desc("n"), "c_mktsegment")


# relations

CORRELATED = ["c_nationkey", "c_acctbal", "n_points", "auc_norm", "rel_24h", "rel_72h", "t_half"]


def _spearman_sql() -> str:
    rows = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, CAST({a} AS DOUBLE) AS va, CAST({b} AS DOUBLE) AS vb FROM Z" for i, a in enumerate(CORRELATED) for b in CORRELATED[i:])
    rank = lambda v: f"rank() OVER (PARTITION BY a, b ORDER BY {v}) + (count(*) OVER (PARTITION BY a, b, {v}) - 1) / 2.0"
    return f"WITH {SUMMARY.format(v='E')}, Z AS (SELECT * FROM Y JOIN customer ON c_custkey = curve_id), L AS (SELECT * FROM ({rows}) WHERE va IS NOT NULL AND vb IS NOT NULL), R AS (SELECT a, b, {rank('va')} AS ra, {rank('vb')} AS rb FROM L) SELECT a, b, round(corr(ra, rb), 6) AS rho, count(*) AS n FROM R GROUP BY a, b"


@query(_spearman_sql(), ["E"])
def spearman(spark, sf_dir):
    return relate.spearman_matrix(_with_statics(spark, sf_dir), CORRELATED)


DRIVERS = ["c_nationkey", "c_acctbal", "n_points"]
POINTS = f"WITH {SUMMARY.format(v='E')}, Z AS (SELECT * FROM Y JOIN customer ON c_custkey = curve_id), D AS (SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{d}' AS driver, CAST({d} AS DOUBLE) AS x, auc_norm AS y, CAST(c_acctbal AS DOUBLE) AS third FROM Z" for d in DRIVERS) + ") WHERE x IS NOT NULL AND y IS NOT NULL AND third IS NOT NULL)"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relate.driver_points(_with_statics(spark, sf_dir), DRIVERS, "auc_norm", "c_acctbal")


@query(POINTS + " SELECT driver, round(x, 6) AS x, round(y, 6) AS y, round(third, 6) AS third FROM D", ["E"])
def driver_points(spark, sf_dir):
    return _points(spark, sf_dir)


@query(POINTS + """, B AS (SELECT driver AS d, quantile_cont(x, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]) AS e FROM D GROUP BY driver), G AS (SELECT d, CAST(i - 1 AS INTEGER) AS bin, e[i] AS lo, e[i + 1] AS hi FROM (SELECT d, e, unnest(range(1, 11)) AS i FROM B))
SELECT driver, bin, round(quantile_cont(x, 0.5), 6) AS cx, round(quantile_cont(y, 0.5), 6) AS cy, count(*) AS n FROM D JOIN G ON driver = d AND x BETWEEN lo AND hi GROUP BY driver, bin HAVING count(*) >= 3""", ["E"])
def trend_binned(spark, sf_dir):
    return relate.binned_median_trend(_points(spark, sf_dir))


# fuzzy features

FEATURES = ["p_size", "p_retailprice"]
K = {f: f"K_{f} AS (SELECT quantile_cont({f}, 0.25) AS k0, quantile_cont({f}, 0.5) AS k1, quantile_cont({f}, 0.75) AS k2 FROM P)" for f in FEATURES}
TRI = ["CASE WHEN {x} < k0 THEN 1.0 WHEN {x} < k1 THEN 1 - ({x} - k0) / (k1 - k0) WHEN {x} IS NOT NULL THEN 0.0 END", "CASE WHEN {x} < k0 THEN 0.0 WHEN {x} < k1 THEN ({x} - k0) / (k1 - k0) WHEN {x} < k2 THEN 1 - ({x} - k1) / (k2 - k1) WHEN {x} IS NOT NULL THEN 0.0 END", "CASE WHEN {x} < k1 THEN 0.0 WHEN {x} < k2 THEN ({x} - k1) / (k2 - k1) WHEN {x} IS NOT NULL THEN 1.0 END"]
TRIS = lambda x: ", ".join(f"{e.format(x=x)} AS {n}" for e, n in zip(TRI, ("m_low", "m_medium", "m_high")))
FUZZY = f"WITH {K['p_size']}, {K['p_retailprice']}, M AS (SELECT P.*, k2, {TRIS('p_size')} FROM P, K_p_size), D AS (SELECT *, CASE WHEN m_low >= greatest(m_medium, m_high) THEN 'Low' WHEN m_medium >= m_high THEN 'Medium' ELSE 'High' END AS dominant FROM M)"


def _fuzzy(spark: SparkSession, sf_dir: str, features: Sequence[str] = FEATURES):
    p = fixtures.parts(spark, sf_dir)
    knots = fuzzy.fit_knots(p, features)
    return fuzzy.fuzzify(p, knots), knots


def _knot_rows(f: str, source: str, expr: str) -> str:
    return " UNION ALL ".join(f"SELECT '{f}' AS feature, '{label}' AS label, round(quantile_cont({expr}, {q}), 6) AS knot FROM {source}" for label, q in zip(fuzzy.LABELS, (0.25, 0.5, 0.75)))


@query(" UNION ALL ".join(_knot_rows(f, "P", f) for f in FEATURES), ["P"])
def knots(spark, sf_dir):
    return fuzzy.knot_report(spark, fuzzy.fit_knots(fixtures.parts(spark, sf_dir), FEATURES))


@query(f"{FUZZY} SELECT id, p_size, round(m_low, 6) AS m_low, round(m_medium, 6) AS m_medium, round(m_high, 6) AS m_high FROM D", ["P"])
def memberships(spark, sf_dir):
    f, _ = _fuzzy(spark, sf_dir)
    return f.select("id", "p_size", *[F.col(f"`{fuzzy.column('p_size', label)}`").alias(f"m_{label.lower()}") for label in fuzzy.LABELS])


@query(f"WITH {K['p_retailprice']}, G AS (SELECT i AS k, lo + i * (hi - lo) / 399 AS x FROM (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM P), (SELECT unnest(range(400)) AS i)) SELECT k, round(x, 6) AS x, " + ", ".join(f"round({e.format(x='x')}, 6) AS {n}" for e, n in zip(TRI, ("low", "medium", "high"))) + " FROM G, K_p_retailprice", ["P"])
def membership_curve(spark, sf_dir):
    p = fixtures.parts(spark, sf_dir)
    lo, hi = p.agg(F.min("p_retailprice"), F.max("p_retailprice")).first()
    return fuzzy.membership_curve(spark, lo, hi, fuzzy.fit_knots(p, ["p_retailprice"])["p_retailprice"])


@query(f"WITH {K['p_size']}, W(x) AS (VALUES (5.0::DOUBLE), (12), (25), (34), (46), (120)) SELECT round(x, 6) AS x, " + ", ".join(f"round({e.format(x='x')}, 6) AS {n}" for e, n in zip(TRI, ("low", "medium", "high"))) + " FROM W, K_p_size", ["P"])
def worked_example(spark, sf_dir):
    k = fuzzy.fit_knots(fixtures.parts(spark, sf_dir), ["p_size"])["p_size"]
    return fuzzy.memberships(tables.literal_rows(spark, [5, 12, 25, 34, 46, 120]), k)


@query(f"{FUZZY} SELECT id, 'p_size [Low]' AS name, 'Low' AS label, round(m_low, 6) AS m FROM D UNION ALL SELECT id, 'p_size [Medium]', 'Medium', round(m_medium, 6) FROM D UNION ALL SELECT id, 'p_size [High]', 'High', round(m_high, 6) FROM D", ["P"])
def membership_rows(spark, sf_dir):
    """The label of each membership column is the text in brackets of its name."""
    names = [fuzzy.column("p_size", label) for label in fuzzy.LABELS]
    long = profile.tall(_fuzzy(spark, sf_dir)[0], names, ["id"])
    return long.select("id", F.col("col").alias("name"), scalar.bracketed(F.col("col")).alias("label"), F.col("value").alias("m"))


@query("WITH Q AS (SELECT quantile_cont(p_retailprice, [0.2, 0.4, 0.6, 0.8]) AS k FROM P) SELECT 'p_retailprice' AS feature, l AS label, round(k[i], 6) AS knot FROM Q, (VALUES (1, 'Low'), (2, 'Medium 1'), (3, 'Medium 2'), (4, 'High')) AS v(i, l)", ["P"])
def four_knots(spark, sf_dir):
    return fuzzy.knot_report(spark, fuzzy.fit_knots(fixtures.parts(spark, sf_dir), ["p_retailprice"], n_sets=4))


@query(f"{FUZZY}, L(label) AS (VALUES ('Low'), ('Medium'), ('High')) SELECT label, count(dominant) AS n FROM L LEFT JOIN D ON dominant = label GROUP BY label", ["P"])
def dominant_counts(spark, sf_dir):
    return fuzzy.dominant_counts(_fuzzy(spark, sf_dir)[0], "p_size")


@query(f"{FUZZY}, N AS (SELECT {TRIS('p_retailprice')} FROM P, K_p_retailprice) SELECT 'p_size' AS feature, round(min(m_low + m_medium + m_high), 6) AS lo, round(max(m_low + m_medium + m_high), 6) AS hi FROM M UNION ALL SELECT 'p_retailprice', round(min(m_low + m_medium + m_high), 6), round(max(m_low + m_medium + m_high), 6) FROM N", ["P"])
def unity_check(spark, sf_dir):
    return fuzzy.check_partition_of_unity(_fuzzy(spark, sf_dir)[0], FEATURES)


@query(f"{FUZZY} SELECT count(*) FILTER (WHERE m_high >= 0.999) AS n_saturated, round(max(k2), 6) AS top_knot, max(p_size) AS hi FROM M", ["P"])
def saturation(spark, sf_dir):
    f, k = _fuzzy(spark, sf_dir)
    return fuzzy.saturation(f, "p_size", k["p_size"])


@query(f"{FUZZY}, N AS (SELECT id, p_size, p_retailprice, {TRIS('p_retailprice')} FROM P, K_p_retailprice), H AS (SELECT N.id, [N.p_size, N.p_retailprice, D.m_low, D.m_medium, D.m_high, N.m_low, N.m_medium, N.m_high] AS h FROM N JOIN D USING (id)), R AS (SELECT id, 'crisp' AS kind, h[1:2] AS v FROM H UNION ALL SELECT id, 'fuzzy', h[3:8] FROM H UNION ALL SELECT id, 'hybrid', h FROM H) SELECT id, kind, CAST(i - 1 AS INTEGER) AS at, round(v[i], 6) AS value FROM (SELECT id, kind, v, unnest(range(1, len(v) + 1)) AS i FROM R)", ["P"])
def representations(spark, sf_dir):
    """The entries of each row's crisp, fuzzy and hybrid vector."""
    f, out = _fuzzy(spark, sf_dir)[0], None
    for kind in ("crisp", "fuzzy", "hybrid"):
        rows = fuzzy.representation(f, FEATURES, kind).select("id", F.lit(kind).alias("kind"), F.posexplode(vector_to_array("features")).alias("at", "value"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(_knot_rows("r", "V", "ln(1 + r)"), ["V"])
def log_knots(spark, sf_dir):
    return fuzzy.knot_report(spark, fuzzy.fit_knots(fixtures.noisy(spark, sf_dir), ["r"], transform="log1p"))


@query(f"{FUZZY} SELECT p_size AS x, p_retailprice AS y, dominant FROM D WHERE dominant = 'High'", ["P"])
def joint_view(spark, sf_dir):
    return fuzzy.joint_view(_fuzzy(spark, sf_dir)[0], *FEATURES).where(F.col("dominant") == "High")


@query("WITH Q AS (SELECT quantile_cont(quality, 0.25) AS k0, quantile_cont(quality, 0.5) AS k1, quantile_cont(quality, 0.75) AS k2 FROM labels) SELECT doc_id, quality, " + ", ".join(f"round({e}, 6) AS {n}" for e, n in zip(("CASE WHEN quality < k0 THEN 1.0 WHEN quality < k1 THEN 1 - (quality - k0) / (k1 - k0) WHEN quality IS NOT NULL THEN 0.0 END", TRI[1].format(x="quality"), TRI[2].format(x="quality")), ("m_low", "m_medium", "m_high"))) + " FROM labels, Q")
def equal_knots(spark, sf_dir):
    rows = tables.load_table(spark, sf_dir, "labels").select("doc_id", "quality")
    f = fuzzy.fuzzify(rows, fuzzy.fit_knots(rows, ["quality"]))
    return f.select("doc_id", "quality", *[F.col(f"`{fuzzy.column('quality', label)}`").alias(f"m_{label.lower()}") for label in fuzzy.LABELS])


@query("WITH X AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM P) SELECT id, round(CASE WHEN p_retailprice < lo + (hi - lo) * 0.4 THEN (p_retailprice - lo) / ((hi - lo) * 0.4) WHEN p_retailprice <= lo + (hi - lo) * 0.6 THEN 1.0 ELSE (hi - p_retailprice) / (hi - (lo + (hi - lo) * 0.6)) END, 6) AS m FROM P, X", ["P"])
def trapezoid_sets(spark, sf_dir):
    p = fixtures.parts(spark, sf_dir)
    lo, hi = p.agg(F.min("p_retailprice"), F.max("p_retailprice")).first()
    return p.select("id", scalar.trapezoidal(F.col("p_retailprice"), lo, lo + (hi - lo) * 0.4, lo + (hi - lo) * 0.6, hi).alias("m"))


@query("WITH X AS (SELECT quantile_cont(p_retailprice, 0.5) AS c, stddev_samp(p_retailprice) AS s FROM P) SELECT id, round(exp(-0.5 * pow((p_retailprice - c) / s, 2)), 6) AS m FROM P, X", ["P"])
def gaussian_sets(spark, sf_dir):
    p = fixtures.parts(spark, sf_dir)
    c, s = profile.describe(p, ["p_retailprice"]).select("q2", "std").first()
    return p.select("id", scalar.gaussian(F.col("p_retailprice"), c, s).alias("m"))


@query("SELECT 'p_retailprice' AS feature, 'Low' AS label, min(p_retailprice) AS knot FROM P UNION ALL SELECT 'p_retailprice', 'Medium', round((min(p_retailprice) + max(p_retailprice)) / 2, 6) FROM P UNION ALL SELECT 'p_retailprice', 'High', max(p_retailprice) FROM P", ["P"])
def minmax_knots(spark, sf_dir):
    return fuzzy.knot_report(spark, fuzzy.fit_knots(fixtures.parts(spark, sf_dir), ["p_retailprice"], "minmax"))


@query()
def kmeans_knots(spark, sf_dir):
    return fuzzy.knot_report(spark, fuzzy.fit_knots(fixtures.parts(spark, sf_dir), ["p_retailprice"], "kmeans"))


# preparation and metrics

FOLDS = 5
GROUPED = "N AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment), G AS (SELECT c_nationkey, c_mktsegment, (row_number() OVER (ORDER BY n DESC, lpad(CAST(c_nationkey AS VARCHAR), 12, '0') || chr(0) || c_mktsegment) - 1) % 5 AS fold FROM N), J AS (SELECT c_custkey, c_acctbal, c_mktsegment, CAST(fold AS INTEGER) AS fold FROM customer JOIN G USING (c_nationkey, c_mktsegment))"


def _folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.group_folds(tables.load_table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"], FOLDS)


@query(f"WITH {SUMMARY.format(v='E')} SELECT curve_id, CASE WHEN auc_norm > 0.5 THEN 1 WHEN auc_norm IS NOT NULL THEN 0 END AS auc_class FROM Y", ["E"])
def auc_class(spark, sf_dir):
    return prep.auc_class(_summary(spark, sf_dir)).select("curve_id", "auc_class")


@query(f"WITH {GROUPED} SELECT c_custkey, fold FROM J")
def group_folds(spark, sf_dir):
    return _folds(spark, sf_dir).select("c_custkey", "fold")


@query("WITH H AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id || '|0'), doc_id) AS k FROM labels WHERE quality IS NOT NULL) SELECT doc_id, quality FROM H WHERE k <= (SELECT min(c) FROM (SELECT count(*) AS c FROM labels WHERE quality IS NOT NULL GROUP BY quality))")
def undersample(spark, sf_dir):
    return prep.undersample(tables.load_table(spark, sf_dir, "labels").select("doc_id", "quality"), "quality", "doc_id")


@query(f"WITH {GROUPED} SELECT CAST(f AS INTEGER) AS fold, round(quantile_cont(c_acctbal, 0.25), 6) AS k0, round(quantile_cont(c_acctbal, 0.5), 6) AS k1, round(quantile_cont(c_acctbal, 0.75), 6) AS k2 FROM J JOIN (SELECT unnest(range(5)) AS f) ON f <> fold GROUP BY f")
def fold_knots(spark, sf_dir):
    return fuzzy.fold_knots(_folds(spark, sf_dir), "c_acctbal", "fold", FOLDS)


@query(f"WITH {GROUPED}, M AS (SELECT f, avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s FROM J JOIN (SELECT unnest(range(5)) AS f) ON f <> fold GROUP BY f) SELECT c_custkey, fold, round((c_acctbal - m) / s, 6) AS scaled FROM J JOIN M ON f = fold")
def fold_scale(spark, sf_dir):
    return prep.fold_scale(_folds(spark, sf_dir), "c_acctbal", "fold", FOLDS).select("c_custkey", "fold", "scaled")


@query(f"WITH {GROUPED}, V AS (SELECT c_custkey, fold, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS v FROM J), M AS (SELECT f, quantile_cont(v, 0.5) AS m FROM V JOIN (SELECT unnest(range(5)) AS f) ON f <> fold GROUP BY f) SELECT c_custkey, fold, round(coalesce(v, m), 6) AS imputed FROM V JOIN M ON f = fold")
def fold_impute(spark, sf_dir):
    rows = _folds(spark, sf_dir).withColumn("v", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")))
    return prep.fold_impute(rows, "v", "fold", FOLDS).select("c_custkey", "fold", "imputed")


@query(f"WITH {GROUPED}, L AS (SELECT DISTINCT c_mktsegment AS level FROM J WHERE fold <> 0 AND c_mktsegment IS NOT NULL) SELECT c_custkey, level, CAST(c_mktsegment = level AS INTEGER) AS is_level FROM J, L")
def one_hot(spark, sf_dir):
    """Levels come from the training rows alone; shown as one row for each customer and level."""
    rows = _folds(spark, sf_dir)
    levels = prep.fit_levels(rows.where("fold <> 0"), "c_mktsegment")
    coded = prep.one_hot(rows, "c_mktsegment", levels)
    long = F.array(*[F.struct(F.lit(v).alias("level"), F.col(f"`c_mktsegment={v}`").alias("is_level")) for v in levels])
    return coded.select("c_custkey", F.explode(long).alias("x")).select("c_custkey", "x.*")


@query(f"WITH {GROUPED}, L AS (SELECT DISTINCT c_mktsegment AS level FROM J WHERE fold <> 0 AND c_mktsegment IS NOT NULL), D AS (SELECT level, row_number() OVER (ORDER BY level) - 1 AS index FROM L) SELECT c_custkey, index, level, CAST(c_mktsegment = level AS INTEGER) AS is_level FROM J, D")
def nominal_vectors(spark, sf_dir):
    """The same indicators from sparse vectors and a dictionary that stays a table."""
    rows = tables.scratch(_folds(spark, sf_dir))
    levels = tables.scratch(prep.level_table(rows.where("fold <> 0"), "c_mktsegment"))
    coded = prep.encode_levels(rows, "c_mktsegment", levels)
    long = coded.select("c_custkey", F.posexplode(vector_to_array("encoded")).alias("at", "v"))
    return long.join(levels, F.col("at") == F.col("index")).select("c_custkey", "index", "level", F.col("v").cast("int").alias("is_level"))


PREDICTED = f"WITH {SUMMARY.format(v='E')}, Z AS (SELECT curve_id, auc_norm AS y, avg(auc_norm) OVER (PARTITION BY c_mktsegment) AS p, rel_72h, CASE WHEN auc_norm > 0.5 THEN 1 ELSE 0 END AS c FROM Y JOIN customer ON c_custkey = curve_id WHERE auc_norm IS NOT NULL)"
REGRESSION = "count(*) AS n, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(avg(abs(y - p)), 6) AS mae, round(corr(y, p), 6) AS pearson, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2, round(1 - (sum((y - p) * (y - p)) / (var_pop(y) * count(*))) * (count(*) - 1) / (count(*) - 2), 6) AS adj_r2"


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prediction with an oracle: the mean of each curve's segment."""
    rows = prep.auc_class(_with_statics(spark, sf_dir)).where("auc_norm is not null")
    mean = rows.groupBy("c_mktsegment").agg(F.avg("auc_norm").alias("p"))
    return rows.join(mean, "c_mktsegment").withColumnRenamed("auc_norm", "y")


@query(f"{PREDICTED} SELECT {REGRESSION} FROM Z", ["E"])
def reg_metrics(spark, sf_dir):
    return metrics.regression_metrics(_predicted(spark, sf_dir))


@query(f"{PREDICTED}, X AS (SELECT c AS y, CASE WHEN rel_72h > 0.05 THEN 1 ELSE 0 END AS p FROM Z), L AS (SELECT DISTINCT y AS k FROM X UNION SELECT DISTINCT p FROM X) SELECT k AS class, count(*) FILTER (WHERE y = k) AS support, round(count(*) FILTER (WHERE y = k AND p = k) / nullif(count(*) FILTER (WHERE p = k), 0), 6) AS precision, round(count(*) FILTER (WHERE y = k AND p = k) / nullif(count(*) FILTER (WHERE y = k), 0), 6) AS recall, round(2 * count(*) FILTER (WHERE y = k AND p = k) / (count(*) FILTER (WHERE y = k) + count(*) FILTER (WHERE p = k)), 6) AS f1, round(count(*) FILTER (WHERE y = p) / count(*), 6) AS accuracy FROM X, L GROUP BY k", ["E"])
def class_metrics(spark, sf_dir):
    rows = _predicted(spark, sf_dir).select(F.col("auc_class").alias("y"), F.when(F.col("rel_72h") > 0.05, 1).otherwise(0).alias("p"))
    return metrics.class_metrics(rows)


@query(f"{PREDICTED} SELECT c AS y, CASE WHEN rel_72h > 0.05 THEN 1 ELSE 0 END AS p, count(*) AS n FROM Z GROUP BY ALL", ["E"])
def confusion(spark, sf_dir):
    rows = _predicted(spark, sf_dir).select(F.col("auc_class").alias("y"), F.when(F.col("rel_72h") > 0.05, 1).otherwise(0).alias("p"))
    return metrics.confusion(rows)


@query(f"{PREDICTED}, R AS (SELECT c, rank() OVER (ORDER BY round(rel_72h, 3)) + (count(*) OVER (PARTITION BY round(rel_72h, 3)) - 1) / 2.0 AS k FROM Z WHERE rel_72h IS NOT NULL) SELECT count(*) FILTER (WHERE c = 1) AS n_pos, count(*) FILTER (WHERE c = 0) AS n_neg, round((sum(k) FILTER (WHERE c = 1) - count(*) FILTER (WHERE c = 1) * (count(*) FILTER (WHERE c = 1) + 1) / 2.0) / (count(*) FILTER (WHERE c = 1) * count(*) FILTER (WHERE c = 0)), 6) AS auroc FROM R", ["E"])
def roc_metrics(spark, sf_dir):
    return metrics.auroc(_predicted(spark, sf_dir).select(F.col("auc_class").alias("y"), F.round("rel_72h", 3).alias("score")))


CURVE_METRICS = _grid_sql("E", *MAXED) + f", Y AS (SELECT curve_id, CASE WHEN {AUC} > 0.5 THEN 1 ELSE 0 END AS auc_class FROM S GROUP BY curve_id), X AS (SELECT auc_class, y, gx AS p FROM R JOIN Y USING (curve_id))"


@query(f"{CURVE_METRICS} SELECT CAST(auc_class AS VARCHAR) AS subgroup, {REGRESSION} FROM X GROUP BY auc_class UNION ALL SELECT 'all', {REGRESSION} FROM X", ["E"])
def curve_metrics(spark, sf_dir):
    points = curves.resample(fixtures.cumulative(spark, sf_dir), dealt=True).select("curve_id", "y", F.col("gx").alias("p"))
    rows = points.join(prep.auc_class(_summary(spark, sf_dir)).select("curve_id", "auc_class"), "curve_id")
    by = metrics.regression_metrics(rows, by=["auc_class"])
    return by.select(F.col("auc_class").cast("string").alias("subgroup"), *by.columns[1:]).unionByName(metrics.regression_metrics(rows).withColumn("subgroup", F.lit("all")))


# models: those without SQL are held in tests/test_models.py against what they must satisfy

MODELLED = ["c_nationkey", "c_acctbal"]


def _modelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prep.auc_class(_with_statics(spark, sf_dir)).where("auc_norm is not null")
    return prep.group_folds(rows, ["c_nationkey", "c_mktsegment"], 3)


@query()
def fit_regressor(spark, sf_dir):
    rows, out = tables.scratch(_modelled(spark, sf_dir)), None
    train, test = rows.where("fold <> 0"), rows.where("fold = 0")
    for target in ("rel_24h", "rel_48h", "rel_72h"):
        for kind in models.REGRESSORS:
            got = metrics.regression_metrics(models.predict(models.fit_regressor(train, target, MODELLED, kind), test, MODELLED), target).select(F.lit(target).alias("target"), F.lit(kind).alias("model"), "n", "rmse", "mae")
            out = got if out is None else out.unionByName(got)
    return out


@query()
def fit_classifier(spark, sf_dir):
    rows, out = tables.scratch(_modelled(spark, sf_dir)), None
    train = prep.undersample(rows.where("fold <> 0"), "auc_class", "curve_id")
    for kind in models.CLASSIFIERS:
        got = metrics.auroc(models.predict(models.fit_classifier(train, "auc_class", MODELLED, kind), rows.where("fold = 0"), MODELLED), "auc_class").withColumn("model", F.lit(kind))
        out = got if out is None else out.unionByName(got)
    return out


def _grid_points(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    return curves.resample(fixtures.cumulative(spark, sf_dir), n, dealt=True).join(_modelled(spark, sf_dir).select("curve_id", "fold", *MODELLED), "curve_id")


GRIDDED = _grid_sql("E", *MAXED) + f""", Y AS (SELECT curve_id, {AUC} AS auc_norm FROM S GROUP BY curve_id), U AS (SELECT curve_id, c_nationkey, c_mktsegment, CAST(c_nationkey AS DOUBLE) AS x1, c_acctbal AS x2 FROM Y JOIN customer ON c_custkey = curve_id WHERE auc_norm IS NOT NULL),
FO AS (SELECT c_nationkey, c_mktsegment, (row_number() OVER (ORDER BY count(*) DESC, c_nationkey, c_mktsegment) - 1) % 3 AS fold FROM U GROUP BY c_nationkey, c_mktsegment), T AS (SELECT k, y, x1, x2, fold FROM R JOIN U USING (curve_id) JOIN FO USING (c_nationkey, c_mktsegment)),
L AS (SELECT k, count(*) AS n, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, var_pop(x1) AS s11, var_pop(x2) AS s22, covar_pop(x1, x2) AS s12, covar_pop(x1, y) AS s1, covar_pop(x2, y) AS s2 FROM T WHERE fold <> 0 GROUP BY k),
B AS (SELECT k, n, (s22 * s1 - s12 * s2) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2 - s12 * s1) / (s11 * s22 - s12 * s12) AS b2, my, m1, m2 FROM L)"""


@query(f"{GRIDDED} SELECT k, n, round(my - b1 * m1 - b2 * m2, 6) AS intercept, round(b1 * 100, 6) AS per_100_nations, round(b2 * 1000, 6) AS per_1000_balance FROM B", ["E"])
def grid_models(spark, sf_dir):
    """A linear model for every one of the 50 grid points, on the training folds."""
    got = models.grouped_linear(_grid_points(spark, sf_dir, 50).where("fold <> 0"), "y", MODELLED, ["k"])
    return got.select("k", "n", "intercept", (F.col("slopes")[0] * 100).alias("per_100_nations"), (F.col("slopes")[1] * 1000).alias("per_1000_balance"))


TARGETS = ["rel_24h", "rel_48h", "rel_72h"]
TARGETED = f"""WITH {SUMMARY.format(v='E')}, U AS (SELECT curve_id, c_nationkey, c_mktsegment, CAST(c_nationkey AS DOUBLE) AS x1, c_acctbal AS x2, {', '.join(TARGETS)} FROM Y JOIN customer ON c_custkey = curve_id WHERE auc_norm IS NOT NULL),
FO AS (SELECT c_nationkey, c_mktsegment, (row_number() OVER (ORDER BY count(*) DESC, c_nationkey, c_mktsegment) - 1) % 3 AS fold FROM U GROUP BY c_nationkey, c_mktsegment), T AS ({' UNION ALL '.join(f"SELECT '{t}' AS k, {t} AS y, x1, x2, fold FROM U JOIN FO USING (c_nationkey, c_mktsegment) WHERE {t} IS NOT NULL" for t in TARGETS)}),
L""" + GRIDDED.split("\nL", 1)[1]


@query(f"{TARGETED}, P AS (SELECT T.k, y, my + b1 * (x1 - m1) + b2 * (x2 - m2) AS p FROM T JOIN B USING (k) WHERE fold = 0) SELECT k AS target, count(*) AS n, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(avg(abs(y - p)), 6) AS mae FROM P GROUP BY k", ["E"])
def target_models(spark, sf_dir):
    """A linear model for each early target, all from one aggregate, on the fold that was left out."""
    rows = tables.scratch(profile.tall(_modelled(spark, sf_dir), TARGETS, ["fold", *MODELLED]))
    model = models.grouped_linear(rows.where("fold <> 0"), "value", MODELLED, ["col"])
    told = models.predict_linear(rows.where("fold = 0"), model, MODELLED, ["col"])
    return metrics.regression_metrics(told, "value", by=["col"]).select(F.col("col").alias("target"), "n", "rmse", "mae")


@query(f"{GRIDDED}, P AS (SELECT T.k, y, my + b1 * (x1 - m1) + b2 * (x2 - m2) AS p FROM T JOIN B USING (k) WHERE fold = 0) SELECT k, count(*) AS n, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(avg(abs(y - p)), 6) AS mae FROM P GROUP BY k", ["E"])
def grid_metrics(spark, sf_dir):
    """How well those models do on the fold that was left out."""
    points = tables.scratch(_grid_points(spark, sf_dir, 50))
    model = models.grouped_linear(points.where("fold <> 0"), "y", MODELLED, ["k"])
    told = models.predict_linear(points.where("fold = 0"), model, MODELLED, ["k"])
    return metrics.regression_metrics(told, by=["k"]).select("k", "n", "rmse", "mae")


@query()
def fit_curves(spark, sf_dir):
    points = tables.scratch(_grid_points(spark, sf_dir, 10))
    train, test, out = points.where("fold <> 0"), points.where("fold = 0"), None
    for with_time in (True, False):
        features = [*MODELLED, *(["gx"] if with_time else [])]
        got = metrics.regression_metrics(models.predict(models.curve_regressor(train, MODELLED, with_time), test, features)).select(F.lit("time" if with_time else "no time").alias("model"), "n", "rmse")
        out = got if out is None else out.unionByName(got)
    for k, model in models.grid_models(train, MODELLED, (4, 9)).items():
        out = out.unionByName(metrics.regression_metrics(models.predict(model, test.where(F.col("k") == k), MODELLED)).select(F.lit(f"k={k}").alias("model"), "n", "rmse"))
    return out


def _compare_sql() -> str:
    """Least squares in SQL: each feature in turn is made orthogonal to those before it, on the training rows of each fold."""
    fuzzy = [f"{e.format(x=x).replace('k0', x + '0').replace('k1', x + '1').replace('k2', x + '2')} AS {x}{n}" for x in ("x1", "x2") for e, n in zip(TRI[:2], ("_low", "_medium"))]  # the third set is 1 less the others
    quartiles = ", ".join(f"quantile_cont({x}, {q}) AS {x}{i}" for x in ("x1", "x2") for i, q in enumerate((0.25, 0.5, 0.75)))
    out = f"""WITH {SUMMARY.format(v='E')}, U AS (SELECT curve_id, c_nationkey, c_mktsegment, CAST(c_nationkey AS DOUBLE) AS x1, c_acctbal AS x2, rel_72h AS y FROM Y JOIN customer ON c_custkey = curve_id WHERE auc_norm IS NOT NULL),
FO AS (SELECT c_nationkey, c_mktsegment, (row_number() OVER (ORDER BY count(*) DESC, c_nationkey, c_mktsegment) - 1) % 3 AS fold FROM U GROUP BY c_nationkey, c_mktsegment), V AS (SELECT * FROM U JOIN FO USING (c_nationkey, c_mktsegment)),
Q AS (SELECT i, {quartiles} FROM V JOIN (SELECT unnest(range(3)) AS i) ON i <> fold GROUP BY i), W AS (SELECT i, fold, y, x1, x2, {', '.join(fuzzy)} FROM V, Q WHERE y IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL)"""
    sets = [f"{x}{n}" for x in ("x1", "x2") for n in ("_low", "_medium")]
    rows = []
    for name, own in {"crisp": ["x1", "x2"], "fuzzy": sets, "hybrid": ["x1", "x2", *sets]}.items():
        at = f"{name}_0"
        out += f", {at} AS (SELECT i, fold, y, y - (avg(y) FILTER (WHERE fold <> i) OVER (PARTITION BY i)) AS e, " + ", ".join(f"{c} - (avg({c}) FILTER (WHERE fold <> i) OVER (PARTITION BY i)) AS {c}" for c in own) + " FROM W)"
        for j, z in enumerate(own):
            slope = lambda c: f"coalesce((sum({c} * {z}) FILTER (WHERE fold <> i) OVER (PARTITION BY i)) / nullif(sum({z} * {z}) FILTER (WHERE fold <> i) OVER (PARTITION BY i), 0), 0)"  # noqa: B023, E731
            out += f", {name}_{j + 1} AS (SELECT i, fold, y, " + ", ".join(f"{c} - {slope(c)} * {z} AS {c}" for c in ["e", *own[j + 1 :]]) + f" FROM {name}_{j})"
        rows.append(f"SELECT '{name}' AS representation, CAST(i AS INTEGER) AS fold, count(*) AS n, round(sqrt(avg(e * e)), 6) AS metric FROM {name}_{len(own)} WHERE fold = i GROUP BY i")
    return out + " " + " UNION ALL ".join(rows)


@query(_compare_sql(), ["E"])
def compare_representations(spark, sf_dir):
    return models.compare_representations(_modelled(spark, sf_dir), "rel_72h", MODELLED, "fold", 3)


@query()
def compare_classes(spark, sf_dir):
    """The same for the class target, by the area under the curve."""
    return models.compare_representations(tables.scratch(prep.auc_class(_modelled(spark, sf_dir), 0.45)), "auc_class", MODELLED, "fold", 3, "logistic", "class")


@query()
def importance(spark, sf_dir):
    return models.importance(_modelled(spark, sf_dir), "rel_72h", MODELLED)
