"""Views of the driver's tables that stand for curve tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .tables import load_table, nan_to_null

_DAY = 86_400_000_000.0
#: A prime near 500,000: prices over it have no short decimals, so rounding to 6 places never meets a tie.
ORDER_SCALE = 499_979


def _days(column: str, since: str):
    """Days since midnight of ``since``, from the fields of a zoneless time, so that no session zone matters."""
    t = f"cast({column} AS timestamp_ntz)"
    return F.expr(f"datediff({t}, DATE '{since}') * 86400000000L + hour({t}) * 3600000000L + minute({t}) * 60000000L + cast(extract(SECOND FROM {t}) * 1000000 AS bigint)") / _DAY


def cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture E: each user's running share of value; monotone curves."""
    own = Window.partitionBy("curve_id")
    run = own.orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = load_table(spark, sf_dir, "events").select(F.col("user_id").alias("curve_id"), "ts", "event_id", "value")
    return e.select("curve_id", "event_id", _days("ts", "2024-01-01").alias("t"), (F.sum("value").over(run) / F.sum("value").over(own)).alias("r"))


def noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture V: raw values over 100, in 3-hour buckets, so that times repeat and values exceed 1."""
    e = load_table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    return nan_to_null(e.select(F.col("user_id").alias("curve_id"), "event_id", (F.floor(_days("ts", "2024-01-01") * 8) / 8).alias("t"), (F.col("value") / 100).alias("r")))


def orders_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture O: a customer's orders as a curve, with statics repeated on each row."""
    o = load_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    c = load_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    return o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_custkey").alias("curve_id"), F.col("o_orderkey").alias("event_id"), _days("o_orderdate", "1995-01-01").alias("t"), (F.col("o_totalprice") / ORDER_SCALE).alias("r"), "c_nationkey", "c_acctbal", "c_mktsegment")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture P: static features and a three-part fingerprint."""
    return load_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_type", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")


#: The same views as SQL, to stand in front of an oracle query.
SQL = {
    "E": "E AS (SELECT user_id AS curve_id, event_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 86400000000.0 AS t, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) / sum(value) OVER (PARTITION BY user_id) AS r FROM events)",
    "V": "V AS (SELECT user_id AS curve_id, event_id, floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 86400000000.0 * 8) / 8 AS t, value / 100 AS r FROM events)",
    "O": "O AS (SELECT o_custkey AS curve_id, o_orderkey AS event_id, (epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1995-01-01')) / 86400000000.0 AS t, o_totalprice / 499979 AS r, c_nationkey, c_acctbal, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey)",
    "P": "P AS (SELECT p_partkey AS id, p_brand, p_type, CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM part)",
}
