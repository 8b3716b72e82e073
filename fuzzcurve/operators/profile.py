"""Profiles of static tables: shapes, quantiles, histograms, counts and boxes.

Quantiles are exact (linear between neighbours; see ``rank.quantiles``);
``accuracy`` asks for ``percentile_approx`` instead.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.scalar import key_label
from .rank import quantiles


def shape(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.lit(len(df.columns)).cast("long").alias("n_cols"), F.countDistinct(key).alias("n_keys"))


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key by ``order``; ties are settled by the other columns."""
    rest = [c for c in df.columns if c != key]
    one = F.min_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order])).alias("x")
    return df.groupBy(key).agg(one).select(key, "x.*")


def tall(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(col, value) rows of numeric columns, in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"`{c}`").cast("double").alias("value")) for c in cols])
    return df.select(*keep, F.explode(pairs).alias("p")).select(*keep, "p.*")


def describe(df: DataFrame, cols: Sequence[str], accuracy: int | None = None) -> DataFrame:
    """count, mean, sample std, min, quartiles and max of each column, nulls left out; a column without a known value has a count of 0."""
    v = F.col("__v")
    more = [F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("lo"), F.max(v).alias("hi")]
    out = _names(df, cols).join(quantiles(tall(df, cols), ["col"], "value", [0.25, 0.5, 0.75], accuracy, more), "col", "left")
    return out.select("col", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "mean", "std", "lo", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q2"), F.col("q")[2].alias("q3"), "hi")


def _names(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(col): a row for each name."""
    return df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, cols))).alias("col"))


def medians(df: DataFrame, cols: Sequence[str], accuracy: int | None = None) -> DataFrame:
    """The median of each column; null for a column without a known value."""
    return _names(df, cols).join(quantiles(tall(df, cols), ["col"], "value", [0.5], accuracy), "col", "left").select("col", F.col("q")[0].alias("median"))


def ranges(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return tall(df, cols).groupBy("col").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))


def _count_bins(df: DataFrame, col: str, edges: Sequence[float]) -> DataFrame:
    """Counts between literal edges: half-open, the last closed; empty bins too."""
    spark, x, m = df.sparkSession, F.col(col), len(edges) - 1
    at = F.when(x == edges[-1], m - 1).otherwise(F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= x)) - 1)
    got = df.where((x >= edges[0]) & (x <= edges[-1])).groupBy(at.cast("int").alias("bin")).count()
    bins = spark.createDataFrame([(i, float(edges[i]), float(edges[i + 1])) for i in range(m)], "bin int, lo double, hi double")
    return bins.join(got, "bin", "left").select("bin", "lo", "hi", F.coalesce("count", F.lit(0)).cast("long").alias("n"))


def _bins(df: DataFrame, col: str, edges) -> DataFrame:
    """Counts between ``edges(least, largest)``; without a known value, or of infinite ones, no bins."""
    lo, hi = df.where(~F.isnan(F.col(col).cast("double"))).agg(F.min(col), F.max(col)).first()
    if lo is None or not math.isfinite(float(hi) - float(lo)):
        return df.sparkSession.createDataFrame([], "bin int, lo double, hi double, n long")
    return _count_bins(df, col, edges(float(lo), float(hi)))


def _linear(bins: int):
    def edges(lo: float, hi: float) -> list[float]:
        if lo == hi:
            lo, hi = lo - 0.5, hi + 0.5
        return [lo + (hi - lo) * i / bins for i in range(bins)] + [hi]

    return edges


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Equal bins from the least to the largest value. Edges are compared, not divided by, so edge values fall right."""
    return _bins(df, col, _linear(bins))


def histogram_log(df: DataFrame, col: str, bins: int = 21, linear_bins: int = 22) -> DataFrame:
    """Log-spaced bins with the exact extremes at the ends, if all known values are positive; else ``linear_bins`` equal ones. Nulls are left out."""

    def edges(lo: float, hi: float) -> list[float]:
        if lo <= 0 or lo == hi:
            return _linear(linear_bins if lo <= 0 else bins)(lo, hi)
        step = (math.log10(hi) - math.log10(lo)) / bins
        return [lo] + [10 ** (math.log10(lo) + i * step) for i in range(1, bins)] + [hi]

    return _bins(df, col, edges)


def histogram_int(df: DataFrame, col: str, start: int = 4) -> DataFrame:
    """Counts of whole numbers from ``start`` on; smaller ones are left out."""
    return df.where(F.col(col) >= start).groupBy(F.col(col).cast("long").alias("value")).agg(F.count("*").alias("n"))


def split_over(df: DataFrame, col: str, limit: float = 1.0) -> DataFrame:
    return df.agg(F.count_if(F.col(col) <= limit).alias("n_within"), F.count_if(F.col(col) > limit).alias("n_over"), F.count(col).alias("n"))


def predicates(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Of each column: whether any value is known, and whether all known values are positive."""
    return tall(df, cols).groupBy("col").agg(F.bool_or(F.col("value").isNotNull()).alias("any_known"), F.bool_and(F.col("value") > 0).alias("all_positive"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n"))


def top_categories(df: DataFrame, col: str | None, k: int = 15, key: Sequence[str] = ()) -> DataFrame:
    """The ``k`` commonest values; ties by value.

    Without a label column (None, not there, or without any known value) the
    tuples of ``key`` are counted, and named after the first (MW) and the
    last (LogP); ties by name.
    """
    labelled = col is not None and col in df.columns and (not key or not df.where(F.col(col).isNotNull()).isEmpty())
    if labelled:
        return value_counts(df, col).orderBy(F.desc("n"), col).limit(k)
    name = key_label(F.col(key[0]), F.col(key[-1]))
    counts = df.groupBy(*key).agg(F.count("*").alias("n")).select(name.alias(col or "label"), "n", *key)
    return counts.orderBy(F.desc("n"), *key).limit(k).select(col or "label", "n")


def group_sizes(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias("n"))


def distinct_composite(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct tuples; those with nulls count too."""
    return df.agg(F.countDistinct(F.struct(*cols)).alias("n_distinct"))


def box_stats(df: DataFrame, key: str, value: str, accuracy: int | None = None) -> DataFrame:
    """Quartiles, size and the whiskers at 1.5 interquartile ranges of each group."""
    own = df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(key, value)
    q = quantiles(own, [key], value, [0.25, 0.5, 0.75], accuracy).select(key, F.col("q")[0].alias("q1"), F.col("q")[1].alias("med"), F.col("q")[2].alias("q3"), "n")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = own.join(q, key).where(F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)).groupBy(key).agg(F.min(value).alias("whisk_lo"), F.max(value).alias("whisk_hi"))
    return q.join(inside, key, "left").select(key, "q1", "med", "q3", "whisk_lo", "whisk_hi", "n")
