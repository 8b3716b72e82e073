"""Metrics as aggregates over (y, p) tables, optionally by group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .rank import average_rank


def regression_metrics(df: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = (), features: int = 1) -> DataFrame:
    """n, rmse, mae, pearson, r2 and adjusted r2 over rows where both are known."""
    own = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    e = F.col(y) - F.col(p)
    n, sse, sst = F.count("*"), F.sum(e * e), F.var_pop(y) * F.count("*")
    r2 = F.when(F.col("sst") > 0, 1 - F.col("sse") / F.col("sst"))
    out = own.groupBy(*by).agg(n.alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.corr(y, p).alias("pearson"), sse.alias("sse"), sst.alias("sst")).withColumn("r2", r2)
    adjusted = F.when(F.col("n") > features + 1, 1 - (1 - F.col("r2")) * (F.col("n") - 1) / (F.col("n") - features - 1))
    return out.withColumn("adj_r2", adjusted).drop("sse", "sst")


def confusion(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    return df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(y, p).agg(F.count("*").alias("n"))


def class_metrics(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Of each class: support, precision, recall and F1, and the accuracy over all; from the confusion table."""
    cells = confusion(df, y, p)
    sides = cells.select(F.explode(F.array(F.struct(F.col(y).alias("c"), F.lit(1).alias("t"), F.lit(0).alias("g"), "n"), F.struct(F.col(p).alias("c"), F.lit(0).alias("t"), F.lit(1).alias("g"), "n"))).alias("x"), (F.col(y) == F.col(p)).alias("hit")).select("x.*", "hit")
    by = sides.groupBy("c").agg(F.sum(F.col("t") * F.col("n")).alias("support"), F.sum(F.col("g") * F.col("n")).alias("given"), F.sum(F.when(F.col("hit"), F.col("t") * F.col("n")).otherwise(0)).alias("tp"))
    whole = cells.agg((F.sum(F.when(F.col(y) == F.col(p), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    precision, recall = F.when(F.col("given") > 0, F.col("tp") / F.col("given")), F.when(F.col("support") > 0, F.col("tp") / F.col("support"))
    f1 = F.when(F.col("support") + F.col("given") > 0, 2 * F.col("tp") / (F.col("support") + F.col("given")))
    return by.join(F.broadcast(whole)).select(F.col("c").alias("class"), "support", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "accuracy")


def auroc(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """Area under the ROC curve from average ranks (Mann-Whitney)."""
    own = df.where(F.col(y).isNotNull() & F.col(score).isNotNull()).select(y, F.col(score).cast("double").alias(score))
    ranked = average_rank(own, [], score, "rank")
    pos, neg = F.count_if(F.col(y) == 1), F.count_if(F.col(y) == 0)
    top = F.sum(F.when(F.col(y) == 1, F.col("rank")))
    return ranked.agg(pos.alias("n_pos"), neg.alias("n_neg"), top.alias("s")).select("n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), (F.col("s") - F.col("n_pos") * (F.col("n_pos") + 1) / 2) / (F.col("n_pos") * F.col("n_neg"))).alias("auroc"))
