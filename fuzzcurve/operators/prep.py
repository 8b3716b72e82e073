"""Leakage-safe preparation: folds by group, sampling, and parameters fitted on training rows only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from .rank import distributed_rank, quantiles_of_others


def auc_class(summary: DataFrame, threshold: float = 0.5) -> DataFrame:
    """1 above the threshold, else 0; null stays null."""
    c = F.col("auc_norm")
    return summary.withColumn("auc_class", F.when(c > threshold, 1).when(c.isNotNull(), 0))


def group_folds(df: DataFrame, groups: Sequence[str], k: int) -> DataFrame:
    """``df`` with ``fold``: whole groups, dealt by size (largest first, ties by the group's columns). Rows with a null in the group have no fold."""
    size = df.na.drop(subset=list(groups)).groupBy(*groups).agg((-F.count("*")).alias("__size"))
    ranked, _ = distributed_rank(size, ["__size", *groups])
    return df.join(ranked.select(*groups, (F.col("pos") % k).cast("int").alias("fold")), list(groups), "left")


def undersample(df: DataFrame, label: str, key: str, seed: int = 0, train: str | None = None) -> DataFrame:
    """Training rows with every class cut to the size of the smallest, by the order of md5(key|seed); with ``train``, all other rows stay.

    Rows without a label belong to no class: they are no training rows, nor
    are those whose flag ``train`` is null. Classes are counted by the first
    three hex digits, so that only the buckets at the border are ordered in a
    window.
    """
    is_train = F.col(label).isNotNull() & (F.coalesce(F.col(train), F.lit(False)) if train else F.lit(True))
    own = df.where(is_train).withColumn("__h", F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))))
    own = own.withColumn("__b", F.substring("__h", 1, 3))
    counts = own.groupBy(label, "__b").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(label).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = counts.groupBy(label).agg(F.sum("__n").alias("s"))
    least = sizes.agg(F.min("s").alias("__least"))
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).join(F.broadcast(least))
    dealt = own.join(counts.where("__before < __least"), [label, "__b"])
    whole = dealt.where("__before + __n <= __least")
    border = dealt.where("__before + __n > __least").withColumn("__k", F.row_number().over(Window.partitionBy(label, "__b").orderBy("__h", key))).where("__before + __k <= __least")
    out = whole.select(*df.columns).unionByName(border.select(*df.columns))
    return out if train is None else out.unionByName(df.where(~is_train))


def one_hot(df: DataFrame, col: str, levels: Sequence[str]) -> DataFrame:
    """An indicator for each level fitted on training rows; other values are all zero, null stays null."""
    return df.withColumns({f"{col}={v}": F.when(F.col(col).isNotNull(), (F.col(col) == v).cast("int")) for v in levels})


def fit_levels(train: DataFrame, col: str) -> list[str]:
    """Every known level of the training rows, in order, for columns whose levels are few (``one_hot`` makes a column of each); see ``level_table`` for others."""
    return [r[0] for r in train.where(F.col(col).isNotNull()).select(col).distinct().sort(col).collect()]


def level_table(train: DataFrame, col: str) -> DataFrame:
    """(level, index): the dictionary of a nominal column's known levels, in order from 0, as a table of any size."""
    levels = train.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("level")).agg(F.lit(0).alias("__one")).select("level")
    return distributed_rank(levels, ["level"])[0].select("level", F.col("pos").alias("index"))


def encode_levels(df: DataFrame, col: str, levels: DataFrame, out: str = "encoded") -> DataFrame:
    """``df`` with ``out``: a sparse vector with a 1 at the level's index; all zero for other values, null for null.

    The dictionary is joined, not brought to the driver; its size is all that
    the vectors need to know.
    """
    from pyspark.ml.feature import OneHotEncoder

    size = levels.count()
    fitted = df.join(levels.select(F.col("level").alias(col), F.col("index").alias("__index")), col, "left").select(*df.columns, "__index")
    coded = fitted.withColumn("__index", F.coalesce("__index", F.lit(size)).cast("double"))
    top = df.sparkSession.range(1).select(F.lit(float(size)).alias("__index"))  # what is no level has the last index, which is dropped
    model = OneHotEncoder(inputCol="__index", outputCol="__vector").fit(top)
    return model.transform(coded).withColumn(out, F.when(F.col(col).isNotNull(), F.col("__vector"))).drop("__index", "__vector")


def fold_scale(df: DataFrame, col: str, fold: str, folds: int) -> DataFrame:
    """(``df``, scaled): each row standardised with mean and sample deviation of the other folds' rows.

    Each fold's moments are taken once; those of its complement come from the
    moments of the other folds, a few rows in all.
    """
    own = df.where(F.col(fold).isNotNull() & F.col(col).isNotNull()).groupBy(F.col(fold).alias("__f")).agg(F.count("*").alias("__n"), F.avg(col).alias("__a"), F.var_pop(col).alias("__p"))
    others = own.withColumn("__fold", F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda i: i != F.col("__f"))))
    mean = others.groupBy("__fold").agg(F.sum("__n").alias("__all"), (F.sum(F.col("__n") * F.col("__a")) / F.sum("__n")).alias("__m"))
    spread = F.sum(F.col("__n") * (F.col("__p") + F.pow(F.col("__a") - F.col("__m"), 2)))
    fitted = others.join(mean, "__fold").groupBy("__fold", "__m", "__all").agg(spread.alias("__ss"))
    fitted = fitted.select("__fold", "__m", F.when(F.col("__all") > 1, F.sqrt(F.col("__ss") / (F.col("__all") - 1))).alias("__s"))
    return df.join(fitted, F.col(fold) == F.col("__fold"), "left").withColumn("scaled", F.when(F.col("__s") > 0, (F.col(col) - F.col("__m")) / F.col("__s"))).drop("__fold", "__m", "__s")


def fold_impute(df: DataFrame, col: str, fold: str, folds: int, accuracy: int | None = None) -> DataFrame:
    """(``df``, imputed): nulls take the median of the other folds' rows."""
    fitted = quantiles_of_others(df, fold, folds, col, [0.5], accuracy).select(F.col(fold).alias("__fold"), F.col("q")[0].alias("__m"))
    return df.join(fitted, F.col(fold) == F.col("__fold"), "left").withColumn("imputed", F.coalesce(col, "__m")).drop("__fold", "__m")
