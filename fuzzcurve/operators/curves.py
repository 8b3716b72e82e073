"""Curves: collapse, segments, summaries, resampling and quality checks.

A curve table has ``curve_id``, ``t`` and ``r``. Rows with a null time or
value are left out before anything else. One exchange by curve serves the
collapse, the neighbours and the aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalar import interpolate, min_max, over_max
from .rank import distributed_rank, quantiles


def collapse_times(df: DataFrame, dealt: bool = False) -> DataFrame:
    """Mean value of each curve and time, so that times strictly increase.

    Rows are dealt by curve first, which later windows and aggregates reuse;
    ``dealt`` says that the plan has done so already.
    """
    own = df.where("t is not null and r is not null and not isnan(t) and not isnan(r)")
    return (own if dealt else own.repartition("curve_id")).groupBy("curve_id", "t").agg(F.avg("r").alias("r"))


def segments(df: DataFrame, dealt: bool = False) -> DataFrame:
    """Collapsed points with the neighbours (pt, pr, nt, nr), the curve's tmin and tmax, and x = t / tmax."""
    by = Window.partitionBy("curve_id")
    order = by.orderBy("t")
    near = {f"{p}{c}": f(c).over(order) for p, f in (("p", F.lag), ("n", F.lead)) for c in ("t", "r")}
    out = collapse_times(df, dealt).withColumns(near | {"tmin": F.min("t").over(by), "tmax": F.max("t").over(by)})
    return out.withColumn("x", over_max(F.col("t"), F.col("tmax")))


def _value_at(tau: float):
    """One expression in SQL, since plans of many small calls take longer to build than small tables to read."""
    at = f"{float(tau)!r}D"
    return F.expr(f"max(CASE WHEN pt IS NULL AND t > {at} THEN r WHEN nt IS NULL AND t <= {at} THEN r WHEN t <= {at} AND nt > {at} THEN r + ({at} - t) * (nr - r) / (nt - t) END)")


def _t_half(level: float):
    t, r, pt, pr = (F.col(c) for c in ("t", "r", "pt", "pr"))
    return F.min_by(F.when(pt.isNull(), t).otherwise(interpolate(pt, pr, t, r, F.lit(level))), F.when(r >= level, t))


def _auc():
    return F.expr("CASE WHEN max(tmax) > 0 THEN coalesce(sum((x - pt / nullif(tmax, 0D)) * (r + pr) / 2), 0D) END")


def summarise(segs: DataFrame, taus: Sequence[float] = (1.0, 2.0, 3.0), level: float = 0.5) -> DataFrame:
    """One row for each curve: n_points, duration, r_final, r_max, auc_norm, the values at ``taus`` days and the time to ``level``."""
    at = [_value_at(tau).alias(f"rel_{round(tau * 24)}h") for tau in taus]
    return segs.groupBy("curve_id").agg(F.count("*").alias("n_points"), F.max("t").alias("duration"), F.max_by("r", "t").alias("r_final"), F.max("r").alias("r_max"), _auc().alias("auc_norm"), *at, _t_half(level).alias("t_half"))


def curve_summary(df: DataFrame, statics: DataFrame | None = None, dealt: bool = False) -> DataFrame:
    """Descriptors of every curve, with its static row where ``statics`` has one."""
    out = summarise(segments(df, dealt))
    return out if statics is None else out.join(statics, "curve_id", "left")


def resample(df: DataFrame, n: int = 50, norm: str = "max", dealt: bool = False) -> DataFrame:
    """(curve_id, k, gx, y): each curve with a duration at ``n`` even points of normalised time.

    A segment emits the grid points that fall into it, so there is neither a
    join nor a user function; the ends are held left and right. ``norm`` is
    'max' (t / tmax) or 'minmax'.
    """
    segs = segments(df, dealt).where("tmax > 0" if norm == "max" else "tmax > tmin")
    scale = (lambda c: F.col(c) / F.col("tmax")) if norm == "max" else lambda c: min_max(F.col(c), F.col("tmin"), F.col("tmax"))
    grid = lambda c: F.ceil(scale(c) * (n - 1)).cast("int")
    first = F.when(F.col("pt").isNull(), 0).otherwise(grid("t"))
    last = F.when(F.col("nt").isNull(), n - 1).otherwise(grid("nt") - 1)
    rows = segs.select("curve_id", "r", "nr", "pt", scale("t").alias("x"), scale("nt").alias("nx"), first.alias("a"), last.alias("z")).where("a <= z")
    rows = rows.select("*", F.explode(F.sequence("a", "z")).alias("k")).withColumn("gx", F.col("k") / (n - 1))
    y = F.when(F.col("nx").isNull() | (F.col("gx") <= F.col("x")), F.col("r")).otherwise(F.col("r") + (F.col("gx") - F.col("x")) * (F.col("nr") - F.col("r")) / (F.col("nx") - F.col("x")))
    return rows.select("curve_id", "k", "gx", y.alias("y"))


def to_wide(resampled: DataFrame) -> DataFrame:
    """One array of values for each curve, in grid order."""
    return resampled.groupBy("curve_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "y"))), lambda s: s["y"]).alias("ys"))


def median_curve(df: DataFrame, n: int = 50, dealt: bool = False, accuracy: int | None = None) -> DataFrame:
    """(k, gx, median, n) over all curves at each grid point."""
    q = quantiles(resample(df, n, dealt=dealt), ["k"], "y", [0.5], accuracy)
    return q.select("k", (F.col("k") / (n - 1)).alias("gx"), F.col("q")[0].alias("median"), "n")


def dips(df: DataFrame, eps: float = 1e-9, tie: str = "event_id") -> DataFrame:
    """(curve_id, dips): whether raw values ever step down by more than ``eps``; ``tie`` orders equal times."""
    order = Window.partitionBy("curve_id").orderBy("t", tie)
    step = df.where("t is not null and r is not null").select("curve_id", (F.col("r") - F.lag("r").over(order)).alias("d"))
    return step.groupBy("curve_id").agg(F.coalesce(F.bool_or(F.col("d") < -eps), F.lit(False)).alias("dips"))


def dip_counts(df: DataFrame, eps: float = 1e-9) -> DataFrame:
    return dips(df, eps).agg(F.count_if("dips").alias("n_dip"), F.count_if(~F.col("dips")).alias("n_monotone"))


def nth_point(df: DataFrame, n: int = 3) -> DataFrame:
    """Each curve's ``n``-th raw point, or its last."""
    by = Window.partitionBy("curve_id")
    k = df.select("curve_id", "t", "r", F.row_number().over(by.orderBy("t", "event_id")).alias("k"), F.count("*").over(by).alias("n"))
    return k.where(F.col("k") == F.least(F.lit(n), F.col("n"))).select("curve_id", "k", "t", "r")


def archetypes(summary: DataFrame, by: str = "auc_norm") -> DataFrame:
    """(curve_id, value, pos, kind): the two slowest, middle and fastest curves; nulls are left out first.

    Positions come from a distributed rank, never from one global window.
    """
    ranked, n = distributed_rank(summary.where(F.col(by).isNotNull()).select("curve_id", by), [by, "curve_id"])
    kinds = [(0, "slow"), (1, "slow"), (n // 2 - 1, "median"), (n // 2, "median"), (n - 2, "fast"), (n - 1, "fast")]
    wanted = {p: kind for p, kind in reversed(kinds) if 0 <= p < n}
    kind = F.lit(None).cast("string")
    for p, name in wanted.items():
        kind = F.when(F.col("pos") == p, name).otherwise(kind)
    return ranked.where(F.col("pos").isin(*wanted) if wanted else F.lit(False)).select("curve_id", F.col(by).alias("value"), "pos", kind.alias("kind"))


def archetype_curves(df: DataFrame, picks: DataFrame) -> DataFrame:
    """The raw points of the picked curves on normalised time."""
    own = df.join(picks.select("curve_id", "kind"), "curve_id")
    tmax = F.max("t").over(Window.partitionBy("curve_id"))
    return own.withColumn("tmax", tmax).select("curve_id", "kind", over_max(F.col("t"), F.col("tmax")).alias("x"), "r")
