"""Ranks and quantiles without a global window.

Ranks come from range partitions and prefix sums: Spark cuts the rows by
sampled bounds into as many partitions as they need, each counts its rows, and
what lies before a partition is added to the places inside it.

Quantiles come from mergeable sketches and exact counts (``quantiles``).
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.tables import scanned_bytes, scratch

#: Tables that scan no more than this are small enough for Spark's own exact percentile, which holds the distinct values of a group.
SMALL_BYTES = 32 << 20
#: Distinct values that one window orders at most.
LIMIT = 1 << 16
#: Size of the sketches, into how many even steps their quantiles are read, and how many steps they may err.
SKETCH, GRID, REACH = 2048, 512, 2


def _even() -> Column:
    return F.expr("array(" + ", ".join(f"{i / GRID!r}D" for i in range(GRID + 1)) + ")")


def _placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``__part``: their range partition by ``order``; written, so that the places that follow from it hold."""
    return scratch(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))


def distributed_rank(df: DataFrame, order: Sequence[str]) -> tuple[DataFrame, int]:
    """``df`` with ``pos`` (0-based, by the columns ``order``, which tell rows apart), and the number of rows.

    The rows are computed once. The driver gets one count for each partition.
    """
    rows = _placed(scratch(df), order)
    counts = sorted((r["__part"], r["count"]) for r in rows.groupBy("__part").count().collect())
    before, total = [], 0
    for part, n in counts:
        before.append((part, total))
        total += n
    offsets = rows.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps([{"__part": p, "__before": n} for p, n in before])), "array<struct<__part:int,__before:bigint>>")))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    out = rows.withColumn("pos", place).join(F.broadcast(offsets), "__part")
    return out.select(*df.columns, (F.col("pos") - 1 + F.col("__before")).cast("long").alias("pos")), total


def rank_table(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """(by, value, out): the average rank of each distinct ``value`` (no nulls) within the groups ``by``.

    Values are counted first, so ties and hot values combine on the map side;
    windows see each distinct value once, in range partitions. ``df`` is read
    once for the counts; callers that go on with its rows write them first.
    """
    by = list(by)
    counts = _placed(df.groupBy(*by, value).agg(F.count("*").alias("__n")), [*by, value])
    whole = counts.groupBy(*by, "__part").agg(F.sum("__n").alias("__m"))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select(*by, "__part", F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy(*by, "__part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return counts.join(whole, [*by, "__part"]).select(*by, value, (F.col("__offset") + F.coalesce(F.sum("__n").over(inside), F.lit(0)) + (F.col("__n") + 1) / 2).alias(out))


def average_rank(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """``df`` with the average rank of ``value`` within the groups ``by``."""
    df = scratch(df)
    return df.join(rank_table(df, by, value, out), [*by, value])


def quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], accuracy: int | None = None, more: Sequence[Column] = ()) -> DataFrame:
    """(by, q, n, more): quantiles of the known values of each group, linear between neighbours, as an array, how many values, and other aggregates of them.

    Exact, and no task holds a group's values: see ``_in_rounds``. Tables that
    scan less than ``SMALL_BYTES`` take one aggregate instead, with the same
    result. ``accuracy`` asks for ``percentile_approx``. Groups with a null key
    or without a known value are left out.
    """
    by, probs = list(by), [float(p) for p in probs]
    own = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__v")).na.drop(subset=by or None, how="any")
    more = [F.expr(m) if isinstance(m, str) else m for m in more]
    if accuracy is not None or scanned_bytes(own) <= SMALL_BYTES:
        q = F.percentile("__v", F.array(*map(F.lit, probs))) if accuracy is None else F.percentile_approx("__v", F.array(*map(F.lit, probs)), accuracy)
        return own.groupBy(*by).agg(q.alias("q"), F.count("*").alias("n"), *more).where("n > 0")
    rows = scratch(own.withColumn("__g", F.lit(0).cast("long")))
    keys = [*by, "__g"]
    ks = F.array(*[f(p * (F.col("__m") - 1)).cast("long") for p in probs for f in (F.floor, F.ceil)])
    start = rows.groupBy(*keys).agg(F.count("*").alias("__m"), _sketch()).select(*keys, "__m", F.col("__m").alias("__n"), ks.alias("__k"), _steps())
    out = _in_rounds(rows, by, start, probs)
    if more:
        out = out.join(rows.groupBy(*by).agg(*more), by) if by else out.join(F.broadcast(rows.agg(*more)))
    return out


def _sketch() -> Column:
    return F.kll_sketch_agg_double(F.when(~F.isnan("__v"), F.col("__v")), F.lit(SKETCH)).alias("__s")


def _steps() -> Column:
    """Quantiles of the sketch in even steps; null if it is empty."""
    return F.when(F.kll_sketch_get_n_double("__s") > 0, F.kll_sketch_get_quantile_double("__s", _even())).alias("__q")


def _brackets(state: DataFrame, m: int) -> list[Column]:
    """``__lo`` and ``__hi``: for each of ``m`` quantiles the values between which a sketch sees its (up to two) wanted places."""
    share = lambda k: F.col("__k")[k].cast("double") / F.col("__m") * GRID
    ends = [(F.coalesce(share(2 * j), share(2 * j + 1)), F.coalesce(share(2 * j + 1), share(2 * j))) for j in range(m)]
    at = lambda c: F.get("__q", F.greatest(F.lit(0), F.least(F.lit(GRID), c)).cast("int"))
    return [F.array(*[at(F.floor(a) - REACH) for a, _ in ends]).alias("__lo"), F.array(*[at(F.ceil(z) + REACH) for _, z in ends]).alias("__hi")]


def _bucket(lo: Column, hi: Column, m: int) -> Column:
    """Between which of the brackets' ends a value lies; NaN counts as the largest value, as in a sort."""
    v = F.col("__v")
    return sum((F.coalesce((v >= lo[j]).cast("int"), F.lit(0)) + F.coalesce((v > hi[j]).cast("int"), F.lit(0)) for j in range(m)), F.lit(0))


def _cells(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct values of each key, and how often they are there."""
    return rows.groupBy(*keys, "__v").agg(F.count("*").alias("__c"))


def _in_rounds(rows: DataFrame, by: list[str], state: DataFrame, probs: Sequence[float]) -> DataFrame:
    """(by, q, n) from ``rows`` (by, __g, __v) and ``state``: of each key (by, __g) its wanted places ``__k``, rows ``__m``, its group's rows ``__n`` and the steps ``__q`` of its sketch.

    Each round cuts the values of a key at brackets around the wanted places,
    counts the rows of each piece, and keeps the pieces that have a wanted
    place, with the place counted from the piece's start. The counts are
    exact, so the sketch only decides how much a round keeps: a few steps of
    ``GRID``. Rounds end when no piece has more than ``LIMIT`` distinct
    values; only those are ordered.
    """
    m, keys = len(probs), [*by, "__g"]
    while True:
        state = scratch(state.select(*keys, "__n", "__k", *_brackets(state, m)))
        cut = rows.join(state.select(*keys, "__lo", "__hi"), keys).select(*keys, "__v", _bucket(F.col("__lo"), F.col("__hi"), m).alias("__b"))
        counts = cut.groupBy(*keys, "__b").agg(F.count("*").alias("__m"))
        before = F.coalesce(F.sum("__m").over(Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        held = counts.withColumn("__before", before).join(state.select(*keys, "__n", "__k"), keys)
        inside = F.transform("__k", lambda k: F.when((k >= F.col("__before")) & (k < F.col("__before") + F.col("__m")), k - F.col("__before")))
        held = held.withColumn("__k", inside).where(F.exists("__k", lambda k: k.isNotNull()))
        held = scratch(held.select(*keys, "__b", "__m", "__n", "__k"))
        deeper = (F.col("__g") * (2 * m + 1) + F.col("__b")).alias("__g")
        rows = cut.join(held.select(*keys, "__b"), [*keys, "__b"]).select(*by, deeper, "__v")
        wanted = held.select(*by, deeper, "__m", "__n", "__k")
        if (held.agg(F.max("__m")).first()[0] or 0) <= LIMIT:
            break
        rows = scratch(rows)
        if _cells(rows, keys).groupBy(*keys).count().agg(F.max("count")).first()[0] <= LIMIT:
            break
        state = rows.groupBy(*keys).agg(_sketch()).select(*keys, _steps()).join(wanted, keys)
    cells = _cells(rows, keys)
    cells = cells.withColumn("__end", F.sum("__c").over(Window.partitionBy(*keys).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))).join(wanted, keys)
    k = lambda t: F.col("__k")[t]
    ends = [F.max(F.when((k(t) >= F.col("__end") - F.col("__c")) & (k(t) < F.col("__end")), F.col("__v"))).alias(f"__{t}") for t in range(2 * m)]
    out = cells.groupBy(*by).agg(*ends, F.max("__n").alias("n")).where("n > 0")

    def one(j: int, p: float) -> Column:
        lo, hi, at = F.col(f"__{2 * j}"), F.col(f"__{2 * j + 1}"), p * (F.col("n") - 1)
        return F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (at - F.floor(at)))

    return out.select(*by, F.array(*[one(j, p) for j, p in enumerate(probs)]).alias("q"), "n")


def quantiles_of_others(df: DataFrame, fold: str, folds: int, value: str, probs: Sequence[float], accuracy: int | None = None) -> DataFrame:
    """(fold, q, n): for each fold the quantiles of the known values of all other folds' rows.

    Every row is read as it is, not once a fold: counters for each fold stand
    side by side in one aggregate, bounds come from the merged sketches of the
    other folds, and only rows between a fold's bounds are sent for it. Rows
    without a fold count nowhere.
    """
    probs, every = [float(p) for p in probs], range(folds)
    own = df.where(F.col(value).isNotNull() & F.col(fold).isNotNull()).select(F.col(fold).cast("int").alias("__f"), F.col(value).cast("double").alias("__v"))
    other = [F.col("__f") != i for i in every]
    if accuracy is not None or scanned_bytes(own) <= SMALL_BYTES:
        q = (lambda c: F.percentile(c, F.array(*map(F.lit, probs)))) if accuracy is None else lambda c: F.percentile_approx(c, F.array(*map(F.lit, probs)), accuracy)
        wide = own.agg(*[q(F.when(other[i], F.col("__v"))).alias(f"q{i}") for i in every], *[F.count_if(other[i]).alias(f"n{i}") for i in every])
        return wide.select(F.explode(F.array(*[F.struct(F.lit(i).alias("fold"), F.col(f"q{i}").alias("q"), F.col(f"n{i}").alias("n")) for i in every])).alias("x")).select("x.*").where("n > 0").withColumnRenamed("fold", fold)
    m, rows = len(probs), scratch(own)
    sketches = scratch(rows.groupBy("__f").agg(F.count("*").alias("__m"), _sketch()))
    merged = sketches.withColumn(fold, F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda i: i != F.col("__f")))).groupBy(fold).agg(F.sum("__m").alias("__m"), F.kll_merge_agg_double("__s").alias("__s"))
    ks = F.array(*[f(p * (F.col("__m") - 1)).cast("long") for p in probs for f in (F.floor, F.ceil)])
    state = merged.select(fold, "__m", ks.alias("__k"), _steps())
    state = {r[fold]: r for r in state.select(fold, "__m", "__k", *_brackets(state, m)).collect()}  # a row for each fold
    if not state:
        return rows.sparkSession.createDataFrame([], f"`{fold}` int, q array<double>, n long")
    bucket = {i: _bucket(*(F.array(*[F.lit(x) for x in r[c]]).cast("array<double>") for c in ("__lo", "__hi")), m) for i, r in state.items()}
    tally = rows.agg(*[F.count_if(other[i] & (bucket[i] == b)).alias(f"c{i}_{b}") for i in state for b in range(2 * m + 1)]).first()
    held, kept = [], {}
    for i, r in state.items():
        before = 0
        for b in range(2 * m + 1):
            n = tally[f"c{i}_{b}"]
            inside = [k - before if before <= k < before + n else None for k in r["__k"]]
            if any(k is not None for k in inside):
                held.append((i, b, n, r["__m"], inside))
                kept.setdefault(i, []).append(b)
            before += n
    hits = F.array(*[F.when(other[i] & bucket[i].isin(*kept[i]), F.struct(F.lit(i).alias(fold), bucket[i].cast("long").alias("__g"))) for i in state])
    near = rows.select("__v", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("x")).select(f"x.{fold}", "x.__g", "__v")
    near, keys = scratch(near), [fold, "__g"]
    wanted = rows.sparkSession.createDataFrame(held, f"`{fold}` int, __g long, __m long, __n long, __k array<long>")
    return _in_rounds(near, [fold], near.groupBy(*keys).agg(_sketch()).select(*keys, _steps()).join(wanted, keys), probs)
