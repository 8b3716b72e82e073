"""Relations between columns: rank correlation, binned-median trends, driver tables."""

from __future__ import annotations

import json
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.tables import scratch
from .rank import quantiles, rank_table


def spearman_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(a, b, rho, n) for the upper triangle and the diagonal, over rows where both are known; a null rho where there are none.

    Rows are told apart by which columns they have. Where the complete rows of
    several pairs are the same set, a column is ranked once for all of them; a
    row's ranks are then one vector, and one aggregate over the vectors gives
    every pair. Without nulls that is one ranking for each column. The driver
    gets the distinct patterns, at most ``2 ** len(cols)``. Up to 63 columns.
    """
    m = len(cols)
    if m > 63:
        raise ValueError("patterns of known columns are kept in 63 bits")
    value = [F.when(~F.isnan(c), c) for c in (F.col(f"`{c}`").cast("double") for c in cols)]
    bits = sum((F.when(c.isNotNull(), F.lit(1 << i).cast("long")).otherwise(0) for i, c in enumerate(value)), F.lit(0).cast("long"))
    rows = scratch(df.select(F.monotonically_increasing_id().alias("row"), bits.alias("bits"), *[c.alias(f"v{i}") for i, c in enumerate(value)]))
    patterns = {r["bits"]: r["count"] for r in rows.groupBy("bits").count().collect()}
    complete = lambda *of: frozenset(p for p in patterns if all(p >> i & 1 for i in of))
    ranked: dict[tuple[int, frozenset], int] = {}  # (column, patterns) -> number of the ranking
    needs, pairs = [], []
    for i, j in combinations(range(m), 2):
        if not (own := complete(i, j)):
            continue
        for c in (i, j):
            if (c, own) not in ranked:
                ranked[c, own] = len(ranked)
                needs.append((c, i, j))
        pairs.append((i, j, ranked[i, own], ranked[j, own], sum(patterns[p] for p in own)))
    out = [(cols[i], cols[i], 1.0 if complete(i) else None, sum(patterns[p] for p in complete(i))) for i in range(m)]
    found = {(i, j) for i, j, *_ in pairs}
    out += [(cols[i], cols[j], None, 0) for i, j in combinations(range(m), 2) if (i, j) not in found]
    fixed = _literal(df, [dict(zip(("a", "b", "rho", "n"), r)) for r in out], "a string, b string, rho double, n long")
    if not pairs:
        return fixed
    # one expression each, since a plan of many small calls takes longer to build than small tables to read
    entries = ", ".join(f"IF(bits & {1 << i | 1 << j}L = {1 << i | 1 << j}L, struct({k} AS k, v{c} AS v), NULL)" for k, (c, i, j) in enumerate(needs))
    tall = rows.select("row", F.expr(f"inline(filter(array({entries}), e -> e IS NOT NULL))"))
    places = tall.join(rank_table(tall, ["k"], "v", "rank"), ["k", "v"])
    vectors = places.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("k", "rank"))).alias("of"))
    both = ", ".join(f"struct({p} AS p, of[{x}] AS x, of[{y}] AS y)" for p, (_, _, x, y, _) in enumerate(pairs))
    got = vectors.select(F.expr(f"inline(array({both}))")).where("x is not null and y is not null").groupBy("p").agg(F.corr("x", "y").alias("rho"))
    named = _literal(df, [{"p": p, "a": cols[i], "b": cols[j], "n": n} for p, (i, j, _, _, n) in enumerate(pairs)], "p int, a string, b string, n long")
    return named.join(got, "p", "left").select("a", "b", "rho", "n").unionByName(fixed)


def _literal(df: DataFrame, rows: list[dict], fields: str) -> DataFrame:
    """A few rows as a literal, which Spark plans as such."""
    return df.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), "array<struct<" + ",".join(f.strip().replace(" ", ":") for f in fields.split(",")) + ">>")))


def driver_points(df: DataFrame, drivers: Sequence[str], y: str, third: str) -> DataFrame:
    """(driver, x, y, third) rows without nulls."""
    rows = F.array(*[F.struct(F.lit(d).alias("driver"), F.col(d).cast("double").alias("x")) for d in drivers])
    return df.select(F.explode(rows).alias("p"), F.col(y).alias("y"), F.col(third).cast("double").alias("third")).select("p.*", "y", "third").na.drop("any")


def binned_median_trend(points: DataFrame, bins: int = 10, min_n: int = 3, accuracy: int | None = None) -> DataFrame:
    """(driver, bin, cx, cy, n): medians between the quantile edges of each driver's x.

    Bins are closed on both sides, so a value on an inner edge counts twice.
    The edges are parameters (an array for each driver), so each row looks its
    bins up in an array; nothing is joined.
    """
    points = scratch(points.select("driver", "x", "y"))
    edges = {r["driver"]: r["q"] for r in quantiles(points, ["driver"], "x", [i / bins for i in range(bins + 1)], accuracy).collect()}
    own = F.lit(None).cast("array<double>")
    for driver, e in edges.items():
        own = F.when(F.col("driver") == driver, F.array(*map(F.lit, e))).otherwise(own)

    def found(e: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: (F.get(e, i) <= F.col("x")) & (F.col("x") <= F.get(e, i + 1)))

    inside = points.withColumn("e", own).where("e is not null").select("driver", F.explode(found(F.col("e"))).alias("bin"), "x", "y")
    both = inside.select("driver", "bin", F.explode(F.array(F.struct(F.lit("cx").alias("of"), F.col("x").alias("v")), F.struct(F.lit("cy").alias("of"), F.col("y").alias("v")))).alias("p")).select("driver", "bin", "p.*")
    mid = quantiles(both, ["driver", "bin", "of"], "v", [0.5], accuracy).where(F.col("n") >= min_n)
    side = lambda of: F.max(F.when(F.col("of") == of, F.col("q")[0])).alias(of)
    return mid.groupBy("driver", "bin").agg(side("cx"), side("cy"), F.max("n").alias("n"))
