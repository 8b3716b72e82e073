"""Scalar expressions; all stay inside generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def interpolate(t0, r0, t1, r1, level) -> Column:
    """Where the line through two points reaches ``level``; the first time on a flat segment."""
    return F.when(r1 == r0, t0).otherwise(t0 + (level - r0) * (t1 - t0) / (r1 - r0))


def over_max(t: Column, tmax: Column) -> Column:
    return F.when(tmax > 0, t / tmax).otherwise(t)


def min_max(t: Column, lo: Column, hi: Column) -> Column:
    return F.when(hi > lo, (t - lo) / (hi - lo))


def floor_zero(t: Column, least: float = 0.05) -> Column:
    return F.when(t == 0, least).otherwise(t)


def clip(r: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.when(r.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), r)))


def replace_all(c: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def ellipsis(c: Column, most: int = 27) -> Column:
    """Longer texts keep ``most - 1`` characters and get an ellipsis."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 1), F.lit("…"))).otherwise(c)


def key_label(mw: Column, logp: Column) -> Column:
    """``MW{int}/LogP{one digit}``; half-way values round as format_number does."""
    return F.concat(F.lit("MW"), mw.cast("int").cast("string"), F.lit("/LogP"), F.replace(F.format_number(logp, 1), F.lit(","), F.lit("")))


def curve_label(key: Column, name: Column) -> Column:
    """``#key``, and the name after a dot where it is known."""
    return F.concat(F.lit("#"), key.cast("string"), F.coalesce(F.concat(F.lit(" · "), name), F.lit("")))


def bracketed(c: Column) -> Column:
    return F.regexp_extract(c, r"\[(\w+)\]", 1)


def triangular(x: Column, knots: Sequence[float]) -> list[Column]:
    """Memberships of ``x`` in sets that peak at the knots.

    Between two knots one falls and the next rises; outside, the end sets
    are 1. Equal knots make an empty segment, so the sum is always 1. Null
    stays null.
    """
    n = len(knots)
    out = [F.when(x < knots[0], 1.0 if j == 0 else 0.0) for j in range(n)]
    for i in range(n - 1):
        if knots[i + 1] > knots[i]:
            u = (x - knots[i]) / (knots[i + 1] - knots[i])
            inside = (x >= knots[i]) & (x < knots[i + 1])
            out = [c.when(inside, 1 - u if j == i else u if j == i + 1 else F.lit(0.0)) for j, c in enumerate(out)]
    return [c.when(x >= knots[-1], 1.0 if j == n - 1 else 0.0) for j, c in enumerate(out)]


def trapezoidal(x: Column, a: float, b: float, c: float, d: float) -> Column:
    """0 outside (a, d), 1 on [b, c], linear between."""
    return F.when((x < a) | (x > d), 0.0).when((x >= b) & (x <= c), 1.0).when(x < b, (x - a) / (b - a) if b > a else F.lit(1.0)).when(x > c, (d - x) / (d - c) if d > c else F.lit(1.0))


def gaussian(x: Column, centre: float, width: float) -> Column:
    return F.exp(-0.5 * F.pow((x - centre) / width, 2))


def dominant(memberships: Sequence[Column], labels: Sequence[str]) -> Column:
    """The label of the largest membership, the first one on ties."""
    top = F.greatest(*memberships)
    out = F.when(top.isNull(), None)
    for m, label in zip(memberships, labels):
        out = out.when(m == top, label)
    return out
