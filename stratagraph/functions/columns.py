"""Scalar functions as column expressions; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Multiplier, increment and modulus of the generator behind ``uniform``; fixed values that SQL repeats.
A, C, M = 1103515245, 12345, 2147483648
FOLD = 7919


def sigmoid(x: Column) -> Column:
    """1 / (1 + e**-x) with x held within -50 and 50."""
    return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(50.0)), F.lit(-50.0))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / ((norm(a) + 1e-12) * (norm(b) + 1e-12))


def normalised(a: Column) -> Column:
    """A vector over its L2 norm; one of nearly no length stays."""
    n = F.when(norm(a) < 1e-8, 1.0).otherwise(norm(a))
    return F.transform(a, lambda x: x / n)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def sub(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def mul(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def uniform(i: Column) -> Column:
    """A number in [0, 1) from a whole number that is not negative; two steps of a linear congruential generator.

    What exceeds the modulus is folded in first, so that large numbers neither overflow nor meet small ones.
    """
    i = i.cast("long")
    folded = (i % M + FOLD * F.shiftright(i, 31)) % M
    one = (folded * A + C) % M
    return ((one * A + C) % M) / F.lit(float(M))


def overlaps(lo: Column, hi: Column, lo2: Column, hi2: Column) -> Column:
    """Closed intervals that share a point."""
    return (lo <= hi2) & (hi >= lo2)


def valid_at(tb: Column, te: Column, tau: Column | int) -> Column:
    """A dated fact holds at tau; one without a begin never does."""
    t = F.lit(tau) if isinstance(tau, int) else tau
    return tb.isNotNull() & (tb <= t) & (te.isNull() | (te >= t))


def mapped(value: Column, season: Column | None = None) -> Column:
    """The season's entry of a map, or the mean of its entries if no season is given."""
    if season is not None:
        return F.element_at(value, season)
    return F.aggregate(F.map_values(value), F.lit(0.0), lambda s, x: s + x) / F.size(value)
