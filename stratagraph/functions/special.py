"""Tail probabilities as column expressions, in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_tail(z: Column) -> Column:
    """Probability above ``z`` (not negative) of the standard normal law, within 7.5e-8 (Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * z)
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * series


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation over ``n`` points, by Student's t with n - 2 degrees of freedom.

    The law of whole degrees is a finite sum (Abramowitz and Stegun 26.7.3, 26.7.4): with sin of the angle equal to ``|r|`` and
    cos squared 1 - r squared, each term is the one before times cos squared and a fraction. Null under three points or without r;
    0 where all points lie on a line.
    """
    df, s = n - 2, F.least(F.abs(r), F.lit(1.0))
    c2 = 1 - s * s
    odd = df % 2 == 1
    # even: 1, 1/2, 3/8, ...; odd: cos, 2/3 cos^3, ...
    first = F.when(odd, F.sqrt(c2)).otherwise(F.lit(1.0))
    ratio = lambda k: F.when(odd, 2 * k / (2 * k + 1)).otherwise((2 * k - 1) / (2 * k))
    many = F.when(odd, (df - 1) / 2).otherwise(df / 2).cast("int")
    zero = F.struct(F.lit(0.0).alias("sum"), first.alias("term"))
    whole = F.aggregate(F.when(many > 0, F.sequence(F.lit(1), many)).otherwise(F.array().cast("array<int>")), zero, lambda a, k: F.struct((a["sum"] + a["term"]).alias("sum"), (a["term"] * c2 * ratio(k)).alias("term")))["sum"]
    inside = F.when(odd, 2 / math.pi * (F.asin(s) + s * whole)).otherwise(s * whole)
    return F.when(r.isNull() | (n < 3), None).when(s >= 1, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - inside))
