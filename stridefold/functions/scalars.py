"""Scalar statistics, as columns where they run on rows and in Python where they close a report."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def number(value: float) -> Column:
    return F.lit(value).cast("double")


def ratio(a: Column, b: Column, floor: float, otherwise: float) -> Column:
    """a / b, or ``otherwise`` where b is null or below ``floor`` (ANSI mode raises on division by zero)."""
    return F.when(b.isNull() | F.isnan(b) | (b < floor), number(otherwise)).otherwise(F.try_divide(a, b))


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != INF)


def finite_mean(c: Column) -> Column:
    """Mean over finite values; NaN where there is none."""
    return F.coalesce(F.avg(F.when(is_finite(c), c)), number(NAN))


def fisher_half(p: Column) -> Column:
    """Half of Fisher's statistic of a group of p-values, -sum ln p; ``even_chi2_tail`` of it and their number is the combined p."""
    return -F.sum(F.ln(F.least(F.greatest(p, number(1e-300)), number(1 - 1e-10))))


def even_chi2_tail(half: Column, k: Column) -> Column:
    """P(chi-squared with 2k degrees > 2 * half) = exp(-half) * sum over i < k of half**i / i!."""
    start = F.struct(number(0.0).alias("term"), number(0.0).alias("top"), number(1.0).alias("total"))

    def add(acc: Column, i: Column) -> Column:
        term = acc.term + F.ln(F.greatest(half, number(1e-300))) - F.ln(i.cast("double"))
        top = F.greatest(acc.top, term)
        return F.struct(term.alias("term"), top.alias("top"), (acc.total * F.exp(acc.top - top) + F.exp(term - top)).alias("total"))

    steps = F.filter(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1).cast("long"))), lambda i: i < k)
    return F.aggregate(steps, start, add, lambda acc: F.least(number(1.0), F.exp(acc.top + F.ln(acc.total) - half)))


def chi2_tail(x: float, df: int) -> float:
    """The same tail in Python; df must be even."""
    half, terms, term = x / 2, [0.0], 0.0
    for i in range(1, df // 2):
        term += math.log(max(half, 1e-300)) - math.log(i)
        terms.append(term)
    top = max(terms)
    return min(1.0, math.exp(top + math.log(sum(math.exp(t - top) for t in terms)) - half))


def student_two_sided(t: float, df: int) -> float:
    """Two-sided p of Student's t with whole degrees of freedom, by the finite series of Abramowitz and Stegun 26.7.3-4."""
    if math.isnan(t) or df < 1:
        return NAN
    if math.isinf(t):
        return 0.0
    angle = math.atan2(abs(t), math.sqrt(df))
    c, s = math.cos(angle), math.sin(angle)
    if df % 2:
        total, term = 0.0, c
        for i in range(1, df, 2):
            total += term
            term *= c * c * (i + 1) / (i + 2)
        inside = 2 / math.pi * (angle + s * total)
    else:
        total, term = 0.0, 1.0
        for i in range(0, df, 2):
            total += term
            term *= c * c * (i + 1) / (i + 2)
        inside = s * total
    return min(1.0, max(0.0, 1 - inside))


def student_p(t: Column, df: Column) -> Column:
    """``student_two_sided`` as a column, for tables of tests."""
    angle = F.atan2(F.abs(t), F.sqrt(df.cast("double")))
    c2, s = F.pow(F.cos(angle), 2), F.sin(angle)
    odd = df % 2 == 1
    start = F.struct(number(0.0).alias("total"), F.when(odd, F.cos(angle)).otherwise(number(1.0)).alias("term"))
    steps = F.filter(F.sequence(F.lit(0).cast("long"), F.greatest(df, F.lit(0).cast("long"))), lambda i: (i < df) & (i % 2 == F.when(odd, 1).otherwise(0)))
    total = F.aggregate(steps, start, lambda a, i: F.struct((a.total + a.term).alias("total"), (a.term * c2 * (i + 1) / (i + 2)).alias("term")), lambda a: a.total)
    inside = F.when(odd, number(2 / math.pi) * (angle + s * total)).otherwise(s * total)
    return F.when(df < 1, number(NAN)).otherwise(F.least(number(1.0), F.greatest(number(0.0), 1 - inside)))
