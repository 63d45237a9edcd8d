"""Scalar and aggregate expressions: guarded ratios, Wilson bounds, moments, and a few distribution tails."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-9


def if_positive(guard: Column, value: Column) -> Column:
    """``value`` where ``guard`` is above rounding noise, else 0."""
    return F.when(F.coalesce(guard, F.lit(0.0)) > TINY, value).otherwise(0.0)


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """(low, high) in percent of a proportion's score interval."""
    p = k / F.nullif(n, F.lit(0))
    scale = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / scale
    reach = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    return F.greatest(F.lit(0.0), (mid - reach) * 100), F.least(F.lit(100.0), (mid + reach) * 100)


def unbiased_skew(x: str) -> Column:
    n = F.count(x)
    return F.skewness(x) * F.sqrt(n * (n - 1.0)) / F.nullif(n - 2, F.lit(0))


def unbiased_kurtosis(x: str) -> Column:
    n = F.count(x)
    return (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0)) * ((n + 1) * F.kurtosis(x) + 6)


def finite(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    h = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + top * d) or tiny)
            c = (1 + top / c) or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, dof: float) -> float:
    return incomplete_beta(dof / 2, 0.5, dof / (dof + t * t))


def chi2_tail(x: float, dof: float) -> float:
    """Upper tail, by the series or the continued fraction of the incomplete gamma function."""
    a, x = dof / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def t_p_value(t: Column, dof: Column) -> Column:
    """Two-sided p by a small vectorised function: one value per bucket, after aggregation."""

    @F.pandas_udf("double")
    def p(ts: pd.Series, ds: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or pd.isna(b) or b < 1 else t_two_sided(a, b) for a, b in zip(ts, ds, strict=True)], dtype="float64")

    return p(t, dof)


def chi2_p_value(x: Column, dof: Column) -> Column:
    @F.pandas_udf("double")
    def p(xs: pd.Series, ds: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or pd.isna(b) or b < 1 else chi2_tail(a, b) for a, b in zip(xs, ds, strict=True)], dtype="float64")

    return p(x, dof)


def chi2_tail_even(x: Column, dof: int) -> Column:
    """Closed form for an even number of degrees: stays an expression."""
    half, terms, term = x / 2, F.lit(0.0), F.lit(1.0)
    for i in range(dof // 2):
        terms = terms + term
        term = term * half / (i + 1)
    return F.exp(-half) * terms


def stars(p: Column) -> Column:
    return F.when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def badge(p: Column) -> Column:
    return F.when(p < 0.01, "p<0.01").when(p < 0.05, "p<0.05").when(p < 0.10, "p<0.10").otherwise("none")
