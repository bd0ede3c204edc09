"""Tail probabilities for the handful of test statistics a report holds.

Pure-Python helpers on already aggregated rows (one per feature or cluster pair).
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz evaluation of the incomplete beta continued fraction."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 1000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def gamma_sf(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0.0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1.0
            term *= x / n
            total += term
        return max(0.0, 1.0 - total * scale)
    b = x + 1.0 - a
    c, d = 1e300, 1.0 / b
    h = d
    for i in range(1, 2000):
        an = -i * (i - a)
        b += 2.0
        d = 1.0 / (an * d + b)
        c = b + an / c
        h *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return h * scale


def t_two_sided(t: float, dof: float) -> float:
    return beta_inc(dof / 2.0, 0.5, dof / (dof + t * t))


def t_upper_quantile(p: float, dof: float) -> float:
    """t with upper tail probability p (p < 0.5), by bisection."""
    low, high = 0.0, 1.0
    while t_two_sided(high, dof) / 2.0 > p:
        high *= 2.0
    for _ in range(200):
        mid = (low + high) / 2.0
        if t_two_sided(mid, dof) / 2.0 > p:
            low = mid
        else:
            high = mid
    return (low + high) / 2.0


def chi2_sf(x: float, dof: float) -> float:
    return gamma_sf(dof / 2.0, x / 2.0)


def ks_sf(d: float, n1: float, n2: float) -> float:
    """Asymptotic two-sample Kolmogorov tail."""
    z = d * math.sqrt(n1 * n2 / (n1 + n2))
    if z < 0.2:
        return 1.0
    total = sum((-1) ** (k - 1) * math.exp(-2.0 * k * k * z * z) for k in range(1, 101))
    return min(1.0, max(0.0, 2.0 * total))


def _series(fn, *args: pd.Series) -> pd.Series:
    ok = pd.concat(args, axis=1).notna().all(axis=1)
    return pd.Series(
        [fn(*(float(v) for v in row)) if good else None for good, *row in zip(ok, *args)], dtype="float64"
    )


@F.pandas_udf(DoubleType())
def t_p_value(t: pd.Series, dof: pd.Series) -> pd.Series:
    return _series(t_two_sided, t, dof)


@F.pandas_udf(DoubleType())
def chi2_p_value(x: pd.Series, dof: pd.Series) -> pd.Series:
    return _series(chi2_sf, x, dof)


@F.pandas_udf(DoubleType())
def ks_p_value(d: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    return _series(ks_sf, d, n1, n2)
