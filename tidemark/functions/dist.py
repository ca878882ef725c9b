"""Tail probabilities that Spark has no function for: normal, Student t and F, and the power of a t-test.

Applied to one row a test, never to data rows: vectorised pandas UDFs around an incomplete beta function (continued
fraction) and an error function (series of the incomplete gamma function).
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    if not (a > 0 and b > 0) or math.isnan(x):
        return math.nan
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(500):
        m = i // 2
        k = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / (1.0 + k * d or tiny)
        c = 1.0 + k / c or tiny
        f *= c * d
        if abs(c * d - 1.0) < 1e-14:
            break
    return front * (f - 1.0)


def _apply(f, *series: pd.Series) -> pd.Series:
    return pd.Series([math.nan if any(x is None or x != x for x in row) else f(*row) for row in zip(*series, strict=True)], dtype=float)


def t_p(t: float, df: float) -> float:
    if math.isinf(t):
        return 0.0
    return incomplete_beta(df / 2, 0.5, df / (df + t * t)) if df > 0 else math.nan


def f_p(f: float, d1: float, d2: float) -> float:
    if f <= 0:
        return 1.0
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if d1 > 0 and d2 > 0 else math.nan


def normal_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


@lru_cache(1 << 16)
def t_critical(df: float, alpha: float = 0.05) -> float:
    """The value that |t| exceeds with probability alpha. Kept, as many tests share few degrees of freedom and the bisection
    takes nearly all of a power's time."""
    low, high = 0.0, 1.0
    while t_p(high, df) > alpha:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if t_p(mid, df) > alpha else (low, mid)
    return high


def power(d: float, n: float, alpha: float = 0.05) -> float:
    """Power of a two-sided one-sample t-test with effect size d: the square of a noncentral t is a noncentral F, whose tail
    is a sum of incomplete betas with Poisson weights. The betas of consecutive terms differ by a term with a simple ratio,
    and so do the weights; terms beyond twelve deviations of the Poisson are left out."""
    if n < 2:
        return math.nan
    df, half = n - 1, d * d * n / 2
    c = t_critical(df, alpha)
    x, a = c * c / (c * c + df), df / 2
    first, last = (max(0, int(half + k * math.sqrt(half) + 3 * k)) for k in (-12, 12))
    j = np.arange(first, last + 1, dtype=float)
    weight = np.concatenate([[0.0], np.cumsum(np.log(half) - np.log(j[1:]))]) if half > 0 else np.where(j == 0, 0.0, -np.inf)
    start = first * math.log(half) - half - math.lgamma(first + 1) if half > 0 else 0.0
    # tail(j + 1) - tail(j), from its logarithm at the first term on
    b = first + 0.5
    log_step = b * math.log(x) + a * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b + 1)
    steps = np.exp(log_step + np.concatenate([[0.0], np.cumsum(math.log(x) + np.log(a + j[:-1] + 0.5) - np.log(j[:-1] + 1.5))]))
    tail = np.minimum(1.0, incomplete_beta(a, b, 1 - x) + np.concatenate([[0.0], np.cumsum(steps[:-1])]))
    return float(min(1.0, np.exp(start + weight) @ tail))


def _udf(f, *columns: Column) -> Column:
    """f over rows of one small table; NaN and null give null."""
    return F.nanvl(_vector(f, len(columns))(*(c.cast("double") for c in columns)), F.lit(None).cast("double"))


def _vector(f, n: int):
    def one(a: pd.Series) -> pd.Series:
        return _apply(f, a)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return _apply(f, a, b)

    def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return _apply(f, a, b, c)

    return F.pandas_udf((one, two, three)[n - 1], "double")


def t_two_sided(t: Column, df: Column) -> Column:
    return _udf(t_p, t, df)


def f_upper(f: Column, d1: Column, d2: Column) -> Column:
    return _udf(f_p, f, d1, d2)


def normal_two_sided(z: Column) -> Column:
    return _udf(normal_p, z)


def t_power(d: Column, n: Column) -> Column:
    return _udf(power, d, n)


def poisson(uniform: np.ndarray) -> np.ndarray:
    """Poisson(1) draws from uniforms by the inverse distribution function."""
    edges = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])
    return np.searchsorted(edges, uniform, "right")
