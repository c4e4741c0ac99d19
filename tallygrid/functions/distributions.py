"""Densities as columns, and tail probabilities of single test statistics.

Spark has no error function or log-gamma, so the three column functions that need
them run vectorized over Arrow batches. The tail probabilities take plain floats:
a test statistic is one number by the time it is looked up.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normal_pdf(x: Column, mu: float | Column = 0.0, sigma: float | Column = 1.0) -> Column:
    mu, sigma = _lit(mu), _lit(sigma)
    z = (x - mu) / sigma
    return F.exp(-z * z / 2) / (sigma * math.sqrt(2 * math.pi))


def _lit(v: float | Column) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def _each(fn, values: np.ndarray) -> pd.Series:
    """fn per distinct number of the batch."""
    distinct, back = np.unique(values, return_inverse=True)
    return pd.Series(np.array([fn(v) for v in distinct.tolist()], float)[back])


@F.pandas_udf(T.DoubleType())
def _normal_cdf(z: pd.Series) -> pd.Series:
    return _each(lambda v: 0.5 * math.erfc(-v / math.sqrt(2.0)), z.to_numpy(float))


@F.pandas_udf(T.DoubleType())
def _log_factorial(k: pd.Series) -> pd.Series:
    return _each(math.lgamma, np.maximum(k.to_numpy(float), 0.0) + 1.0)


def normal_cdf(x: Column, mu: float | Column = 0.0, sigma: float | Column = 1.0) -> Column:
    z = (x - _lit(mu)) / _lit(sigma)
    return F.when(z.isNotNull(), _normal_cdf(z))


def binom_pmf(k: Column, n: Column | int, p: float | Column) -> Column:
    n, p = (n if isinstance(n, Column) else F.lit(n)), _lit(p)
    log_choose = _log_factorial(n.cast("double")) - _log_factorial(k.cast("double")) - _log_factorial((n - k).cast("double"))
    term = log_choose + _xlog(k, p) + _xlog(n - k, 1 - p)
    inside = (k >= 0) & (k <= n)
    return F.when(inside, F.exp(term)).when(~inside, F.lit(0.0))


def _xlog(k: Column, p: Column) -> Column:
    """k·ln p with 0·ln 0 = 0 and ln 0 = -inf."""
    return F.when(k == 0, F.lit(0.0)).when(p <= 0, F.lit(float("-inf"))).otherwise(k * F.log(p))


def poisson_pmf(k: Column, lam: float | Column) -> Column:
    lam = _lit(lam)
    term = _xlog(k, lam) - lam - _log_factorial(k.cast("double"))
    return F.when(k >= 0, F.exp(term)).when(k < 0, F.lit(0.0))


def betainc(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta function by its continued fraction."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        for coef in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + coef * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + coef / c
            c = c if abs(c) > tiny else tiny
            step = c * d
            h *= step
        if abs(step - 1.0) < 1e-15:
            break
    return h


def gammainc_upper(a: float, x: float) -> float:
    """Regularized upper incomplete gamma function."""
    if x <= 0.0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1.0 - front * total
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1.0 / tiny, 1.0 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        step = c * d
        h *= step
        if abs(step - 1.0) < 1e-15:
            break
    return front * h


def t_two_sided(t: float, df: float) -> float:
    if math.isnan(t) or df <= 0:
        return math.nan
    return 0.0 if math.isinf(t) else betainc(df / 2, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """Upper quantile for p > 0.5 by bisection on the tail probability."""
    lo, hi = 0.0, 1e8
    target = 2 * (1 - p)
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_two_sided(mid, df) > target else (lo, mid)
    return (lo + hi) / 2


def f_tail(f: float, d1: float, d2: float) -> float:
    if math.isnan(f) or d1 <= 0 or d2 <= 0:
        return math.nan
    return 0.0 if math.isinf(f) else betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def chi2_tail(x: float, df: float) -> float:
    return math.nan if math.isnan(x) else gammainc_upper(df / 2, x / 2)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


#: 97.5 % point of the standard normal (fixed value)
Z975 = 1.959963984540054
