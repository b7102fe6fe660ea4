"""Distribution functions in plain Python, and as vectorised UDFs where a plan needs them.

Series and continued fractions are the textbook ones for the incomplete gamma and beta functions; inverses
are found by bracketed Newton steps on the forward functions.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

_EPS = 1e-16
_NORMAL = NormalDist()


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def norm_sf(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2))


def norm_pdf(x):
    return np.exp(-0.5 * np.square(x)) / math.sqrt(2 * math.pi)


def norm_ppf(p: float) -> float:
    if p <= 0 or p >= 1:
        return -math.inf if p == 0 else math.inf if p == 1 else math.nan
    x = _NORMAL.inv_cdf(p)
    for _ in range(2):
        x -= (norm_cdf(x) - p) / float(norm_pdf(x)) if norm_pdf(x) > 0 else 0
    return x


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    if math.isinf(x):
        return 0.0
    head = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * _EPS:
            k += 1
            term *= x / k
            total += term
        return 1 - head * total
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < _EPS * 4:
            break
    return head * h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    head = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d)
            c = 1 + num / c
            h *= c * d
        if abs(c * d - 1) < _EPS * 4:
            break
    return head * h / a


def chi2_sf(x: float, df: float) -> float:
    return math.nan if math.isnan(x) else gamma_q(df / 2, x / 2)


def f_sf(x: float, d1: float, d2: float) -> float:
    return math.nan if math.isnan(x) else 1.0 if x <= 0 else beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * x))


def t_sf(x: float, df: float) -> float:
    """P(T > x)."""
    tail = 0.5 * t_two_sided(x, df)
    return tail if x >= 0 else 1 - tail


def t_two_sided(x: float, df: float) -> float:
    """P(|T| > |x|), from whichever argument is not close to 1."""
    return 1 - beta_inc(0.5, df / 2, x * x / (df + x * x)) if x * x < df else beta_inc(df / 2, 0.5, df / (df + x * x))


def t_cdf(x: float, df: float) -> float:
    return t_sf(-x, df)


def t_ppf(p: float, df: float) -> float:
    return _invert(lambda x: t_cdf(x, df), p, -1e8, 1e8)


def chi2_ppf(p: float, df: float) -> float:
    return _invert(lambda x: 1 - chi2_sf(x, df), p, 0.0, 1e8)


def _invert(cdf, p: float, low: float, high: float) -> float:
    if not 0 < p < 1:
        return low if p == 0 else high if p == 1 else math.nan
    for _ in range(300):
        mid = (low + high) / 2
        if cdf(mid) < p:
            low = mid
        else:
            high = mid
        if high - low <= 1e-14 * max(1.0, abs(mid)):
            break
    return (low + high) / 2


def column(function, *args):
    """A Spark column of one of these functions of one to three numbers; batches arrive as Arrow."""
    import pandas as pd
    from pyspark.sql import functions as F
    from pyspark.sql.pandas.functions import PandasUDFType

    def run(*columns):
        return pd.Series([None if any(v is None or v != v for v in row) else function(*map(float, row)) for row in zip(*columns, strict=True)], dtype="float64")

    return F.pandas_udf(run, "double", PandasUDFType.SCALAR)(*args)
