"""Normal, chi-square, t and F distributions, from the incomplete gamma and beta functions."""

from __future__ import annotations

import math
from statistics import NormalDist

_NORMAL = NormalDist()


def _gamma_p(a: float, x: float) -> float:
    """Regularized lower incomplete gamma function: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 0.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-17:
            n += 1
            term *= x / n
            total += term
        return min(1.0, total * scale)
    return 1 - _gamma_fraction(a, x) * scale


def _gamma_fraction(a: float, x: float) -> float:
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return h


def _gamma_q(a: float, x: float) -> float:
    if x < a + 1:
        return 1 - _gamma_p(a, x)
    return _gamma_fraction(a, x) * math.exp(a * math.log(x) - x - math.lgamma(a))


def _beta_fraction(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 100_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or 1e-300)
            c = 1 + top / c or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def normal_sf(x: float) -> float:
    return math.erfc(x / math.sqrt(2)) / 2


def normal_ppf(p: float) -> float:
    return _NORMAL.inv_cdf(p)


def chi2_sf(x: float, df: float) -> float:
    return math.nan if not df > 0 or math.isnan(x) else 1.0 if x <= 0 else _gamma_q(df / 2, x / 2)


def f_sf(x: float, d1: float, d2: float) -> float:
    if not (d1 > 0 and d2 > 0) or math.isnan(x):
        return math.nan
    return 1.0 if x <= 0 else beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * x))


def t_sf(x: float, df: float) -> float:
    if not df > 0 or math.isnan(x):
        return math.nan
    tail = beta_inc(df / 2, 0.5, df / (df + x * x)) / 2
    return tail if x >= 0 else 1 - tail


def _bisect(sf, p: float, lo: float, hi: float) -> float:
    """The x at which sf(x) = 1 - p, for a falling sf."""
    while sf(hi) > 1 - p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        if mid in (lo, hi):
            break
        lo, hi = (mid, hi) if sf(mid) > 1 - p else (lo, mid)
    return (lo + hi) / 2


def t_ppf(p: float, df: float) -> float:
    if not df > 0:
        return math.nan
    return -t_ppf(1 - p, df) if p < 0.5 else _bisect(lambda x: t_sf(x, df), p, 0.0, 10.0)


def chi2_ppf(p: float, df: float) -> float:
    return _bisect(lambda x: chi2_sf(x, df), p, 0.0, df + 10.0)


def f_ppf(p: float, d1: float, d2: float) -> float:
    return _bisect(lambda x: f_sf(x, d1, d2), p, 0.0, 10.0)
