"""Distribution functions without scipy, as plain Python for the few rows that an aggregation leaves."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function, by series or continued fraction."""
    if x <= 0:
        return 0.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return total * front
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        k = -i * (i - a)
        b += 2
        d = 1 / (k * d + b or tiny)
        c = b + k / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - front * h


def chi2_sf(x: float, dof: float) -> float:
    """P(X > x) of the chi-squared distribution."""
    return 1 - gamma_p(dof / 2, x / 2)


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 10_000):
        k = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1 / (1 + k * d or tiny)
        c = 1 + k / c or tiny
        h *= d * c
        k = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + k * d or tiny)
        c = 1 + k / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def t_sf2(t: float, dof: float) -> float:
    """Two-sided p of Student's t."""
    return beta_i(dof / 2, 0.5, dof / (dof + t * t)) if dof > 0 else float("nan")


def fisher_greater(a: int, b: int, c: int, d: int) -> float:
    """One-sided (greater) Fisher exact p of a 2 x 2 table."""
    def lc(n, k):
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    row, col, n = a + b, a + c, a + b + c + d
    return min(1.0, sum(math.exp(lc(col, k) + lc(n - col, row - k) - lc(n, row)) for k in range(a, min(row, col) + 1) if row - k <= n - col))


def normal_quantile(p: float) -> float:
    """Inverse normal CDF by bisection on the CDF."""
    low, high = -40.0, 40.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if normal_cdf(mid) < p else (low, mid)
    return (low + high) / 2


def udf(function, kind: str = "double"):
    """A function of few, aggregated rows as a column function."""
    return F.udf(lambda *x: None if any(v is None for v in x) else function(*x), kind)


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Wilson interval of k successes in n, clamped to [0, 1]; n = 0: [0, 0]."""
    p = k / n
    mid, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    low, high = (mid - half) / (1 + z * z / n), (mid + half) / (1 + z * z / n)
    none = n == 0
    return F.when(none, 0.0).otherwise(F.greatest(F.lit(0.0), low)), F.when(none, 0.0).otherwise(F.least(F.lit(1.0), high))


def sample_size(base: float, effect: float, power: float = 0.8, alpha: float = 0.05) -> int:
    """Rows per variant to detect base -> base + effect."""
    p2 = base + effect
    mid = (base + p2) / 2
    za, zb = normal_quantile(1 - alpha / 2), normal_quantile(power)
    return math.ceil((za * math.sqrt(2 * mid * (1 - mid)) + zb * math.sqrt(base * (1 - base) + p2 * (1 - p2))) ** 2 / effect**2)
