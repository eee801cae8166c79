"""Distribution functions for small tables on the driver: normal tail, incomplete beta and its inverse."""

from __future__ import annotations

import math


def normal_tail(z: float) -> float:
    """Two-sided p-value."""
    return math.erfc(abs(z) / math.sqrt(2))


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(b, a, 1 - x)
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 500):
        for part in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + part * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + part / c
            c = c if abs(c) > tiny else tiny
            total *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * total / a


def beta_quantile(p: float, a: float, b: float) -> float:
    low, high = 0.0, 1.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if beta_cdf(a, b, mid) < p else (low, mid)
    return (low + high) / 2


def exact_interval(k: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """Clopper-Pearson interval of k successes in n trials."""
    tail = (1 - level) / 2
    return 0.0 if k == 0 else beta_quantile(tail, k, n - k + 1), 1.0 if k == n else beta_quantile(1 - tail, k + 1, n - k)
