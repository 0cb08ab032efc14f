"""Special functions in plain Python: incomplete gamma and beta, and distributions built on them."""

from __future__ import annotations

import math


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def lower_gamma(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function: a series, or Lentz's continued fraction."""
    if x <= 0:
        return 0.0
    lead = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return lead * total
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10000):
        k = -i * (i - a)
        b += 2
        d = 1 / ((k * d + b) or tiny)
        c = (b + k / c) or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - lead * h


def beta_cdf(p: float, q: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (p + 1) / (p + q + 2):
        return 1 - beta_cdf(q, p, 1 - x)
    lead = math.exp(math.lgamma(p + q) - math.lgamma(p) - math.lgamma(q) + p * math.log(x) + q * math.log1p(-x)) / p
    tiny = 1e-300
    c, d = 1.0, 1 / ((1 - (p + q) * x / (p + 1)) or tiny)
    h = d
    for m in range(1, 10000):
        for k in (m * (q - m) * x / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * x / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 / ((1 + k * d) or tiny)
            c = (1 + k / c) or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return lead * h


def beta_quantile(p: float, q: float, share: float) -> float:
    low, high = 0.0, 1.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if beta_cdf(p, q, mid) < share else (low, mid)
    return (low + high) / 2


def chi_square_cdf(n: float, x: float) -> float:
    return lower_gamma(n / 2, x / 2)


def student_cdf(n: float, x: float) -> float:
    tail = beta_cdf(n / 2, 0.5, n / (n + x * x)) / 2
    return 1 - tail if x > 0 else tail


def student_quantile(n: float, share: float) -> float:
    low, high = -1e6, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if student_cdf(n, mid) < share else (low, mid)
    return (low + high) / 2


def fisher_cdf(n: float, m: float, x: float) -> float:
    return beta_cdf(n / 2, m / 2, n * x / (n * x + m)) if x > 0 else 0.0
