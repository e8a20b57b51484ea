"""Distribution functions of test statistics, for a few numbers on the driver.

Upper tails are computed as such, so small p-values keep their digits.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

#: The two-sided 95 % point of the normal distribution.
Z95 = NormalDist().inv_cdf(0.975)


def _continued(step: Callable[[int], tuple[float, float]], first: float) -> float:
    """first + a1/(b1 + a2/(b2 + ...)) by Lentz's method."""
    tiny = 1e-300
    f = c = first or tiny
    d = 0.0
    for i in range(1, 10_000):
        a, b = step(i)
        d = 1 / ((b + a * d) or tiny)
        c = (b + a / c) or tiny
        f *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return f


def gamma_tails(a: float, x: float) -> tuple[float, float]:
    """Lower and upper regularised incomplete gamma function."""
    if x <= 0:
        return 0.0, 1.0
    if math.isinf(x):
        return 1.0, 0.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-17:
            n += 1
            term *= x / n
            total += term
        return min(1.0, scale * total), max(0.0, 1 - scale * total)
    upper = scale / _continued(lambda i: (-i * (i - a), x + 2 * i + 1 - a), x + 1 - a)
    return 1 - upper, upper


def beta_tails(a: float, b: float, x: float, y: float | None = None) -> tuple[float, float]:
    """Lower and upper regularised incomplete beta function at x; y is 1 - x, if it is known more closely."""
    y = 1 - x if y is None else y
    if x <= 0:
        return 0.0, 1.0
    if y <= 0:
        return 1.0, 0.0
    if x > (a + 1) / (a + b + 2):
        low, up = beta_tails(b, a, y, x)
        return up, low
    scale = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(y)) / a

    def step(i: int) -> tuple[float, float]:
        m = i // 2
        return (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))), 1.0

    low = scale / _continued(step, 1.0)
    return low, 1 - low


def normal_cdf(z: float) -> float:
    return math.erfc(-z / math.sqrt(2)) / 2


def normal_pdf(z: float) -> float:
    return math.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def normal_p(z: float) -> float:
    """Two-sided."""
    return math.erfc(abs(z) / math.sqrt(2)) if not math.isnan(z) else math.nan


def t_p(t: float, df: float) -> float:
    """Two-sided."""
    if math.isnan(t) or df <= 0:
        return math.nan
    if math.isinf(t):
        return 0.0
    return beta_tails(df / 2, 0.5, df / (df + t * t), t * t / (df + t * t))[0]


def t_cdf(t: float, df: float) -> float:
    return 1 - t_p(t, df) / 2 if t > 0 else t_p(t, df) / 2


def f_upper(f: float, d1: float, d2: float) -> float:
    if math.isnan(f):
        return math.nan
    return 1.0 if f <= 0 else beta_tails(d2 / 2, d1 / 2, d2 / (d2 + d1 * f), d1 * f / (d2 + d1 * f))[0]


def chi2_upper(x: float, df: float) -> float:
    return math.nan if math.isnan(x) else gamma_tails(df / 2, x / 2)[1]


def _inverse(upper: Callable[[float], float], q: float, low: float, high: float) -> float:
    """Where a falling function reaches q."""
    while upper(high) > q:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if upper(mid) > q else (low, mid)
        if high - low <= 1e-15 * max(1.0, abs(high)):
            break
    return (low + high) / 2


def t_quantile(p: float, df: float) -> float:
    if p < 0.5:
        return -t_quantile(1 - p, df)
    return 0.0 if p == 0.5 else _inverse(lambda t: t_p(t, df) / 2, 1 - p, 0.0, 2.0)


def f_quantile(p: float, d1: float, d2: float) -> float:
    return _inverse(lambda f: f_upper(f, d1, d2), 1 - p, 0.0, 2.0)


def chi2_quantile(p: float, df: float) -> float:
    return _inverse(lambda x: chi2_upper(x, df), 1 - p, 0.0, 2.0)
