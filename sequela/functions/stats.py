"""Distribution helpers for aggregated rows and small results."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np


def normal_quantile(prob: float) -> float:
    return NormalDist().inv_cdf(prob)


def two_sided_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function, by series or continued fraction."""
    if x <= 0:
        return 0.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return total * scale
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or tiny)
        c = (b + an / c) or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1.0 - scale * h


def chi2_tail(x: float, df: int) -> float:
    return 1.0 if x <= 0 else 1.0 - gamma_p(df / 2.0, x / 2.0)


def _bisect(f, lo: float, hi: float) -> float:
    for _ in range(200):
        mid = (lo + hi) / 2
        if f(mid) < 0:
            lo = mid
        else:
            hi = mid
        if hi - lo <= 1e-12 * max(1.0, hi):
            break
    return (lo + hi) / 2


def poisson_limits(events: int, conf: float = 0.95) -> tuple[float, float]:
    """Exact limits of a Poisson mean: each tail has probability (1 - conf) / 2."""
    tail = (1 - conf) / 2
    top = events + 12 * math.sqrt(events + 1) + 20
    lower = 0.0 if events == 0 else _bisect(lambda m: gamma_p(events, m) - tail, 0.0, events)
    upper = _bisect(lambda m: gamma_p(events + 1, m) - (1 - tail), events, top)
    return lower, upper


def poisson_quantiles(uniform: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Smallest count whose cumulative probability exceeds ``uniform``; 0 for mean 0.

    One cumulative table per distinct mean, over the counts that carry
    probability, so its length grows with the square root of the mean.
    """
    out = np.zeros(len(uniform), dtype=np.int64)
    for m in np.unique(mean):
        rows = mean == m
        if m <= 0:
            continue
        spread = 12 * math.sqrt(m) + 20
        lo = max(0, math.floor(m - spread))
        counts = np.arange(lo, math.ceil(m + spread) + 1)
        log_fact = math.lgamma(lo + 1) + np.concatenate(
            ([0.0], np.cumsum(np.log(counts[1:])))
        )
        cdf = np.cumsum(np.exp(counts * math.log(m) - m - log_fact))
        out[rows] = lo + np.searchsorted(cdf, uniform[rows], side="right")
    return out
