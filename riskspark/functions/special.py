"""Special functions in numpy, for pandas functions: no builtin has them."""

from __future__ import annotations

import math

import numpy as np


def betainc(a: float, b: float, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction, turned to the side where it converges fast."""
    x = np.asarray(x, float)
    flip = x > (a + 1) / (a + b + 2)

    def part(p: float, q: float, z: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            front = np.exp(math.lgamma(p + q) - math.lgamma(p) - math.lgamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
        tiny = 1e-300
        c, d = np.ones_like(z), 1 / np.where(np.abs(1 - (p + q) * z / (p + 1)) < tiny, tiny, 1 - (p + q) * z / (p + 1))
        h = d.copy()
        for m in range(1, 200):
            before = h
            for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + num / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                h = h * d * c
            if np.allclose(h, before, rtol=1e-15, atol=0):
                break
        return front * h

    z = np.where(flip, 1 - x, x)
    inside = np.where(flip, 1 - part(b, a, z), part(a, b, z))
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, inside))


def t_cdf(x: np.ndarray, nu: float) -> np.ndarray:
    x = np.asarray(x, float)
    half = 0.5 * betainc(nu / 2, 0.5, nu / (nu + x * x))
    return np.where(x > 0, 1 - half, half)


def t_ppf(p: np.ndarray, nu: float) -> np.ndarray:
    """By bisection on a bracket that doubles until it holds the quantile."""
    p = np.asarray(p, float)
    hi = np.ones_like(p)
    while ((t_cdf(hi, nu) < np.maximum(p, 1 - p)) & (hi < 1e12)).any():
        hi = np.where(t_cdf(hi, nu) < np.maximum(p, 1 - p), hi * 2, hi)
    lo = -hi
    for _ in range(80):
        mid = (lo + hi) / 2
        below = t_cdf(mid, nu) < p
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2


def chi2_sf(x: np.ndarray) -> np.ndarray:
    """With one degree of freedom."""
    return np.vectorize(lambda v: math.erfc(math.sqrt(max(v, 0.0) / 2)), otypes=[float])(x)


def ks_sf(d: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Limiting p-value of the Kolmogorov-Smirnov distance, with Stephens's correction of the sample size."""
    z = (np.sqrt(n) + 0.12 + 0.11 / np.sqrt(n)) * d
    k = np.arange(1, 101)
    series = 2 * (np.where(k % 2, 1.0, -1.0) * np.exp(-2 * np.outer(np.atleast_1d(z) ** 2, k**2))).sum(axis=1)
    return np.where(np.atleast_1d(z) < 0.2, 1.0, np.clip(series, 0, 1))
