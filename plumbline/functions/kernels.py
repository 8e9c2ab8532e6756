"""Numeric kernels in numpy: normal distribution, bivariate normal, orthants, tetrachoric correlation, projection."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np


def phi(x):
    """Standard normal distribution function."""
    x = np.asarray(x, dtype=float)
    return 0.5 * np.vectorize(math.erfc, otypes=[float])(-x / math.sqrt(2.0)) if x.size else x


def phi_inv(p):
    """Its inverse: bisection in a bracket, polished by Newton steps."""
    p = np.asarray(p, dtype=float)
    low, high = np.full(p.shape, -40.0), np.full(p.shape, 40.0)
    for _ in range(60):
        mid = (low + high) / 2
        below = phi(mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    x = (low + high) / 2
    return np.where(p <= 0, -np.inf, np.where(p >= 1, np.inf, x))


@lru_cache(maxsize=4)
def _legendre(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.polynomial.legendre.leggauss(n)


def bivariate_cdf(a: float, b: float, rho: float) -> float:
    """P(X < a, Y < b) of a standard bivariate normal: integral of the density's derivative over the correlation's angle."""
    rho = min(max(rho, -0.999999), 0.999999)
    nodes, weights = _legendre(64)
    top = math.asin(rho)
    t = top * (nodes + 1) / 2
    s = np.sin(t)
    inner = np.exp((2 * a * b * s - a * a - b * b) / (2 * np.cos(t) ** 2))
    return float(phi(a) * phi(b)) + top / 2 * float((weights * inner).sum()) / (2 * math.pi)


def tetrachoric(n00: float, n01: float, n10: float, n11: float) -> float:
    """Maximum-likelihood correlation of two dichotomised normals; 0 where a margin is empty."""
    n = n00 + n01 + n10 + n11
    if n <= 0:
        return 0.0
    p1, p2 = (n10 + n11) / n, (n01 + n11) / n
    if p1 in (0.0, 1.0) or p2 in (0.0, 1.0):
        return 0.0
    a, b = float(phi_inv(p1)), float(phi_inv(p2))

    def loss(rho: float) -> float:
        q11 = min(max(bivariate_cdf(a, b, rho), 1e-12), 1.0)
        q10, q01 = max(p1 - q11, 1e-12), max(p2 - q11, 1e-12)
        q00 = max(1 - p1 - p2 + q11, 1e-12)
        return -(n11 * math.log(q11) + n10 * math.log(q10) + n01 * math.log(q01) + n00 * math.log(q00))

    low, high = -0.999, 0.999
    ratio = (math.sqrt(5) - 1) / 2
    x, y = high - ratio * (high - low), low + ratio * (high - low)
    fx, fy = loss(x), loss(y)
    for _ in range(60):
        if fx < fy:
            high, y, fy = y, x, fx
            x = high - ratio * (high - low)
            fx = loss(x)
        else:
            low, x, fx = x, y, fy
            y = low + ratio * (high - low)
            fy = loss(y)
        if high - low < 1e-7:
            break
    return (low + high) / 2


def nearest_correlation(matrix: np.ndarray, floor: float = 1e-4) -> np.ndarray:
    """A positive definite matrix with unit diagonal: eigenvalues raised to ``floor``, then rescaled."""
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    raised = vectors @ np.diag(np.maximum(values, floor)) @ vectors.T
    scale = 1 / np.sqrt(np.diag(raised))
    return raised * np.outer(scale, scale)


def _lattice(dims: int, points: int) -> np.ndarray:
    roots = np.sqrt(np.array([2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37][:dims], dtype=float))
    grid = (np.outer(np.arange(1, points + 1), roots) + 0.5) % 1.0
    return np.abs(2 * grid - 1)


def orthant(mean: np.ndarray, cov: np.ndarray, signs: np.ndarray, points: int = 4096) -> float:
    """P(sign_i * X_i > 0 for all i) of a normal vector: separated variables on a fixed lattice."""
    d = len(mean)
    if d == 0:
        return 1.0
    flipped = cov * np.outer(signs, signs)
    scale = np.sqrt(np.diag(flipped))
    upper = signs * mean / scale
    if d == 1:
        return float(phi(upper[0]))
    chol = np.linalg.cholesky(nearest_correlation(flipped / np.outer(scale, scale)))
    w = _lattice(d - 1, points)
    e = np.full(points, float(phi(upper[0] / chol[0, 0])))
    total = e.copy()
    y = np.zeros((points, d - 1))
    for i in range(1, d):
        y[:, i - 1] = _quick_inv(np.clip(w[:, i - 1] * e, 1e-15, 1 - 1e-15))
        shift = y[:, :i] @ chol[i, :i]
        e = _quick_phi((upper[i] - shift) / chol[i, i])
        total *= e
    return float(total.mean())


def _quick_phi(x: np.ndarray) -> np.ndarray:
    """Normal distribution function by interpolation in a fine table (error below 1e-9)."""
    grid, values = _table()
    return np.interp(x, grid, values)


def _quick_inv(p: np.ndarray) -> np.ndarray:
    grid, values = _table()
    return np.interp(p, values, grid)


@lru_cache(maxsize=1)
def _table() -> tuple[np.ndarray, np.ndarray]:
    grid = np.linspace(-9, 9, 40001)
    return grid, phi(grid)


def pattern_likelihood(pattern: str, mean: np.ndarray, cov: np.ndarray, points: int = 4096) -> float:
    """Probability of a pattern of 0, 1 and _ (missing: left out) under latent normals cut at 0."""
    at = [i for i, ch in enumerate(pattern) if ch != "_"]
    signs = np.array([1.0 if pattern[i] == "1" else -1.0 for i in at])
    return orthant(mean[at], cov[np.ix_(at, at)], signs, points)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 10_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + top * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + top / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            return out
    raise ArithmeticError("the fraction does not converge")


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F > f) of the F distribution."""
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def chi2_tail(x: float, k: float) -> float:
    """P(X > x) of the chi-squared distribution: the upper incomplete gamma function by series or fraction."""
    a, y = k / 2, x / 2
    if y <= 0:
        return 1.0
    front = math.exp(a * math.log(y) - y - math.lgamma(a))
    if y < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= y / n
            total += term
        return 1 - front * total
    tiny = 1e-300
    b, c = y + 1 - a, 1 / tiny
    d = 1 / b
    out = d
    for i in range(1, 10_000):
        top = -i * (i - a)
        b += 2
        d = top * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + top / c
        c = c if abs(c) > tiny else tiny
        out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * out
