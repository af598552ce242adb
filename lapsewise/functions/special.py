"""Distribution and gamma-family functions that numpy lacks, vectorised where a caller needs it."""

from __future__ import annotations

import math

import numpy as np

lgamma = np.vectorize(math.lgamma, otypes=[float])


def _raised(x: np.ndarray, low: float, term) -> tuple[np.ndarray, np.ndarray]:
    """Shift arguments up to ``low`` by the recurrence, adding up ``term`` on the way."""
    x, extra = np.array(x, dtype=float), 0.0
    extra = np.zeros_like(x)
    while (small := x < low).any():
        extra[small] += term(x[small])
        x[small] += 1
    return x, extra


def digamma(x: np.ndarray) -> np.ndarray:
    x, extra = _raised(np.atleast_1d(x), 10.0, lambda v: -1 / v)
    u = 1 / (x * x)
    return extra + np.log(x) - 0.5 / x - u * (1 / 12 - u * (1 / 120 - u * (1 / 252 - u * (1 / 240 - u / 132))))


def trigamma(x: np.ndarray) -> np.ndarray:
    x, extra = _raised(np.atleast_1d(x), 10.0, lambda v: 1 / (v * v))
    u = 1 / (x * x)
    return extra + 1 / x + u / 2 + u / x * (1 / 6 - u * (1 / 30 - u * (1 / 42 - u * (1 / 30 - u * 5 / 66))))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def kolmogorov_upper(z: float) -> float:
    """P(K > z) of the limiting two-sided Kolmogorov distribution."""
    if z < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (j - 1) * math.exp(-2 * (j * z) ** 2) for j in range(1, 101))))


# From here on the density is a smooth peak, integrated directly; the fraction below needs ever more steps there and stops short of its tolerance.
LARGE_BETA = 3e3
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(64)
_REACH = 14.0  # standard deviations; the mass beyond is below 1e-30
_POINTS = 16_384


def _beta_peak(x: np.ndarray, a: float, b: float) -> np.ndarray:
    """Incomplete beta of large parameters: Gauss-Legendre sums over the density, from the nearer end of its peak to each argument.

    The density is taken relative to the mode and divided by its whole sum, so no gamma function of a large number is needed.
    """
    mode = (a - 1) / (a + b - 2)
    reach = _REACH * math.sqrt(a * b / (a + b + 1)) / (a + b)
    below, above = max(-reach, -mode), min(reach, 1 - mode)

    def mass(start: np.ndarray, end: np.ndarray) -> np.ndarray:
        half = (end - start) / 2
        at = (start + half)[:, None] + half[:, None] * _NODES
        return half * (np.exp((a - 1) * np.log1p(at / mode) + (b - 1) * np.log1p(-at / (1 - mode))) @ _WEIGHTS)

    low, high = mass(np.array([below, 0.0]), np.array([0.0, above]))
    flat = np.ravel(x)
    out = np.empty(len(flat))
    for i in range(0, len(flat), _POINTS):
        at = np.clip(flat[i:i + _POINTS] - mode, below, above)
        left = at < 0
        part = mass(np.where(left, below, at), np.where(left, at, above)) / (low + high)
        out[i:i + _POINTS] = np.where(left, part, 1 - part)
    return out.reshape(np.shape(x))


def _beta_normal(x: np.ndarray, a: float, b: float) -> np.ndarray:
    """Incomplete beta of large parameters by the Peizer-Pratt normal form; the tests hold the sums against it."""
    n, p, q = a + b - 1, 1 - x, x
    s, t = b - 0.5, a - 0.5
    with np.errstate(divide="ignore", invalid="ignore"):
        def g(v: np.ndarray) -> np.ndarray:
            near = np.abs(1 - v) < 1e-3
            w = np.where(near, 0.5, v)
            exact = (1 - w * w + 2 * w * np.log(w)) / (1 - w) ** 2
            u = v - 1  # series around 1, where the closed form cancels
            return np.where(v <= 0, 1.0, np.where(near, -u / 3 + u * u / 6 - u**3 / 10, exact))

        d = s + 1 / 6 - (n + 1 / 3) * p + 0.02 * (q / (s + 0.5) - p / (t + 0.5) + (q - 0.5) / (n + 1))
        z = d * np.sqrt((1 + q * g(s / (n * p)) + p * g(t / (n * q))) / ((n + 1 / 6) * p * q))
    z = np.where(x <= 0, -np.inf, np.where(x >= 1, np.inf, z))
    return 0.5 * np.vectorize(math.erfc, otypes=[float])(-z / math.sqrt(2))


def beta_cdf(x: np.ndarray, a: float, b: float) -> np.ndarray:
    """Regularised incomplete beta by its continued fraction (Lentz), on an array; for large parameters by sums over the density."""
    x = np.clip(np.asarray(x, dtype=float), 0.0, 1.0)
    if min(a, b) > LARGE_BETA:
        return _beta_peak(x, a, b)
    flip = x > (a + 1) / (a + b + 2)
    y = np.where(flip, 1 - x, x)
    p, q = np.where(flip, b, a), np.where(flip, a, b)
    with np.errstate(divide="ignore"):
        front = np.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + p * np.log(y) + q * np.log1p(-y)) / p
    tiny = 1e-300
    c = np.ones_like(y)
    d = 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 10_000 + int(20 * math.sqrt(a + b))):
        before = h
        for top in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)),
                    -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + top / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(h - before) <= 1e-15 * np.abs(h)):
            break
    else:
        raise ArithmeticError(f"the incomplete beta fraction has not converged for {a}, {b}")
    out = np.where(y <= 0, 0.0, front * h)
    return np.where(flip, 1 - out, out)
