"""Orthonormal Jacobi polynomials and their quadratures, in numpy."""

from __future__ import annotations

from math import gamma

import numpy as np


def jacobi(x: np.ndarray, a: float, b: float, n: int) -> np.ndarray:
    """The polynomial of degree n, orthonormal on [-1, 1] for the weight (1 - x)^a (1 + x)^b, by its three-term recurrence."""
    x = np.asarray(x, float)
    mass = 2 ** (a + b + 1) * gamma(a + 1) * gamma(b + 1) / gamma(a + b + 2)
    before, now = np.zeros_like(x), np.full_like(x, 1 / np.sqrt(mass))
    diagonal, side = _recurrence(a, b, n + 1)
    for k in range(n):
        before, now = now, ((x - diagonal[k]) * now - (side[k - 1] * before if k else 0)) / side[k]
    return now


def jacobi_slope(x: np.ndarray, a: float, b: float, n: int) -> np.ndarray:
    """The derivative: the polynomial of one degree less for the weights raised by one, scaled."""
    return np.sqrt(n * (n + a + b + 1)) * jacobi(x, a + 1, b + 1, n - 1) if n else np.zeros_like(np.asarray(x, float))


def _recurrence(a: float, b: float, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and side diagonal of the symmetric recurrence matrix."""
    k = np.arange(n, dtype=float)
    h = 2 * k + a + b
    with np.errstate(divide="ignore", invalid="ignore"):
        diagonal = np.where(h * (h + 2) == 0, (b - a) / (a + b + 2), (b * b - a * a) / (h * (h + 2)))
        j = k + 1
        g = 2 * j + a + b
        side = 2 / g * np.sqrt(j * (j + a + b) * (j + a) * (j + b) / ((g - 1) * (g + 1)))
    if a + b == -1:
        side[0] = 2 / (2 + a + b) * np.sqrt((1 + a) * (1 + b) / (3 + a + b))
    return diagonal, side


def gauss(a: float, b: float, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Points and weights of the n + 1 point Gauss rule: eigenvalues and first components of the recurrence matrix."""
    diagonal, side = _recurrence(a, b, n + 1)
    x, v = np.linalg.eigh(np.diag(diagonal) + np.diag(side[:n], 1) + np.diag(side[:n], -1))
    return x, v[0] ** 2 / jacobi(np.zeros(1), a, b, 0)[0] ** 2


def lobatto(a: float, b: float, n: int) -> np.ndarray:
    """The n + 1 points with both ends whose inner ones are those of the Gauss rule for the weights raised by one."""
    inner = gauss(a + 1, b + 1, n - 2)[0] if n > 1 else np.zeros(0)
    return np.concatenate([[-1.0], inner, [1.0]])


def vandermonde(x: np.ndarray, n: int) -> np.ndarray:
    """Legendre polynomials of degree 0 .. n at the points x."""
    return np.stack([jacobi(x, 0, 0, k) for k in range(n + 1)], -1)
