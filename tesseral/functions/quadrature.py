"""Gauss rules and their Kronrod extensions for the weight (1 + x) on [-1, 1], for integrals over scales."""

from __future__ import annotations

import numpy as np


def recurrence(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of the three-term recurrence of the weight's orthogonal polynomials; the second begins with the weight's integral."""
    k = np.arange(n, dtype=float)
    a = 1.0 / ((2 * k + 1) * (2 * k + 3))
    b = np.empty(n)
    b[0] = 2.0
    k = k[1:]
    b[1:] = k * (k + 1) / (2 * k + 1) ** 2
    return a, b


def rule(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and weights from recurrence coefficients: eigenvalues and first components of the tridiagonal matrix."""
    matrix = np.diag(a) + np.diag(np.sqrt(b[1:]), 1) + np.diag(np.sqrt(b[1:]), -1)
    nodes, vectors = np.linalg.eigh(matrix)
    return nodes, b[0] * vectors[0] ** 2


def kronrod(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """2 n + 1 nodes, their weights, and the weights of the n-point Gauss rule at those of the nodes that are its own, 0 at the others.

    The extension's matrix follows from mixed moments of the known coefficients (Laurie, 1997).
    """
    known_a, known_b = recurrence(2 * n + 2)
    a, b = np.zeros(2 * n + 1), np.zeros(2 * n + 1)
    a[: 3 * n // 2 + 1], b[: -(-3 * n // 2) + 1] = known_a[: 3 * n // 2 + 1], known_b[: -(-3 * n // 2) + 1]
    s, t = np.zeros(n // 2 + 2), np.zeros(n // 2 + 2)
    t[1] = b[n + 1]
    for m in range(n - 1):
        total = 0.0
        for k in range((m + 1) // 2, -1, -1):
            total += (a[k + n + 1] - a[m - k]) * t[k + 1] + b[k + n + 1] * s[k] - b[m - k] * s[k + 1]
            s[k + 1] = total
        s, t = t, s
    s[1:] = s[:-1].copy()
    for m in range(n - 1, 2 * n - 2):
        total = 0.0
        for k in range(m + 1 - n, (m - 1) // 2 + 1):
            j = n - 1 - (m - k)
            total += -(a[k + n + 1] - a[m - k]) * t[j + 1] - b[k + n + 1] * s[j + 1] + b[m - k] * s[j + 2]
            s[j + 1] = total
        k = (m + 1) // 2
        if m % 2 == 0:
            a[k + n + 1] = a[k] + (s[j + 1] - b[k + n + 1] * s[j + 2]) / t[j + 2]
        else:
            b[k + n + 1] = s[j + 1] / s[j + 2]
        s, t = t, s
    a[2 * n] = a[n - 1] - b[2 * n] * s[1] / t[1]
    nodes, weights = rule(a, b)
    own, gauss = rule(known_a[:n], known_b[:n])
    coarse = np.zeros(len(nodes))
    coarse[np.abs(nodes[:, None] - own[None, :]).argmin(axis=0)] = gauss
    return nodes, weights, coarse


def scale_nodes(ell: float, n: int) -> list[tuple[float, float, float]]:
    """(scale, weight, weight of the coarser rule) for integrals of 2 x f(x) over x in (0, ell), in the form that aggregate.quadrature_sum() takes."""
    nodes, weights, coarse = kronrod(n)
    half = ell / 2
    return [(half * (1 + x), half * w, half * c) for x, w, c in zip(nodes.tolist(), weights.tolist(), coarse.tolist(), strict=True)]
