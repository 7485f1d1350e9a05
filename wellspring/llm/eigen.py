"""Leading eigenpairs of a symmetric matrix of moderate size.

The matrix is reduced to tridiagonal form by Householder reflections. Sturm counts (the
negative pivots of T - x) tell how many eigenvalues lie below x, and bisection on them
finds the leading ones; inverse iteration gives their vectors, made orthogonal again
within clusters of close eigenvalues, and the reflections take them back.
"""

from __future__ import annotations

import numpy as np

CLUSTER = 1e-3
STEPS = 4


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and reflection vectors (each of its trailing part)."""
    a = np.array(matrix, np.float64)
    vectors = []
    for k in range(len(a) - 2):
        v = a[k + 1 :, k].copy()
        norm = np.linalg.norm(v)
        if np.linalg.norm(v[1:]) <= np.finfo(float).tiny:
            vectors.append(np.zeros_like(v))
            continue
        v[0] += np.copysign(norm, v[0])
        v /= np.linalg.norm(v)
        inner = a[k + 1 :, k + 1 :]
        p = inner @ v
        w = p - (v @ p) * v
        inner -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
        vectors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), vectors


def below(diagonal: np.ndarray, off: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Number of eigenvalues under each of ``x``."""
    tiny = np.finfo(float).eps * max(np.abs(diagonal).max(initial=0), np.abs(off).max(initial=0), np.finfo(float).tiny)
    q = diagonal[0] - x
    count = (q < 0).astype(int)
    for d, e in zip(diagonal[1:], off, strict=True):
        q = np.where(np.abs(q) < tiny, -tiny, q)
        q = d - x - e * e / q
        count += q < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, by bisection to the last bits."""
    n = len(diagonal)
    reach = np.abs(np.concatenate([off, [0]])) + np.abs(np.concatenate([[0], off]))
    lo, hi = np.full(k, (diagonal - reach).min()), np.full(k, (diagonal + reach).max())
    hi += np.finfo(float).eps * np.abs(hi)
    rank = n - np.arange(1, k + 1)  # so many are smaller than the value sought
    for _ in range(200):
        mid = (lo + hi) / 2
        if np.all((mid <= lo) | (mid >= hi)):
            break
        over = below(diagonal, off, mid) > rank
        lo, hi = np.where(over, lo, mid), np.where(over, mid, hi)
    return (lo + hi) / 2


def solve(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray) -> np.ndarray:
    """Solution of (T - shift) y = right by elimination with row exchanges."""
    n = len(diagonal)
    tiny = np.finfo(float).eps * max(np.abs(diagonal).max(), np.abs(off).max(initial=0), np.finfo(float).tiny)
    d, up, far = (diagonal - shift).tolist(), [*off.tolist(), 0.0], [0.0] * n
    low, y = off.tolist(), right.tolist()
    for i in range(n - 1):
        if abs(low[i]) > abs(d[i]):
            d[i], low[i] = low[i], d[i]
            d[i + 1], up[i], far[i], up[i + 1] = up[i], d[i + 1], up[i + 1], 0.0
            y[i], y[i + 1] = y[i + 1], y[i]
        f = low[i] / (d[i] or tiny)
        d[i + 1] -= f * up[i]
        up[i + 1] -= f * far[i]
        y[i + 1] -= f * y[i]
    for i in reversed(range(n)):
        rest = y[i] - (up[i] * y[i + 1] if i + 1 < n else 0) - (far[i] * y[i + 2] if i + 2 < n else 0)
        y[i] = rest / (d[i] if abs(d[i]) > tiny else np.copysign(tiny, d[i]))
    return np.array(y)


def leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and unit eigenvectors as rows."""
    n = len(matrix)
    k = min(k, n)
    scale = np.abs(matrix).max(initial=0)
    if not k or not scale:
        return np.zeros(k), np.eye(k, n)
    diagonal, off, reflections = tridiagonal(matrix / scale)
    values = leading_values(diagonal, off, k)
    norm = max(np.abs(diagonal).max(), np.abs(off).max(initial=0))
    vectors = np.zeros((k, n))
    first = 0
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * norm:
            first = j
        y = np.random.default_rng(j).standard_normal(n)
        for _ in range(STEPS):
            for _ in range(2):
                y -= vectors[first:j].T @ (vectors[first:j] @ y)
            y = solve(diagonal, off, value, y / np.linalg.norm(y))
            y /= np.abs(y).max()
        y -= vectors[first:j].T @ (vectors[first:j] @ y)
        vectors[j] = y / np.linalg.norm(y)
    for at, v in reversed(list(enumerate(reflections))):
        vectors[:, at + 1 :] -= 2 * np.outer(vectors[:, at + 1 :] @ v, v)
    return values * scale, vectors
