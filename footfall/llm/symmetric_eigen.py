"""Leading eigenpairs of a symmetric matrix: tridiagonal form, bisection, inverse iteration.

The matrix is one of covariances, so its size is that of a vector, not of the data.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(np.float64).eps
# Eigenvalues closer than this share of the norm are a cluster, whose vectors are made orthogonal.
CLUSTER_GAP = 1e-3
STEPS = 6
SEED = 12


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Diagonal, off-diagonal and reflections (first row, unit vector) of Householder's reduction."""
    a = np.array(matrix, dtype=np.float64)
    n = len(a)
    reflections = []
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        norm = np.linalg.norm(x)
        if norm == 0 or not np.any(x[1:]):
            continue
        x[0] += np.copysign(norm, x[0])
        u = x / np.linalg.norm(x)
        reflections.append((k + 1, u))
        # Two-sided update of the rest: A - u w' - w u'.
        p = a[k + 1 :, k + 1 :] @ u
        w = 2 * (p - (u @ p) * u)
        a[k + 1 :, k + 1 :] -= np.outer(u, w) + np.outer(w, u)
        a[k + 1 :, k] -= 2 * u * (u @ a[k + 1 :, k])
        a[k, k + 1 :] = a[k + 1 :, k]
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflections


def back(reflections: list[tuple[int, np.ndarray]], vector: np.ndarray) -> np.ndarray:
    """A vector of the tridiagonal matrix as one of the original."""
    out = vector.copy()
    for first, u in reversed(reflections):
        out[first:] -= 2 * u * (u @ out[first:])
    return out


def below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of eigenvalues below each place: the negative terms of Sturm's sequence."""
    tiny = EPS * max(np.abs(diagonal).max(), np.abs(off).max() if len(off) else 0, np.finfo(float).tiny / EPS)
    square = np.concatenate([[0.0], off * off])
    count, q = np.zeros(len(at), dtype=np.int64), np.ones(len(at))
    for d, s in zip(diagonal, square):
        q = d - at - s / q
        q = np.where(np.abs(q) < tiny * EPS, -tiny * EPS, q)
        count += q < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` largest eigenvalues, falling, each bisected until its interval has no inner number."""
    n = len(diagonal)
    reach = np.zeros(n)
    reach[:-1] += np.abs(off)
    reach[1:] += np.abs(off)
    low = np.full(count, (diagonal - reach).min())
    high = np.full(count, (diagonal + reach).max())
    pad = 2 * EPS * n * max(np.abs(low).max(), np.abs(high).max()) + np.finfo(float).tiny
    low, high = low - pad, high + pad
    # The k-th largest is the first place with more than n - k values below it.
    wanted = n - np.arange(1, count + 1)
    for _ in range(2100):
        middle = low + (high - low) / 2
        open_ = (middle > low) & (middle < high)
        if not open_.any():
            break
        under = below(diagonal, off, middle) > wanted
        high = np.where(open_ & under, middle, high)
        low = np.where(open_ & ~under, middle, low)
    return low + (high - low) / 2


def _solved(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, tiny: float) -> np.ndarray:
    """(T - shift) y = right by elimination with row exchanges."""
    n = len(diagonal)
    main, upper, second = (diagonal - shift).tolist(), [*off.tolist(), 0.0], [0.0] * n
    y = right.tolist()
    for i in range(n - 1):
        lower = float(off[i])
        if abs(main[i]) >= abs(lower):
            if abs(main[i]) < tiny:
                main[i] = tiny
            factor = lower / main[i]
            main[i + 1] -= factor * upper[i]
            y[i + 1] -= factor * y[i]
        else:
            factor = main[i] / lower
            main[i], main[i + 1], upper[i] = lower, upper[i] - factor * main[i + 1], main[i + 1]
            second[i], upper[i + 1] = upper[i + 1], -factor * upper[i + 1]
            y[i], y[i + 1] = y[i + 1], y[i] - factor * y[i + 1]
    for i in range(n - 1, -1, -1):
        value = y[i]
        if i + 1 < n:
            value -= upper[i] * y[i + 1]
        if i + 2 < n:
            value -= second[i] * y[i + 2]
        y[i] = value / (main[i] if abs(main[i]) >= tiny else tiny)
    return np.array(y)


def leading_pairs(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit vectors as columns.

    Vectors come from inverse iteration on the tridiagonal matrix; those of a cluster of
    values are made orthogonal to each other in every step.  The largest entry of a vector is positive.
    """
    n = len(matrix)
    count = min(count, n)
    if not count:
        return np.zeros(0), np.zeros((n, 0))
    scale = np.abs(matrix).max()
    if scale == 0:
        return np.zeros(count), np.eye(n, count)
    diagonal, off, reflections = tridiagonal(np.asarray(matrix, dtype=np.float64) / scale)
    values = leading_values(diagonal, off, count)
    norm = max(np.abs(diagonal).max(), np.abs(off).max() if len(off) else 0)
    random = np.random.default_rng(SEED)
    found: list[np.ndarray] = []
    start, shift = 0, np.inf
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLUSTER_GAP * norm:
            start = k
        # Equal values are set a little apart, so that their systems differ.
        shift = min(float(value), shift - 4 * EPS * norm)
        y = random.normal(size=n)
        for _ in range(STEPS):
            y = _solved(diagonal, off, shift, y / np.linalg.norm(y), EPS * norm)
            y /= np.linalg.norm(y)
            for _ in range(2):
                for other in found[start:k]:
                    y -= (other @ y) * other
            y /= np.linalg.norm(y)
        found.append(y)
    vectors = np.column_stack([back(reflections, y) for y in found])
    vectors /= np.linalg.norm(vectors, axis=0)
    vectors *= np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(count)])
    return values * scale, vectors
