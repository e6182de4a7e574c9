"""Small dense systems and smooth minima on the driver, in numpy.

Without the threads of a BLAS: those may hang in a process that has forked, as one that started Spark has.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def inverse(a: np.ndarray) -> np.ndarray:
    """Inverse by Gauss-Jordan elimination with row pivoting."""
    n = len(a)
    work = np.concatenate([a.astype(float), np.eye(n)], axis=1)
    for k in range(n):
        p = k + int(np.abs(work[k:, k]).argmax())
        if work[p, k] == 0:
            raise ValueError("singular matrix")
        if p != k:
            work[[k, p]] = work[[p, k]]
        work[k] /= work[k, k]
        factor = work[:, k].copy()
        factor[k] = 0
        work -= factor[:, None] * work[k]
    return work[:, n:]


def solve_positive(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solution of a symmetric positive definite system, by elimination without pivoting."""
    n = len(a)
    work = np.concatenate([a.astype(float), b.astype(float).reshape(n, -1)], axis=1)
    for k in range(n):
        rows = work[k + 1 :, k] / work[k, k]
        work[k + 1 :, k:] -= rows[:, None] * work[k, k:]
    out = work[:, n:]
    for k in range(n - 1, -1, -1):
        out[k] = (out[k] - (work[k, k + 1 : n, None] * out[k + 1 :]).sum(axis=0)) / work[k, k]
    return out.reshape(b.shape)


def minimise(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, steps: int, memory: int = 8, close: float = 1e-6) -> np.ndarray:
    """A minimum of a smooth convex function (value and gradient), by limited-memory quasi-Newton steps.

    Ends after ``steps`` values, or where the gradient is ``close`` to nothing against the first one.
    """
    x = start.copy()
    value, slope = loss(x)
    first, past = float(np.abs(slope).max()), []
    size = 1.0 / max(float(np.sqrt((slope * slope).sum())), 1e-12)
    done = 1
    while done < steps and float(np.abs(slope).max()) > close * max(first, 1e-300):
        move, shares = -slope, []
        for s, y, r in reversed(past):
            shares.append(r * float((s * move).sum()))
            move = move - shares[-1] * y
        if past:
            s, y, _ = past[-1]
            move = move * (float((s * y).sum()) / float((y * y).sum()))
        for (s, y, r), share in zip(past, reversed(shares), strict=True):
            move = move + (share - r * float((y * move).sum())) * s
        step, down = size if not past else 1.0, float((slope * move).sum())
        while done < steps:
            new, new_slope = loss(x + step * move)
            done += 1
            if new <= value + 1e-4 * step * down:
                break
            step /= 2
        else:
            break
        if new > value:
            break
        s, y = step * move, new_slope - slope
        if float((s * y).sum()) > 1e-12 * float((y * y).sum()):
            past = [*past[-memory + 1 :], (s, y, 1 / float((s * y).sum()))]
        x, value, slope = x + s, new, new_slope
    return x
