"""Dense kernels on small arrays of the driver."""

from __future__ import annotations

import numpy as np

from .optimize import try_solve

__all__ = ["add_diagonal", "dot", "matmul", "norm", "solve", "transpose", "try_solve"]


def solve(a, b) -> np.ndarray:
    """The solution of ``a x = b``; raises where there is no single one, or the shapes don't fit."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    if a.ndim != 2 or a.shape[0] != a.shape[1] or b.shape[:1] != a.shape[:1]:
        raise ValueError("a square matrix and a right side of its size")
    x = try_solve(a, b)
    if x is None:
        raise ValueError("the matrix is singular")
    return x


def add_diagonal(a, value: float) -> np.ndarray:
    a = np.array(a, float)
    a[np.diag_indices(min(a.shape))] += value
    return a


def norm(v) -> float:
    return float(np.linalg.norm(np.asarray(v, float)))


def dot(a, b) -> float:
    return float(np.dot(np.asarray(a, float), np.asarray(b, float)))


def matmul(a, b) -> np.ndarray:
    return np.asarray(a, float) @ np.asarray(b, float)


def transpose(a) -> np.ndarray:
    return np.asarray(a, float).T
