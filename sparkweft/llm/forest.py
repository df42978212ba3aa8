"""A small random forest: grown on a bounded labelled sample, applied as a column expression."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Tree = tuple  # (share,) for a leaf, (feature, bound, low, high) for a split


def _grow(x: np.ndarray, y: np.ndarray, depth: int, least: int, tries: int, rng: np.random.Generator) -> Tree:
    share = float(y.mean())
    if depth == 0 or len(y) < 2 * least or share in (0.0, 1.0):
        return (share,)
    best = (share * (1 - share) * len(y), None, None)
    for f in rng.choice(x.shape[1], tries, replace=False):
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], y[order]
        ones = np.cumsum(t)[:-1]
        n = np.arange(1, len(y))
        rest = ones[-1] + t[-1] - ones
        impurity = ones * (1 - ones / n) + rest * (1 - rest / (len(y) - n))
        allowed = (v[1:] > v[:-1]) & (n >= least) & (len(y) - n >= least)
        if allowed.any():
            k = int(np.argmin(np.where(allowed, impurity, np.inf)))
            if impurity[k] < best[0] - 1e-9:
                best = (impurity[k], int(f), float((v[k] + v[k + 1]) / 2))
    if best[1] is None:
        return (share,)
    low = x[:, best[1]] <= best[2]
    grow = lambda part: _grow(x[part], y[part], depth - 1, least, tries, rng)
    return (best[1], best[2], grow(low), grow(~low))


def grow_forest(x: np.ndarray, y: np.ndarray, trees: int = 15, depth: int = 6, least: int = 3, seed: int = 7) -> list[Tree]:
    """Bootstrap trees over random subsets of the features; the same for the same rows and seed."""
    rng = np.random.default_rng(seed)
    tries = max(1, int(np.ceil(np.sqrt(x.shape[1]))))
    out = []
    for _ in range(trees):
        at = rng.integers(0, len(y), len(y))
        out.append(_grow(x[at], y[at].astype(float), depth, least, tries, rng))
    return out


def predict(forest: list[Tree], row) -> float:
    """The mean share over the trees for one row of features; what the expression computes."""
    total = 0.0
    for t in forest:
        while len(t) > 1:
            t = t[2] if row[t[0]] <= t[1] else t[3]
        total += t[0]
    return total / len(forest)


def forest_column(forest: list[Tree], feature: Callable[[int], Column]) -> Column:
    """The forest as nested conditions over ``feature(i)``."""

    def tree(t: Tree) -> Column:
        if len(t) == 1:
            return F.lit(t[0])
        return F.when(feature(t[0]) <= F.lit(t[1]), tree(t[2])).otherwise(tree(t[3]))

    total = tree(forest[0])
    for t in forest[1:]:
        total = total + tree(t)
    return total / F.lit(float(len(forest)))
