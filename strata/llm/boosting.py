"""Gradient-boosted trees of depth two over small integer features.

Fitted on the driver from counts of equal (features, label) rows, whose number
is bounded by the feature values, and applied as a SQL expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tree:
    feature: int
    cut: int  # left: value <= cut
    left: tuple[int, int, float, float]  # feature, cut, value at most the cut, value above
    right: tuple[int, int, float, float]


@dataclass(frozen=True)
class Boosted:
    start: float
    trees: tuple[Tree, ...]

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for t in self.trees:
            side = x[:, t.feature] <= t.cut
            for at, (f, c, low, high) in ((side, t.left), (~side, t.right)):
                out[at] += np.where(x[at, f] <= c, low, high)
        return out

    def expression(self, x: Column) -> Column:
        """The score as a SQL expression; ``x`` is the array of features."""
        if not self.trees:
            return F.lit(self.start)
        names = ("f", "c", "lf", "lc", "ll", "lh", "rf", "rc", "rl", "rh")
        rows = [(t.feature, t.cut, *t.left, *t.right) for t in self.trees]
        literal = lambda v: f"{v!r}D" if isinstance(v, float) else str(v)
        structs = [
            "named_struct(" + ", ".join(f"'{n}', {literal(v)}" for n, v in zip(names, row, strict=True)) + ")" for row in rows
        ]

        def leaf(t: Column, side: str) -> Column:
            return F.when(F.get(x, t[f"{side}f"]) <= t[f"{side}c"], t[f"{side}l"]).otherwise(t[f"{side}h"])

        def add(total: Column, t: Column) -> Column:
            return total + F.when(F.get(x, t["f"]) <= t["c"], leaf(t, "l")).otherwise(leaf(t, "r"))

        return F.aggregate(F.expr(f"array({', '.join(structs)})"), F.lit(self.start), add)


def _best_split(x: np.ndarray, g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[int, int, float]:
    """The feature and cut of most gain."""
    best = (0, int(x[:, 0].max()) if len(x) else 0, -1.0)
    for f in range(x.shape[1]):
        values = x[:, f] - x[:, f].min()
        gs, hs = np.cumsum(np.bincount(values, g)), np.cumsum(np.bincount(values, h))
        gain = gs**2 / (hs + ridge) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + ridge)
        at = int(np.argmax(gain[:-1])) if len(gain) > 1 else 0
        if len(gain) > 1 and gain[at] > best[2]:
            best = (f, at + int(x[:, f].min()), float(gain[at]))
    return best


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 30, rate: float = 0.3, ridge: float = 1.0) -> Boosted:
    """Logistic boosting of ``weight`` copies of rows ``x`` with labels ``y``."""
    total = max(weight.sum(), 1.0)
    share = min(0.999, max(0.001, float((weight * y).sum() / total)))
    start = float(np.log(share / (1 - share)))
    if not len(x) or len(np.unique(y)) < 2:
        return Boosted(start, ())
    score, trees = np.full(len(x), start), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (y - p), weight * p * (1 - p)
        feature, cut, _ = _best_split(x, g, h, ridge)
        parts = []
        for side in (x[:, feature] <= cut, x[:, feature] > cut):
            if not side.any():
                parts.append((0, 0, 0.0, 0.0))
                continue
            f, c, _ = _best_split(x[side], g[side], h[side], ridge)
            low = x[side, f] <= c
            values = [rate * g[side][m].sum() / (h[side][m].sum() + ridge) for m in (low, ~low)]
            parts.append((f, c, float(values[0]), float(values[1])))
            score[side] += np.where(low, *values)
        trees.append(Tree(feature, cut, parts[0], parts[1]))
    return Boosted(start, tuple(trees))
