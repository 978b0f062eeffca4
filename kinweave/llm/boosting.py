"""Small gradient-boosted trees: fitted in numpy on the driver from a bounded table, applied as a SQL expression."""

from __future__ import annotations

import numpy as np


def _leaf(g: np.ndarray, h: np.ndarray) -> float:
    return float(g.sum() / (h.sum() + 1.0))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], depth: int):
    """A tree as a leaf value or (feature, cut, left, right); left where the feature is below the cut."""
    if depth == 0 or len(g) < 10:
        return _leaf(g, h)
    whole, best = g.sum() ** 2 / (h.sum() + 1.0), (1e-6, None)
    for f, values in enumerate(cuts):
        for cut in values:
            left = x[:, f] < cut
            n = left.sum()
            if n < 5 or len(g) - n < 5:
                continue
            gl, hl = g[left].sum(), h[left].sum()
            gain = gl**2 / (hl + 1.0) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1.0) - whole
            if gain > best[0]:
                best = (gain, (f, float(cut), left))
    if best[1] is None:
        return _leaf(g, h)
    f, cut, left = best[1]
    return f, cut, _grow(x[left], g[left], h[left], cuts, depth - 1), _grow(x[~left], g[~left], h[~left], cuts, depth - 1)


def _value(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, cut, low, high = tree
    return np.where(x[:, f] < cut, _value(low, x), _value(high, x))


def _sql(tree, names: list[str], rate: float) -> str:
    if not isinstance(tree, tuple):
        return f"{tree * rate:.6f}D"
    f, cut, low, high = tree
    return f"(CASE WHEN {names[f]} < {cut:.6f}D THEN {_sql(low, names, rate)} ELSE {_sql(high, names, rate)} END)"


class Boosted:
    """Logistic loss; ``slope`` and ``offset`` calibrate the margin (Platt) on rows that were held out."""

    def __init__(self, rounds: int = 24, depth: int = 3, rate: float = 0.3) -> None:
        self.rounds, self.depth, self.rate = rounds, depth, rate
        self.trees, self.base, self.slope, self.offset = [], 0.0, 1.0, 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        share = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 18)[1:-1])) + 1e-6 for f in range(x.shape[1])]
        margin = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            tree = _grow(x, y - p, p * (1 - p), cuts, self.depth)
            self.trees.append(tree)
            margin += self.rate * _value(tree, x)
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + self.rate * sum(_value(t, x) for t in self.trees)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        m = self.margin(x)
        for _ in range(200):
            p = 1 / (1 + np.exp(-(self.slope * m + self.offset)))
            self.slope -= 0.05 * float(((p - y) * m).mean())
            self.offset -= 0.05 * float((p - y).mean())
        self.slope = max(self.slope, 0.05)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.margin(x) + self.offset)))

    def sql(self, names: list[str]) -> str:
        margin = " + ".join([f"{self.base:.6f}D", *(_sql(t, names, self.rate) for t in self.trees)])
        return f"1 / (1 + exp(-({self.slope:.6f}D * ({margin}) + {self.offset:.6f}D)))"


def threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest threshold above which held-out rows reach ``precision``."""
    for t in np.linspace(0.05, 0.99, 95):
        chosen = p >= t
        if chosen.any() and y[chosen].mean() >= precision:
            return float(t)
    return 1.01
