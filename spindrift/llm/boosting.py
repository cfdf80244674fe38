"""Gradient-boosted trees and logistic regression on small dense feature matrices, in numpy."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic gradient boosting with depth-limited trees on binary features.

    fit() is meant for a bounded sample of labelled rows; predict() gives probabilities.
    """

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, l2: float = 1.0):
        self.rounds, self.depth, self.rate, self.l2 = rounds, depth, rate, l2
        self.base, self.trees = 0.0, []

    def _grow(self, X, g, h, depth):
        G, H = g.sum(), h.sum()
        if depth == 0 or len(g) < 4:
            return float(-G / (H + self.l2))
        G1, H1 = g @ X, h @ X
        gain = G1**2 / (H1 + self.l2) + (G - G1) ** 2 / (H - H1 + self.l2) - G**2 / (H + self.l2)
        k = int(np.argmax(gain))
        on = X[:, k] > 0.5
        if gain[k] < 1e-4 or not on.any() or on.all():
            return float(-G / (H + self.l2))
        return k, self._grow(X[on], g[on], h[on], depth - 1), self._grow(X[~on], g[~on], h[~on], depth - 1)

    def _leaf(self, tree, X):
        if isinstance(tree, float):
            return np.full(len(X), tree)
        k, yes, no = tree
        on = X[:, k] > 0.5
        out = np.empty(len(X))
        out[on] = self._leaf(yes, X[on])
        out[~on] = self._leaf(no, X[~on])
        return out

    def fit(self, X: np.ndarray, y: np.ndarray) -> BoostedTrees:
        p = min(max(y.mean() if len(y) else 0.5, 1e-3), 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        F = np.full(len(y), self.base)
        for _ in range(self.rounds if len(y) else 0):
            q = 1 / (1 + np.exp(-F))
            tree = self._grow(X, q - y, q * (1 - q), self.depth)
            self.trees.append(tree)
            F += self.rate * self._leaf(tree, X)
        return self

    def predict(self, X: np.ndarray) -> np.ndarray:
        F = np.full(len(X), self.base)
        for tree in self.trees:
            F += self.rate * self._leaf(tree, X)
        return 1 / (1 + np.exp(-F))


def best_threshold(score: np.ndarray, y: np.ndarray, default: float = 0.5) -> float:
    """The cutoff of highest F1 on held-out rows, ties to the one nearest to ``default``."""
    if not len(y) or y.min() == y.max():
        return default
    cuts = [k / 20 for k in range(1, 20)]
    f1 = [2 * ((score >= c) & (y == 1)).sum() / max(1, (score >= c).sum() + (y == 1).sum()) for c in cuts]
    best = max(f1)
    return float(min((c for c, f in zip(cuts, f1) if f >= best - 1e-9), key=lambda c: abs(c - default)))
