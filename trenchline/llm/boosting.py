"""Gradient-boosted decision trees for two classes, on binned columns."""

from __future__ import annotations

import numpy as np

BINS = 32


class BoostedTrees:
    """Logistic loss, trees of fixed depth, second-order leaf values."""

    def __init__(self, rounds: int = 80, depth: int = 4, rate: float = 0.2, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.ridge = rounds, depth, rate, ridge
        self.edges: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros((0, len(self.edges)), int)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        bins = self._binned(x)
        rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        f = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            grad, hess = y - p, p * (1 - p)
            feature = np.zeros((1 << self.depth) - 1, int)
            cut = np.full((1 << self.depth) - 1, BINS)  # nothing goes right
            node = np.zeros(len(y), int)
            for level in range(self.depth):
                first, width = (1 << level) - 1, 1 << level
                best = np.full(width, 1e-6)
                for j in range(bins.shape[1]):
                    at = (node - first) * (BINS + 1) + bins[:, j]
                    g = np.bincount(at, grad, minlength=width * (BINS + 1)).reshape(width, -1).cumsum(axis=1)
                    h = np.bincount(at, hess, minlength=width * (BINS + 1)).reshape(width, -1).cumsum(axis=1)
                    gt, ht = g[:, -1:], h[:, -1:]
                    gain = g**2 / (h + self.ridge) + (gt - g) ** 2 / (ht - h + self.ridge) - gt**2 / (ht + self.ridge)
                    gain[(h < 1) | (ht - h < 1)] = 0
                    i = gain.argmax(axis=1)
                    value = gain[np.arange(width), i]
                    better = value > best
                    best[better] = value[better]
                    feature[first : first + width][better] = j
                    cut[first : first + width][better] = i[better]
                node = 2 * node + 1 + (bins[np.arange(len(y)), feature[node]] > cut[node])
            leaf = node - ((1 << self.depth) - 1)
            g = np.bincount(leaf, grad, minlength=1 << self.depth)
            h = np.bincount(leaf, hess, minlength=1 << self.depth)
            value = self.rate * g / (h + self.ridge)
            f += value[leaf]
            self.trees.append((feature, cut, value))
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        bins, rows = self._binned(x), np.arange(len(x))
        f = np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (bins[rows, feature[node]] > cut[node])
            f += value[node - ((1 << self.depth) - 1)]
        return f
