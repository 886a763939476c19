"""Gradient-boosted trees on dense features and isotonic calibration, in numpy."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Trees of equal depth for a 0/1 target under logistic loss, grown by histograms of binned features.

    A tree of depth d is d arrays of (feature, threshold) by node and 2^d leaf values; scoring is vectorised over rows."""

    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0, least: float = 1.0):
        self.count, self.depth, self.rate, self.bins, self.l2, self.least = trees, depth, rate, bins, l2, least
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        """Without rows the base alone answers (0.5); with one class, nearly that class."""
        n, width = x.shape
        share = (y.sum() + 1) / (n + 2)
        self.base = float(np.log(share / (1 - share)))
        if not n or not 0 < y.sum() < n:
            return self
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(width)]
        binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
        z = np.full(n, self.base)
        for _ in range(self.count):
            p = 1 / (1 + np.exp(-z))
            grad, hess = y - p, p * (1 - p)
            node, levels = np.zeros(n, np.intp), []
            for level in range(self.depth):
                nodes = 1 << level
                feature, threshold, cut = np.zeros(nodes, np.intp), np.full(nodes, np.inf), np.full(nodes, self.bins + 1)
                best = np.full(nodes, 1e-9)
                for j, e in enumerate(edges):
                    if not e.size:
                        continue
                    key, shape = node * (self.bins + 1) + binned[:, j], (nodes, self.bins + 1)
                    g = np.bincount(key, grad, shape[0] * shape[1]).reshape(shape).cumsum(1)
                    h = np.bincount(key, hess, shape[0] * shape[1]).reshape(shape).cumsum(1)
                    left, all_g, all_h = h[:, : e.size], g[:, -1:], h[:, -1:]
                    gain = g[:, : e.size] ** 2 / (left + self.l2) + (all_g - g[:, : e.size]) ** 2 / (all_h - left + self.l2) - all_g**2 / (all_h + self.l2)
                    gain[(left < self.least) | (all_h - left < self.least)] = 0
                    k = gain.argmax(1)
                    top = gain[np.arange(nodes), k]
                    better = top > best
                    best[better], feature[better], threshold[better], cut[better] = top[better], j, e[k[better]], k[better]
                levels.append((feature, threshold))
                node = node * 2 + (binned[np.arange(n), feature[node]] > cut[node])
            leaves = 1 << self.depth
            value = self.rate * np.bincount(node, grad, leaves) / (np.bincount(node, hess, leaves) + self.l2)
            self.trees.append((levels, value))
            z += value[node]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        z, rows = np.full(len(x), self.base), np.arange(len(x))
        for levels, value in self.trees:
            node = np.zeros(len(x), np.intp)
            for feature, threshold in levels:
                node = node * 2 + (x[rows, feature[node]] > threshold[node])
            z += value[node]
        return z


class Isotonic:
    """The nondecreasing step function nearest to 0/1 outcomes by score (pool adjacent violators), linear in between."""

    def __init__(self):
        self.at, self.value = np.array([0.0]), np.array([0.5])

    def fit(self, score: np.ndarray, y: np.ndarray) -> Isotonic:
        """No probability is nearer to 0 or 1 than half an outcome in all. Without rows: 0.5."""
        if not len(score):
            return self
        pools: list[list[float]] = []  # outcomes, size, lowest and highest score
        for s in np.unique(score):
            own = y[score == s]
            pools.append([float(own.sum()), len(own), s, s])
            while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
                last = pools.pop()
                pools[-1] = [pools[-1][0] + last[0], pools[-1][1] + last[1], pools[-1][2], last[3]]
        self.at = np.array([s for p in pools for s in p[2:]])
        edge = 0.5 / (len(y) + 1)
        self.value = np.clip([p[0] / p[1] for p in pools for _ in range(2)], edge, 1 - edge)
        return self

    def predict(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.at, self.value)
