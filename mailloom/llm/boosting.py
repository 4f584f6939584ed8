"""Gradient-boosted trees for two classes, on numpy alone: small enough to train on the driver from a
bounded sample, and evaluated on whole batches at once on the executors."""

from __future__ import annotations

import numpy as np


class Trees:
    """Logistic boosting of complete trees of one depth over binned features."""

    def __init__(self, edges: list[np.ndarray], feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray, base: float):
        #: feature and cut: (trees, 2**depth - 1), in level order; leaf: (trees, 2**depth)
        self.edges, self.feature, self.cut, self.leaf, self.base = edges, feature, cut, leaf, base

    @classmethod
    def train(cls, x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, bins: int = 32, rate: float = 0.25, ridge: float = 1.0) -> Trees:
        """x: (rows, features), y: 0 or 1. With one class or no rows at all the base rate is the answer."""
        n, width = x.shape
        mean = float(np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3))
        base = float(np.log(mean / (1 - mean)))
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.empty(0) for j in range(width)]
        binned = cls._binned(x, edges)
        nodes = 2**depth - 1
        feature, cut, leaf = np.zeros((rounds, nodes), np.int16), np.full((rounds, nodes), bins, np.int16), np.zeros((rounds, nodes + 1))
        score = np.full(n, base)
        for r in range(rounds if n else 0):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            node = np.zeros(n, np.int64)
            for level in range(depth):
                first, count = 2**level - 1, 2**level
                best = np.full(count, 1e-6)
                local = node - first
                for j in range(width):
                    flat = local * bins + binned[:, j]
                    gs = np.cumsum(np.bincount(flat, g, count * bins).reshape(count, bins), axis=1)
                    hs = np.cumsum(np.bincount(flat, h, count * bins).reshape(count, bins), axis=1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                    at = gain.argmax(axis=1)
                    top = gain[np.arange(count), at]
                    better = top > best
                    best[better] = top[better]
                    feature[r, first : first + count][better] = j
                    cut[r, first : first + count][better] = at[better]
                node = 2 * node + 1 + (binned[np.arange(n), feature[r, node]] > cut[r, node])
            at = node - nodes
            leaf[r] = rate * np.bincount(at, g, nodes + 1) / (np.bincount(at, h, nodes + 1) + ridge)
            score += leaf[r, at]
        return cls(edges, feature, cut, leaf, base)

    @staticmethod
    def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1).astype(np.int16) if len(edges) else np.zeros((len(x), 0), np.int16)

    def probability(self, x: np.ndarray) -> np.ndarray:
        binned = self._binned(x, self.edges)
        rows, nodes = np.arange(len(x)), self.feature.shape[1]
        score = np.full(len(x), self.base)
        for f, c, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < nodes:
                node = 2 * node + 1 + (binned[rows, f[node]] > c[node])
            score += leaf[node - nodes] if len(node) else 0
        return 1 / (1 + np.exp(-score))

    def importance(self) -> np.ndarray:
        """How often each feature is asked, over all trees."""
        used = self.cut < self.cut.max() if self.cut.size else np.zeros_like(self.cut, bool)
        return np.bincount(self.feature[used].ravel(), minlength=len(self.edges))
