"""Gradient-boosted trees for two classes, on binned features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Boosted:
    """Trees of equal depth: feature and cut of each inner node, value of each leaf."""

    depth: int
    features: np.ndarray
    cuts: np.ndarray
    leaves: np.ndarray
    prior: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Log odds of class 1."""
        out, rows = np.full(len(x), self.prior), np.arange(len(x))
        for f, c, leaf in zip(self.features, self.cuts, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += leaf[node - len(f)]
        return out


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, l2: float = 1.0) -> Boosted:
    """Newton boosting of the log loss; every level splits all its nodes by the best gain."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for k in range(width)]
    code = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], 1)
    p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model = Boosted(depth, np.zeros((trees, 2**depth - 1), np.int64), np.full((trees, 2**depth - 1), np.inf), np.zeros((trees, 2**depth)), float(np.log(p / (1 - p))))
    score = np.full(n, model.prior)
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h, node = y - p, p * (1 - p), np.zeros(n, np.int64)
        for level in range(depth):
            first, size = 2**level - 1, 2**level
            best = np.full(size, 1e-6)
            local = node - first
            for k in range(width):
                m = len(edges[k]) + 1
                if m == 1:
                    continue
                at = local * m + code[:, k]
                gl, hl = (np.cumsum(np.bincount(at, v, size * m).reshape(size, m), 1) for v in (g, h))
                gs, hs = gl[:, -1:], hl[:, -1:]
                gain = (gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2))[:, :-1]
                top = gain.argmax(1)
                for i in np.flatnonzero(gain[np.arange(size), top] > best):
                    best[i] = gain[i, top[i]]
                    model.features[t, first + i], model.cuts[t, first + i] = k, edges[k][top[i]]
            node = 2 * node + 1 + (x[np.arange(n), model.features[t, node]] > model.cuts[t, node])
        leaf = node - (2**depth - 1)
        model.leaves[t] = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + l2)
        score += model.leaves[t][leaf]
    return model
