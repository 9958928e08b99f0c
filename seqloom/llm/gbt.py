"""Gradient-boosted trees for two classes, in numpy: histograms of at most 32 bins, trees of fixed depth."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Trees:
    """Complete trees, nodes in breadth-first order: go right where the feature is above the cut."""

    base: float
    feature: np.ndarray  # (trees, 2^depth - 1)
    cut: np.ndarray
    value: np.ndarray  # (trees, 2^depth)
    depth: int

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base, np.float64)
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += v[at - (len(v) - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, least: float = 3.0, ridge: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss; a split needs ``least`` of hessian on either side."""
    n, k = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1], method="lower")) for j in range(k)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    score = np.full(n, np.log(p / (1 - p)))
    inner, leaves = 2**depth - 1, 2**depth
    features, thresholds, values = (np.zeros((trees, m), d) for m, d in ((inner, np.int64), (inner, np.float32), (leaves, np.float64)))
    offset = np.arange(k) * BINS
    for t in range(trees):
        q = 1 / (1 + np.exp(-score))
        g, h = q - y, q * (1 - q)
        at = np.zeros(n, np.int64)
        thresholds[t] = np.inf
        for node in range(inner):
            mine = np.flatnonzero(at == node)
            if len(mine) > 1:
                place = (binned[mine] + offset).ravel()
                gs = np.bincount(place, np.repeat(g[mine], k), k * BINS).reshape(k, BINS).cumsum(1)
                hs = np.bincount(place, np.repeat(h[mine], k), k * BINS).reshape(k, BINS).cumsum(1)
                total_g, total_h = gs[0, -1], hs[0, -1]
                gain = gs**2 / (hs + ridge) + (total_g - gs) ** 2 / (total_h - hs + ridge) - total_g**2 / (total_h + ridge)
                gain[(hs < least) | (total_h - hs < least)] = 0
                j, b = np.unravel_index(gain.argmax(), gain.shape)
                if gain[j, b] > 1e-6 and b < len(cuts[j]):
                    features[t, node], thresholds[t, node] = j, cuts[j][b]
                    at[mine] = 2 * node + 1 + (binned[mine, j] > b)
                    continue
            at[mine] = 2 * node + 1
        leaf = at - inner
        values[t] = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + ridge)
        score += values[t][leaf]
    return Trees(float(np.log(p / (1 - p))), features, thresholds, values, depth)
