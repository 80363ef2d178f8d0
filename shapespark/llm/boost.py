"""Gradient-boosted trees for two classes, in numpy: histograms of binned features, level by level, logistic loss."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Boosted:
    """Trees of one depth as arrays: inner nodes in heap order test feature <= bin; leaves hold values."""

    edges: list[np.ndarray]
    base: float
    features: np.ndarray
    cuts: np.ndarray
    leaves: np.ndarray

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of class 1 for each row."""
        bins, out, rows = self.binned(x), np.full(len(x), self.base), np.arange(len(x))
        depth = int(np.log2(self.leaves.shape[1]))
        for feature, cut, leaf in zip(self.features, self.cuts, self.leaves, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (bins[rows, feature[node]] > cut[node])
            out += leaf[node - (leaf.shape[0] - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, trees: int = 60, depth: int = 4, rate: float = 0.2, ridge: float = 2.0) -> Boosted:
    n, width = x.shape
    weight = np.ones(n) if weight is None else weight
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS)[1:-1])) for f in range(width)]
    share = np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)
    model = Boosted(edges, float(np.log(share / (1 - share))), np.zeros((trees, 2**depth - 1), np.int64), np.full((trees, 2**depth - 1), 255), np.zeros((trees, 2**depth)))
    bins = model.binned(x).astype(np.int64)
    margin = np.full(n, model.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = weight * (y - p), weight * p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            count = 2**level
            best = np.full(count, 1e-9)
            for f in range(width):
                at = node * BINS + bins[:, f]
                g = np.bincount(at, grad, count * BINS).reshape(count, BINS).cumsum(axis=1)
                h = np.bincount(at, hess, count * BINS).reshape(count, BINS).cumsum(axis=1)
                total_g, total_h = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + ridge) + (total_g - g) ** 2 / (total_h - h + ridge) - total_g**2 / (total_h + ridge)
                cut = gain[:, :-1].argmax(axis=1)
                value = gain[np.arange(count), cut]
                better = np.flatnonzero(value > best)
                best[better] = value[better]
                model.features[t, count - 1 + better], model.cuts[t, count - 1 + better] = f, cut[better]
            heap = count - 1 + node
            node = 2 * node + (bins[np.arange(n), model.features[t, heap]] > model.cuts[t, heap])
        g, h = np.bincount(node, grad, 2**depth), np.bincount(node, hess, 2**depth)
        model.leaves[t] = rate * g / (h + ridge)
        margin += model.leaves[t][node]
    return model
