"""Gradient-boosted regression trees for a binary label, in numpy: binned features, logistic loss, Newton leaves."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Complete binary trees: ``feature`` and ``cut`` by node (level order), ``leaf`` values by leaf."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            while len(x) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += leaf[at - inner]
        return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, rounds: int = 80, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 2.0) -> Trees:
    n, width = x.shape
    weight = np.ones(n) if weight is None else weight
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)  # in bin b: at most edges[b]
    mean = np.average(y, weights=weight)
    base = float(np.log(mean / (1 - mean)))
    raw = np.full(n, base)
    inner = 2**depth - 1
    features, cuts, leaves = [], [], []
    offset = np.arange(width) * bins
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            place = ((at - first) * (width * bins))[:, None] + offset + binned
            shape = (count, width, bins)
            gs = np.bincount(place.ravel(), np.repeat(g, width), count * width * bins).reshape(shape).cumsum(2)
            hs = np.bincount(place.ravel(), np.repeat(h, width), count * width * bins).reshape(shape).cumsum(2)
            g_all, h_all = gs[:, :1, -1:], hs[:, :1, -1:]
            gain = gs**2 / (hs + ridge) + (g_all - gs) ** 2 / (h_all - hs + ridge) - g_all**2 / (h_all + ridge)
            gain[(hs < 1e-3) | (h_all - hs < 1e-3)] = 0
            for k in range(count):
                f, b = divmod(int(gain[k].argmax()), bins)
                if gain[k, f, b] > 1e-6 and b < len(edges[f]):
                    feature[first + k], cut[first + k] = f, edges[f][b]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > cut[at])
        leaf_at = at - inner
        value = -rate * np.bincount(leaf_at, g, inner + 1) / (np.bincount(leaf_at, h, inner + 1) + ridge)
        raw += value[leaf_at]
        features.append(feature)
        cuts.append(cut)
        leaves.append(value)
    return Trees(base, np.array(features), np.array(cuts), np.array(leaves))
