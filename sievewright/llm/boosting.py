"""Gradient-boosted trees for two classes in numpy: histograms over quantile bins, Newton steps."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """Complete binary trees of one depth. ``feature`` and ``cut`` by tree and inner node, ``leaf`` by tree and leaf."""

    base: float = 0.0
    depth: int = 4
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += leaf[node - (2**self.depth - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30))) if len(x) else np.zeros(0)


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, l2: float = 2.0, least: float = 5.0) -> Trees:
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    m = Trees(float(np.log(mean / (1 - mean))), depth)
    cuts = [np.unique(np.quantile(c, np.arange(1, bins) / bins)) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], 1)
    raw, inner = np.full(len(y), m.base), 2**depth - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        feature, cut, cut_bin = np.zeros(inner, np.int64), np.full(inner, np.inf), np.full(inner, bins)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            best = np.full(n, 1e-9)
            own = node - first
            for f in range(x.shape[1]):
                at = own * bins + binned[:, f]
                gs, hs = (np.bincount(at, w, n * bins).reshape(n, bins).cumsum(1) for w in (g, h))
                gl, hl, gr, hr = gs[:, :-1], hs[:, :-1], gs[:, -1:] - gs[:, :-1], hs[:, -1:] - hs[:, :-1]
                gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - gs[:, -1:] ** 2 / (hs[:, -1:] + l2)
                gain = np.where((hl * 4 > least) & (hr * 4 > least), gain, 0)
                k = gain.argmax(1)
                top = gain[np.arange(n), k]
                for i in np.flatnonzero((top > best) & (k < len(cuts[f]))):
                    best[i], feature[first + i], cut[first + i], cut_bin[first + i] = top[i], f, cuts[f][k[i]], k[i]
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > cut_bin[node])
        at = node - inner
        leaf = rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + l2)
        raw += leaf[at]
        m.feature.append(feature)
        m.cut.append(cut)
        m.leaf.append(leaf)
    return m
