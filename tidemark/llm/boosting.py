"""Gradient-boosted trees for two classes: binned features, trees of fixed depth, Newton leaf values."""

from __future__ import annotations

import numpy as np

BINS = 32


class Boosted:
    """score(x) is the log odds of class 1."""

    def __init__(self, depth: int = 4):
        self.depth, self.edges, self.start = depth, [], 0.0
        self.feature: list[np.ndarray] = []
        self.cut: list[np.ndarray] = []
        self.leaf: list[np.ndarray] = []

    def dump(self) -> dict:
        """As plain numbers, for a file."""
        return {"depth": self.depth, "start": self.start, "edges": [e.tolist() for e in self.edges], "feature": [f.tolist() for f in self.feature], "cut": [c.tolist() for c in self.cut], "leaf": [x.round(6).tolist() for x in self.leaf]}

    @classmethod
    def load(cls, d: dict) -> Boosted:
        out = cls(d["depth"])
        out.start, out.edges = d["start"], [np.array(e) for e in d["edges"]]
        for name in ("feature", "cut", "leaf"):
            setattr(out, name, [np.array(x) for x in d[name]])
        return out

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        bins, rows = self._binned(x), np.arange(len(x))
        out = np.full(len(x), self.start)
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (bins[rows, feature[node]] > cut[node])
            out += leaf[node - (1 << self.depth) + 1]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.25, ridge: float = 1.0) -> Boosted:
    n, width = x.shape
    model = Boosted(depth)
    model.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(width)]
    bins = model._binned(x)
    flat = bins + np.arange(width) * BINS
    p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model.start = np.log(p / (1 - p))
    now = np.full(n, model.start)
    rows = np.arange(n)
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-now))
        grad, hess = y - prob, prob * (1 - prob)
        feature, cut = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, BINS, np.int64)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, many = (1 << level) - 1, 1 << level
            at = ((node - first)[:, None] * (width * BINS) + flat).ravel()
            g, h = (np.bincount(at, np.repeat(v, width), many * width * BINS).reshape(many, width, BINS).cumsum(2) for v in (grad, hess))
            all_g, all_h = g[:, :1, -1:], h[:, :1, -1:]
            gain = g**2 / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge) - all_g**2 / (all_h + ridge)
            best = gain[:, :, :-1].reshape(many, -1).argmax(1)
            feature[first : first + many], cut[first : first + many] = best // (BINS - 1), best % (BINS - 1)
            node = 2 * node + 1 + (bins[rows, feature[node]] > cut[node])
        leaf_of = node - (1 << depth) + 1
        leaf = rate * np.bincount(leaf_of, grad, 1 << depth) / (np.bincount(leaf_of, hess, 1 << depth) + ridge)
        now += leaf[leaf_of]
        model.feature.append(feature)
        model.cut.append(cut)
        model.leaf.append(leaf)
    return model
