"""Small gradient-boosted trees for binary labels, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """Sum of shallow trees over binned features; each tree is arrays of a complete binary tree."""

    edges: list[np.ndarray]
    start: float
    depth: int
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # feature, bin, leaf value

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)], axis=1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned, total = self.bins(x), np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (binned[rows, feature[node]] > cut[node])
            total += leaf[node - (2**self.depth - 1)]
        return total


def fit(x: np.ndarray, y: np.ndarray, n_trees: int = 40, depth: int = 3, rate: float = 0.2, n_bins: int = 24, l2: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss, splits by histograms of gradients."""
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, n_bins + 1)[1:-1])) for k in range(x.shape[1])]
    mean = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    model = Trees(edges, float(np.log(mean / (1 - mean))), depth)
    binned, margin = model.bins(x), np.full(len(y), model.start)
    width = n_bins + 1
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        n_inner = 2**depth - 1
        feature, cut = np.zeros(n_inner, dtype=np.int64), np.full(n_inner, width, dtype=np.int64)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            for at in range(2**level - 1, 2 ** (level + 1) - 1):
                here = np.flatnonzero(node == at)
                if len(here) < 8:
                    continue
                g_all, h_all = grad[here].sum(), hess[here].sum()
                best = 1e-6
                for k in range(x.shape[1]):
                    b = binned[here, k]
                    g = np.cumsum(np.bincount(b, grad[here], width))[:-1]
                    h = np.cumsum(np.bincount(b, hess[here], width))[:-1]
                    gain = g**2 / (h + l2) + (g_all - g) ** 2 / (h_all - h + l2) - g_all**2 / (h_all + l2)
                    if gain.max() > best:
                        best, feature[at], cut[at] = gain.max(), k, int(gain.argmax())
            rows = np.arange(len(y))
            node = 2 * node + 1 + (binned[rows, feature[node]] > cut[node])
        leaf_of = node - n_inner
        g, h = np.bincount(leaf_of, grad, n_inner + 1), np.bincount(leaf_of, hess, n_inner + 1)
        leaf = rate * g / (h + l2)
        model.trees.append((feature, cut, leaf))
        margin += leaf[leaf_of]
    return model


def platt(margin: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and intercept of a logistic calibration of ``margin``, by Newton steps."""
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        w = p * (1 - p) + 1e-6
        ga, gb = ((y - p) * margin).sum() - 1e-2 * (a - 1), (y - p).sum() - 1e-2 * b
        haa, hab, hbb = (w * margin**2).sum() + 1e-2, (w * margin).sum(), w.sum() + 1e-2
        det = haa * hbb - hab**2
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a + float(np.clip(da, -1, 1)), b + float(np.clip(db, -1, 1))
        if abs(da) + abs(db) < 1e-6:
            break
    return a, b
