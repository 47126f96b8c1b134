"""Gradient-boosted trees with the logistic loss, for small feature tables."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from evidlake.llm.linear import sigmoid

BINS = 32


@dataclass
class Trees:
    edges: list[np.ndarray]
    base: float
    #: Per tree: split feature, split bin and value of each node, in heap order.
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.edges)], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        if len(x):
            binned = self.bins(x)
            for tree in self.trees:
                z += tree[2][_leaf(tree, binned)]
        return z


def _leaf(tree, binned: np.ndarray) -> np.ndarray:
    feature, cut, _ = tree
    node = np.zeros(len(binned), np.int64)
    rows = np.arange(len(binned))
    while True:
        f = feature[node]
        inner = f >= 0
        if not inner.any():
            return node
        right = binned[rows, np.maximum(f, 0)] > cut[node]
        node = np.where(inner, 2 * node + 1 + right, node)


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3) -> Trees:
    """Fit on a bounded table; every split minimises the second-order logistic loss."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS)[1:-1])) for f in range(x.shape[1])]
    share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    model = Trees(edges, float(np.log(share / (1 - share))))
    binned = model.bins(x)
    z = np.full(len(y), model.base)
    for _ in range(rounds):
        p = sigmoid(z)
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        size = 2 ** (depth + 1) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)
        members = {0: np.arange(len(y))}
        for node in range(size):
            at = members.pop(node, None)
            if at is None:
                continue
            sum_g, sum_h = g[at].sum(), h[at].sum()
            value[node] = -rate * sum_g / (sum_h + 1.0)
            if 2 * node + 2 >= size or len(at) < 10:
                continue
            best, own = 1e-3, sum_g**2 / (sum_h + 1.0)
            for f in range(x.shape[1]):
                left_g = np.cumsum(np.bincount(binned[at, f], g[at], BINS))
                left_h = np.cumsum(np.bincount(binned[at, f], h[at], BINS))
                right_g, right_h = sum_g - left_g, sum_h - left_h
                gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - own
                gain[(left_h < 0.1) | (right_h < 0.1)] = 0
                if gain.max() > best:
                    best, feature[node], cut[node] = gain.max(), f, gain.argmax()
            if feature[node] >= 0:
                right = binned[at, feature[node]] > cut[node]
                members[2 * node + 1], members[2 * node + 2] = at[~right], at[right]
        tree = (feature, cut, value)
        model.trees.append(tree)
        z += value[_leaf(tree, binned)]
    return model
