"""Logistic regression on sparse rows, fitted on a bounded sample."""

from __future__ import annotations

import numpy as np


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35.0, 35.0)))


class SparseRows:
    """Rows of (column, value) lists, one after another."""

    def __init__(self, columns: list[np.ndarray], values: list[np.ndarray] | None, width: int):
        self.width = width
        self.sizes = np.array([len(c) for c in columns], np.int64)
        self.columns = np.concatenate(columns) if columns else np.zeros(0, np.int32)
        self.values = None if values is None else np.concatenate(values)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])

    def _stripes(self):
        """Ranges of rows with about a million values: large samples need little memory."""
        row = 0
        while row < len(self.sizes):
            end = int(np.searchsorted(self.starts, self.starts[row] + (1 << 20), side="right")) - 1
            end = min(max(end, row + 1), len(self.sizes))
            yield row, end, slice(self.starts[row], self.starts[end])
            row = end

    def dot(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.sizes))
        for a, b, at in self._stripes():
            got = weights[self.columns[at]]
            if self.values is not None:
                got = got * self.values[at]
            sums = np.concatenate([[0.0], np.cumsum(got)])
            out[a:b] = sums[self.starts[a + 1 : b + 1] - at.start] - sums[self.starts[a:b] - at.start]
        return out

    def add_up(self, per_row: np.ndarray) -> np.ndarray:
        out = np.zeros(self.width)
        for a, b, at in self._stripes():
            spread = np.repeat(per_row[a:b], self.sizes[a:b])
            if self.values is not None:
                spread = spread * self.values[at]
            out += np.bincount(self.columns[at], spread, self.width)
        return out


def fit(rows: SparseRows, y, scale=None, steps=80, rate=0.05, penalty=1e-4, weight=None):
    """Weights and intercept; ``scale`` multiplies every column. Adam on the whole sample."""
    scale = np.ones(rows.width) if scale is None else scale
    weight = np.ones(len(y)) if weight is None else weight
    weight = weight / max(weight.sum(), 1e-12)
    w, b = np.zeros(rows.width), 0.0
    m, v, mb, vb = np.zeros(rows.width), np.zeros(rows.width), 0.0, 0.0
    for t in range(1, steps + 1):
        error = (sigmoid(rows.dot(w * scale) + b) - y) * weight
        g = rows.add_up(error) * scale + penalty * w
        gb = error.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        a, c = 1 - 0.9**t, 1 - 0.999**t
        w -= rate * (m / a) / (np.sqrt(v / c) + 1e-10)
        b -= rate * (mb / a) / (np.sqrt(vb / c) + 1e-10)
    return w * scale, b


def calibrate(z: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, float]:
    """Platt scaling: slope and shift that make sigmoid(slope * z + shift) a probability."""
    if len(z) == 0:
        return 1.0, 0.0
    weight = np.ones(len(z)) if weight is None else weight
    up, down = (weight * y).sum(), (weight * (1 - y)).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * z + b)
        g, h = weight * (p - target), weight * np.maximum(p * (1 - p), 1e-6)
        ga, gb = (g * z).sum() + 1e-3 * (a - 1), g.sum() + 1e-6 * b
        haa, hab, hbb = (h * z * z).sum() + 1e-3, (h * z).sum(), h.sum() + 1e-6
        det = haa * hbb - hab * hab
        if det <= 0:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step = min(1.0, 5.0 / max(abs(da), abs(db), 1e-12))
        a, b = a - step * da, b - step * db
        if max(abs(da), abs(db)) < 1e-8:
            break
    return (a, b) if a > 0 else (1.0, 0.0)
