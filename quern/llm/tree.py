"""A small decision tree (CART, Gini impurity) in numpy."""

from __future__ import annotations

import numpy as np


class DecisionTree:
    """Binary classification; ``fit`` is deterministic, ``predict`` gives the share of the positive class in the leaf."""

    def __init__(self, depth: int = 10, leaf: int = 4) -> None:
        self.depth, self.leaf = depth, leaf
        self.feature: list[int] = []
        self.cut: list[float] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.value: list[float] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> DecisionTree:
        self._grow(x.astype(np.float64), y.astype(np.float64), 0)
        self._arrays = [np.array(a) for a in (self.feature, self.cut, self.left, self.right, self.value)]
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int) -> int:
        node = len(self.value)
        for a, v in ((self.feature, -1), (self.cut, 0.0), (self.left, -1), (self.right, -1), (self.value, float(y.mean()) if len(y) else 0.0)):
            a.append(v)  # type: ignore[attr-defined]
        if depth == self.depth or len(y) < 2 * self.leaf or y.min() == y.max():
            return node
        best, n = (1e-9, -1, 0.0), len(y)
        whole = y.sum() * (n - y.sum()) / n
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, c = x[order, f], np.cumsum(y[order])
            k = np.arange(1, n)
            ok = (v[1:] > v[:-1]) & (k >= self.leaf) & (n - k >= self.leaf)
            if not ok.any():
                continue
            ones = c[:-1]
            rest = c[-1] - ones
            gain = np.where(ok, whole - ones * (k - ones) / k - rest * (n - k - rest) / (n - k), -1.0)
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (float(gain[i]), f, (v[i] + v[i + 1]) / 2)
        if best[1] < 0:
            return node
        _, f, cut = best
        below = x[:, f] <= cut
        self.feature[node], self.cut[node] = f, cut
        self.left[node] = self._grow(x[below], y[below], depth + 1)
        self.right[node] = self._grow(x[~below], y[~below], depth + 1)
        return node

    def predict(self, x: np.ndarray) -> np.ndarray:
        feature, cut, left, right, value = self._arrays
        at = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            f = feature[at]
            go = f >= 0
            below = x[np.arange(len(x)), np.maximum(f, 0)] <= cut[at]
            at = np.where(go, np.where(below, left[at], right[at]), at)
        return value[at]
