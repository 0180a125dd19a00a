"""Gradient-boosted regression trees over binned features, in numpy."""

from __future__ import annotations

import numpy as np

BINS = 64


class BoostedTrees:
    """Squared-error boosting of depth-limited trees; split gains come from histograms of the gradients."""

    def __init__(self, rounds: int = 150, depth: int = 3, rate: float = 0.08, least: int = 8):
        self.rounds, self.depth, self.rate, self.least = rounds, depth, rate, least
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        qs = np.linspace(0, 1, BINS + 1)[1:-1]
        self.edges = np.quantile(x, qs, axis=0).T if len(x) else np.zeros((x.shape[1], BINS - 1))
        b = self._bin(x)
        self.base = float(y.mean()) if len(y) else 0.0
        at = np.full(len(y), self.base)
        for _ in range(self.rounds if len(y) else 0):
            tree = self._grow(b, y - at)
            self.trees.append(tree)
            at += self.rate * self._walk(tree, b)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = self._bin(x)
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += self.rate * self._walk(tree, b)
        return out

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1).astype(np.int16)

    def _grow(self, b: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature (-1 in leaves), bin and value by node; the children of node i are 2i + 1 and 2i + 2."""
        size = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size, int), np.zeros(size)
        node = np.zeros(len(g), int)
        for i in range(size):
            rows = np.nonzero(node == i)[0]
            if not len(rows):
                continue
            value[i] = g[rows].mean()
            if i >= 2**self.depth - 1 or len(rows) < 2 * self.least:
                continue
            best = (1e-9, -1, 0)
            for j in range(b.shape[1]):
                n = np.bincount(b[rows, j], minlength=BINS).cumsum()[:-1]
                s = np.bincount(b[rows, j], weights=g[rows], minlength=BINS).cumsum()[:-1]
                m, t = len(rows) - n, g[rows].sum() - s
                ok = (n >= self.least) & (m >= self.least)
                gain = np.where(ok, s**2 / np.maximum(n, 1) + t**2 / np.maximum(m, 1), -np.inf) - g[rows].sum() ** 2 / len(rows)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), j, k)
            if best[1] >= 0:
                feature[i], cut[i] = best[1], best[2]
                node[rows] = np.where(b[rows, best[1]] <= best[2], 2 * i + 1, 2 * i + 2)
        return feature, cut, value

    def _walk(self, tree, b: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node = np.zeros(len(b), int)
        for _ in range(self.depth):
            f = feature[node]
            inner = f >= 0
            left = b[np.arange(len(b)), np.maximum(f, 0)] <= cut[node]
            node = np.where(inner, np.where(left, 2 * node + 1, 2 * node + 2), node)
        return value[node]
