"""A small gradient-boosted classifier (logistic loss, depth-limited trees) fitted with numpy."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Trees of ``depth`` over quantile-binned features; deterministic for equal input."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, least: int = 5):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        x, y = np.asarray(x, float), np.asarray(y, float)
        mean = np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3)
        self.base = float(np.log(mean / (1 - mean)))
        if len(y) == 0 or y.min() == y.max():
            return self
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree: list = []
            score += self.rate * self._grow(tree, x, y - p, p * (1 - p), np.arange(len(y)), cuts, self.depth)
            self.trees.append(tree)
        return self

    def _grow(self, tree: list, x, g, h, rows, cuts, depth) -> np.ndarray:
        """Append this node (and below) to ``tree``; the values of all rows of ``x`` that reach it."""
        out = np.zeros(len(g))
        best = (0.0, -1, 0.0)
        total_g, total_h = g[rows].sum(), h[rows].sum() + 1.0
        if depth and len(rows) >= 2 * self.least:
            whole = total_g**2 / total_h
            for j, cut in enumerate(cuts):
                if not len(cut):
                    continue
                slot = np.searchsorted(cut, x[rows, j], side="left")
                gs = np.bincount(slot, g[rows], len(cut) + 1).cumsum()[:-1]
                hs = np.bincount(slot, h[rows], len(cut) + 1).cumsum()[:-1]
                ns = np.bincount(slot, minlength=len(cut) + 1).cumsum()[:-1]
                gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs) - whole
                gain[(ns < self.least) | (len(rows) - ns < self.least)] = -1
                k = int(gain.argmax())
                if gain[k] > best[0] + 1e-12:
                    best = (float(gain[k]), j, float(cut[k]))
        if best[1] < 0:
            value = float(total_g / total_h)
            tree.append(("leaf", value))
            out[rows] = value
            return out
        at = len(tree)
        tree.append(None)
        left = x[rows, best[1]] <= best[2]
        out += self._grow(tree, x, g, h, rows[left], cuts, depth - 1)
        right = len(tree)
        out += self._grow(tree, x, g, h, rows[~left], cuts, depth - 1)
        tree[at] = ("split", best[1], best[2], right)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float)
        score = np.full(len(x), self.base)
        for tree in self.trees:
            score += self.rate * self._value(tree, 0, x, np.arange(len(x)))
        return 1 / (1 + np.exp(-score))

    def _value(self, tree, at, x, rows) -> np.ndarray:
        out = np.zeros(len(x))
        node = tree[at]
        if node[0] == "leaf":
            out[rows] = node[1]
            return out
        left = x[rows, node[1]] <= node[2]
        if left.any():
            out += self._value(tree, at + 1, x, rows[left])
        if not left.all():
            out += self._value(tree, node[3], x, rows[~left])
        return out
