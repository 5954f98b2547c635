"""Gradient-boosted regression trees for a logistic loss, learned from sums over all rows.

Features are codes of a byte. A level of a tree is chosen from one table of sums by node, feature and bin, which
any number of tasks add up: gradients are whole multiples of 1 / UNIT, so the sums are exact and their order is of
no account. Scores are rounded to 1 / STEP, so calibration and thresholds need no more than counts by score.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

CODES, UNIT, STEP = 256, 1 << 24, 1024


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Trees:
    """Boosted trees of a fixed depth over quantile bins, with a Platt calibration fitted on rows the trees didn't see."""

    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 24, least: float = 1.0):
        self.n_trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least
        self.bin_of = np.zeros((0, CODES), np.int64)
        self.forest: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.prior, self.slope, self.shift = 0.0, 1.0, 0.0

    def _binned(self, codes: np.ndarray) -> np.ndarray:
        return self.bin_of[np.arange(codes.shape[1]), codes]

    def _down(self, b: np.ndarray, column: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
        """The node of each row, that many levels below the root."""
        node, rows = np.zeros(len(b), np.int64), np.arange(len(b))
        for _ in range(depth):
            node = 2 * node + 1 + (b[rows, column[node]] > cut[node])
        return node

    def _raw(self, b: np.ndarray) -> np.ndarray:
        out = np.full(len(b), self.prior)
        for column, cut, value in self.forest:
            out += value[self._down(b, column, cut, self.depth) - (2**self.depth - 1)]
        return out

    def histogram(self, codes: np.ndarray, y: np.ndarray, n: np.ndarray, column: np.ndarray, cut: np.ndarray, level: int) -> np.ndarray:
        """Sums of gradients and of their weights by node of a level of the next tree, feature and bin, of rows that stand for `n` each."""
        b, width = self._binned(codes), self.bins + 2
        p = sigmoid(self._raw(b))
        shape = (2**level, b.shape[1], width)
        node = self._down(b, column, cut, level) - (2**level - 1)
        flat = ((node[:, None] * b.shape[1] + np.arange(b.shape[1])) * width + b).ravel()
        sums = [np.bincount(flat, np.repeat(np.rint(x * UNIT) * n, b.shape[1]), int(np.prod(shape))) for x in (y - p, p * (1 - p))]
        return np.stack(sums).astype(np.int64).reshape(2, *shape)

    def fit(self, counts: np.ndarray, positive: int, total: int, sums: Callable[[np.ndarray, np.ndarray, int], np.ndarray]) -> Trees:
        """Learn from the number of rows with each code of each feature, and from what `sums` adds up of `histogram` over all rows."""
        upto, at = counts.cumsum(1), np.floor((total - 1) * np.linspace(0, 1, self.bins + 1)[1:])
        edges = [np.unique(np.searchsorted(c, at, "right")) for c in upto]
        self.bin_of = np.stack([np.searchsorted(e, np.arange(CODES), "right") for e in edges])
        self.prior = float(np.log((positive + 1) / (total - positive + 1)))
        width = self.bins + 2
        for _ in range(self.n_trees):
            column, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, width, np.int64)
            value = np.zeros(2**self.depth)
            for level in range(self.depth):
                g, h = sums(column, cut, level) / UNIT
                for k in range(2**level):
                    gs, hs = g[k].cumsum(1), h[k].cumsum(1)
                    all_g, all_h = gs[0, -1], hs[0, -1]
                    gain = gs**2 / (hs + self.least) + (all_g - gs) ** 2 / (all_h - hs + self.least)
                    best, here = int(np.argmax(gain)), 2**level - 1 + k
                    left = all_g, all_h
                    if gain.flat[best] > all_g**2 / (all_h + self.least) + 1e-9:
                        column[here], cut[here] = divmod(best, width)
                        left = gs.flat[best], hs.flat[best]
                    if level == self.depth - 1:
                        value[2 * k] = self.rate * left[0] / (left[1] + self.least)
                        value[2 * k + 1] = self.rate * (all_g - left[0]) / (all_h - left[1] + self.least)
            self.forest.append((column, cut, value))
        return self

    def steps(self, codes: np.ndarray) -> np.ndarray:
        """Scores before calibration, in whole steps of 1 / STEP."""
        return np.rint(np.clip(self._raw(self._binned(codes)), -30, 30) * STEP).astype(np.int64)

    def calibrate(self, step: np.ndarray, y: np.ndarray, n: np.ndarray) -> Trees:
        """Platt scaling by Newton steps on smoothed targets, from the number of rows of each score and label."""
        n1, total = float(n[y > 0].sum()), float(n.sum())
        target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (total - n1 + 2))
        design = np.stack([step / STEP, np.ones(len(step))], axis=1)
        w = np.array([1.0, 0.0])
        for _ in range(30):
            p = sigmoid(design @ w)
            move = np.linalg.solve(design.T @ (design * (n * p * (1 - p))[:, None]) + 1e-3 * np.eye(2), design.T @ (n * (target - p)) - 1e-3 * (w - [1.0, 0.0]))
            w = w + np.clip(move, -4, 4)
            if np.abs(move).max() < 1e-9:
                break
        self.slope, self.shift = float(w[0]), float(w[1])
        return self

    def of_steps(self, step: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * (step / STEP) + self.shift)

    def probability(self, codes: np.ndarray) -> np.ndarray:
        return self.of_steps(self.steps(codes))
