"""Small models that are fitted on bounded samples in the driver."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Logistic:
    """Logistic regression with a ridge penalty on standardised features, fitted by Newton steps."""

    def __init__(self, penalty: float = 1.0):
        self.penalty = penalty

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 30) -> Logistic:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = self._design(x)
        ridge = np.full(z.shape[1], self.penalty)
        ridge[0] = 1e-3
        w = np.zeros(z.shape[1])
        for _ in range(steps):
            p = sigmoid(z @ w)
            slope = z.T @ (y - p) - ridge * w
            bend = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(ridge)
            step = np.linalg.solve(bend, slope)
            w = w + step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
            if np.abs(step).max() < 1e-7:
                break
        self.weights = w
        return self

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._design(x) @ self.weights, -30, 30)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logit(x))


class Forest:
    """A random forest of shallow trees for two classes; ``share`` of the positive class if there is just one."""

    def __init__(self, trees: int = 25, depth: int = 7, least: int = 3, seed: int = 5):
        self.size, self.depth, self.least, self.seed, self.trees, self.share = trees, depth, least, seed, [], 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        self.share = float(y.mean()) if len(y) else 0.0
        if not 0 < self.share < 1:
            return self
        draw = np.random.default_rng(self.seed)
        for _ in range(self.size):
            rows = draw.integers(0, len(y), len(y))
            self.trees.append(self._grow(x[rows], y[rows], self.depth, draw))
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, draw: np.random.Generator):
        """A leaf's share, or (feature, threshold, tree up to it, tree above it)."""
        share, n = float(y.mean()), len(y)
        if depth == 0 or share in (0.0, 1.0) or n < 2 * self.least:
            return share
        best = (1e-9, None)
        width = x.shape[1]
        for k in draw.permutation(width)[: max(2, round(width**0.5)) + 1].tolist():
            order = np.argsort(x[:, k], kind="stable")
            values, ones = x[order, k], np.cumsum(y[order])
            cut = np.flatnonzero(np.diff(values) > 0) + 1
            cut = cut[(cut >= self.least) & (cut <= n - self.least)]
            if not len(cut):
                continue
            left, right = ones[cut - 1], ones[-1] - ones[cut - 1]
            gain = left**2 / cut + right**2 / (n - cut) - ones[-1] ** 2 / n
            at = int(np.argmax(gain))
            if gain[at] > best[0]:
                best = (gain[at], (k, (values[cut[at] - 1] + values[cut[at]]) / 2))
        if best[1] is None:
            return share
        k, threshold = best[1]
        low = x[:, k] <= threshold
        return k, threshold, self._grow(x[low], y[low], depth - 1, draw), self._grow(x[~low], y[~low], depth - 1, draw)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not self.trees or not len(x):
            return np.full(len(x), self.share)
        total = np.zeros(len(x))

        def walk(tree, rows: np.ndarray) -> None:
            if not isinstance(tree, tuple):
                total[rows] += tree
            elif len(rows):
                k, threshold, low, high = tree
                under = x[rows, k] <= threshold
                walk(low, rows[under]), walk(high, rows[~under])

        for tree in self.trees:
            walk(tree, np.arange(len(x)))
        return total / len(self.trees)
