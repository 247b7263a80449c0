"""Gradient-boosted trees for two classes, with calibrated probabilities, in numpy."""

from __future__ import annotations

import numpy as np

BINS = 32


class Boosted:
    """Complete trees of one depth. Plain arrays, so the model travels inside a closure."""

    def __init__(self, depth: int = 3) -> None:
        self.depth, self.trees, self.bias, self.scale, self.shift = depth, [], 0.0, 1.0, 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.bias), np.arange(len(x))
        for feature, cut, leaf in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += leaf[at - (2**self.depth - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * self.raw(x) + self.shift)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, ridge: float = 1.0, least: int = 8) -> Boosted:
    """Newton boosting of the logistic loss over quantile bins."""
    model = Boosted(depth)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model.bias = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
    margin = np.full(len(y), model.bias)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        inner = 2**depth - 1
        feature, cut, leaf = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf), np.zeros(inner + 1)
        at = np.zeros(len(y), dtype=np.int64)
        for node in range(inner):
            rows = np.flatnonzero(at == node)
            best = 1e-6
            if len(rows) >= 2 * least:
                g, h = grad[rows], hess[rows]
                whole = g.sum() ** 2 / (h.sum() + ridge)
                for j, c in enumerate(cuts):
                    b = binned[rows, j]
                    gl, hl, nl = (np.cumsum(np.bincount(b, w, len(c) + 1))[:-1] for w in (g, h, np.ones(len(rows))))
                    if not len(gl):
                        continue
                    gain = gl**2 / (hl + ridge) + (g.sum() - gl) ** 2 / (h.sum() - hl + ridge) - whole
                    gain[(nl < least) | (len(rows) - nl < least)] = 0
                    k = int(gain.argmax())
                    if gain[k] > best:
                        best, feature[node], cut[node] = gain[k], j, c[k]
            at[rows] = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
        for k in range(inner + 1):
            rows = at == inner + k
            leaf[k] = -rate * grad[rows].sum() / (hess[rows].sum() + ridge)
        margin = margin + leaf[at - inner]
        model.trees.append((feature, cut, leaf))
    return model


def calibrate(model: Boosted, x: np.ndarray, y: np.ndarray, steps: int = 50) -> None:
    """Platt scaling on rows that the trees haven't seen; targets are smoothed."""
    raw = model.raw(x)
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    z, w = np.column_stack([raw, np.ones(len(raw))]), np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-z @ w))
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        w = w - np.linalg.solve(h, z.T @ (p - t) + 1e-3 * (w - [1.0, 0.0]))
    model.scale, model.shift = float(w[0]), float(w[1])


def threshold(score: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest cut whose selection reaches the precision; 0.5 at least."""
    order = np.argsort(-score, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero((right >= precision) & (score[order] >= 0.5))
    return float(score[order][good[-1]]) if len(good) else 1.0
