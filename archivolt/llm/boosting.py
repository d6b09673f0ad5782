"""Histogram gradient-boosted trees for a binary label, kept as flat numpy node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """All trees' nodes in flat arrays. A leaf points at itself, so traversal takes `depth` steps for every row."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))
        total = np.full(len(x), self.base)
        for root in self.roots:
            at = np.full(len(x), root, np.int32)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            total += self.value[at]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -60, 60)))


def constant(probability: float) -> Forest:
    """A forest without trees."""
    none, p = np.zeros(0, np.int32), min(max(probability, 1e-6), 1 - 1e-6)
    return Forest(none, np.zeros(0), none, none, np.zeros(0), none, 0, float(np.log(p / (1 - p))))


def fit(
    x: np.ndarray,
    y: np.ndarray,
    trees: int = 60,
    depth: int = 4,
    bins: int = 64,
    rate: float = 0.2,
    ridge: float = 1.0,
    least_rows: int = 5,
    monotone: dict[int, int] | None = None,
) -> Forest:
    """Fits a forest. monotone: feature -> +1 or -1, the sense in which the score may change with that feature: a split
    against it is refused and the values below a split stay on their side of the middle between its children."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    if len(y) == 0 or y.min() == y.max():
        return constant(float(y.mean()) if len(y) else 0.5)
    monotone = monotone or {}
    edges = [np.unique(np.quantile(x[:, f], np.arange(1, bins) / bins)) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    out = constant(float(y.mean()))
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    margin = np.full(len(y), out.base)

    def node(v: float) -> int:
        k = len(feature)
        feature.append(0), threshold.append(np.inf), left.append(k), right.append(k), value.append(v)
        return k

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
        weight = lambda g, h: g / (h + ridge)
        root = node(0.0)
        roots.append(root)
        todo = [(root, np.arange(len(y)), -np.inf, np.inf, 0)]
        while todo:
            k, rows, low, high, level = todo.pop()
            g, h = grad[rows].sum(), hess[rows].sum()
            best, most = None, 1e-6
            if level < depth and len(rows) >= 2 * least_rows:
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    b = binned[rows, f]
                    n = np.cumsum(np.bincount(b, minlength=len(e) + 1))[:-1]
                    gl = np.cumsum(np.bincount(b, grad[rows], len(e) + 1))[:-1]
                    hl = np.cumsum(np.bincount(b, hess[rows], len(e) + 1))[:-1]
                    gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
                    ok = (n >= least_rows) & (len(rows) - n >= least_rows)
                    if f in monotone:
                        ok &= monotone[f] * (weight(g - gl, h - hl) - weight(gl, hl)) >= 0
                    gain = np.where(ok, gain, -1)
                    if gain.max() > most:
                        most, best = gain.max(), (f, int(gain.argmax()))
            if best is None:
                value[k] = rate * float(np.clip(weight(g, h), low, high))
                margin[rows] += value[k]
                continue
            f, cut = best
            goes = binned[rows, f] <= cut
            bounds = [(low, high), (low, high)]
            if f in monotone:
                wl, wr = (float(np.clip(weight(grad[r].sum(), hess[r].sum()), low, high)) for r in (rows[goes], rows[~goes]))
                mid = (wl + wr) / 2
                bounds = [(low, mid), (mid, high)] if monotone[f] > 0 else [(mid, high), (low, mid)]
            feature[k], threshold[k] = f, float(edges[f][cut])
            left[k], right[k] = node(0.0), node(0.0)
            todo += [(left[k], rows[goes], *bounds[0], level + 1), (right[k], rows[~goes], *bounds[1], level + 1)]
    ints = lambda v: np.array(v, np.int32)
    return Forest(ints(feature), np.array(threshold), ints(left), ints(right), np.array(value), ints(roots), depth, out.base)
