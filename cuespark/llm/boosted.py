"""Gradient-boosted trees in numpy: logistic loss, histogram splits, monotonic constraints.

A fitted model is five flat node arrays (feature, threshold, left, right, value) with the roots of all
trees, so scoring walks every tree for every row with a few gathers per level.  A constraint of -1 (+1)
on a feature makes the score never rise (fall) as that feature grows: a split on it must order its
children's values so, and the values below either child stay on their side of the midpoint.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row of ``x``; leaves point at themselves, so all trees take ``depth`` steps."""
        if not len(self.roots):
            return np.full(len(x), self.base)
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            go_left = x[rows, self.feature[at]] <= self.threshold[at]
            at = np.where(go_left, self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margin(x)))


def constant(p: float) -> Trees:
    """The model of no labels, or of labels all alike."""
    none = np.zeros(0, np.int64)
    p = min(max(p, 1e-6), 1 - 1e-6)
    return Trees(none, np.zeros(0), none, none, np.zeros(0), none, float(np.log(p / (1 - p))), 0)


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, n_trees: int = 80, depth: int = 3, rate: float = 0.2, bins: int = 64, least: float = 20.0, ridge: float = 1.0) -> Trees:
    """Fit on ``x`` (rows, features) and labels ``y`` in {0, 1}; deterministic for a given row order."""
    mean = float(y.mean()) if len(y) else 1.0
    if not 0 < mean < 1:
        return constant(mean)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])  # bin b: x <= cuts[b]
    base = float(np.log(mean / (1 - mean)))
    score = np.full(len(y), base)
    nodes: list[list[float]] = []
    roots = []

    def leaf(value: float) -> int:
        nodes.append([0, np.inf, len(nodes), len(nodes), value])
        return len(nodes) - 1

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        own = float(np.clip(-total_g / (total_h + ridge), low, high))
        best = (1e-6, None)
        if level < depth and len(rows) >= 2 * least:
            for f in range(x.shape[1]):
                n = len(cuts[f]) + 1
                column = binned[rows, f]
                gl = np.cumsum(np.bincount(column, g[rows], n))[:-1]
                hl = np.cumsum(np.bincount(column, h[rows], n))[:-1]
                nl = np.cumsum(np.bincount(column, minlength=n))[:-1]
                gr, hr, nr = total_g - gl, total_h - hl, len(rows) - nl
                vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-gr / (hr + ridge), low, high)
                gain = -(gl * vl + (hl + ridge) * vl**2 / 2) - (gr * vr + (hr + ridge) * vr**2 / 2) + (total_g * own + (total_h + ridge) * own**2 / 2)
                gain = np.where((nl >= least) & (nr >= least) & (monotone[f] * (vr - vl) >= 0), gain, 0)
                if len(gain) and gain.max() > best[0]:
                    b = int(gain.argmax())
                    best = (float(gain[b]), (f, b, float(vl[b]), float(vr[b])))
        if best[1] is None:
            return leaf(own * rate)
        f, b, vl, vr = best[1]
        middle = (vl + vr) / 2
        sides = [(low, high), (low, high)]
        if monotone[f] < 0:
            sides = [(middle, high), (low, middle)]
        elif monotone[f] > 0:
            sides = [(low, middle), (middle, high)]
        here = leaf(0.0)
        go = binned[rows, f] <= b
        children = [grow(part, g, h, level + 1, *side) for part, side in zip((rows[go], rows[~go]), sides, strict=True)]
        nodes[here] = [f, float(cuts[f][b]), *children, 0.0]
        return here

    every = np.arange(len(y))
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-score))
        roots.append(grow(every, p - y, p * (1 - p), 0, -np.inf, np.inf))
        table = np.array(nodes[roots[-1] :])
        at = np.zeros(len(y), np.int64)
        for _ in range(depth):
            go_left = x[every, table[at, 0].astype(int)] <= table[at, 1]
            at = np.where(go_left, table[at, 2], table[at, 3]).astype(np.int64) - roots[-1]
        score = score + table[at, 4]
    flat = np.array(nodes)
    return Trees(flat[:, 0].astype(np.int64), flat[:, 1], flat[:, 2].astype(np.int64), flat[:, 3].astype(np.int64), flat[:, 4], np.array(roots), base, depth)
