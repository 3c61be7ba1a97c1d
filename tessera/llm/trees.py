"""Gradient-boosted regression trees and isotonic calibration in NumPy.

Small enough to fit on the driver: the rows it sees are a bounded sample of
labelled rows with a few dense features each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Boosted:
    """Complete trees of one depth: node arrays are (tree, node)."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - (2**self.depth - 1)]
        return out


def fit(
    x: np.ndarray, y: np.ndarray, *, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, l2: float = 1.0, least: float = 2.0
) -> Boosted:
    """Boosting of the logistic loss by Newton steps on binned features."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    for i, c in enumerate(x.T):  # a feature that is nearly always zero gets cuts among its other values
        other = c[c != 0]
        if 0 < len(other) < n:
            cuts[i] = np.unique(np.concatenate([cuts[i], [0.0], np.quantile(other, np.linspace(0, 1, bins // 2)[:-1])]))
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
    most = max(len(c) for c in cuts) + 1
    rate_of = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
    base = float(np.log(rate_of / (1 - rate_of)))
    inner, leaves = 2**depth - 1, 2**depth
    model = Boosted(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)), base, depth)
    f = np.full(n, base)
    for k in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first = 2**level - 1
            local = node - first
            best = np.full(2**level, 1e-9)
            for j in range(width):
                at = local * most + binned[:, j]
                gs = np.bincount(at, g, 2**level * most).reshape(-1, most).cumsum(1)
                hs = np.bincount(at, h, 2**level * most).reshape(-1, most).cumsum(1)
                gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                gain[(hl < least * 0.1) | (ht - hl < least * 0.1)] = 0
                gain = gain[:, : len(cuts[j])]
                if gain.shape[1] == 0:
                    continue
                cut = gain.argmax(1)
                won = gain[np.arange(2**level), cut] > best
                for i in np.flatnonzero(won):
                    best[i] = gain[i, cut[i]]
                    model.feature[k, first + i], model.threshold[k, first + i] = j, cuts[j][cut[i]]
            node = 2 * node + 1 + (x[np.arange(n), model.feature[k, node]] > model.threshold[k, node])
        leaf = node - inner
        step = rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + l2)
        model.value[k] = step
        f += step[leaf]
    return model


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (score, probability) of the non-decreasing least-squares fit.

    Each pooled block becomes one knot at its mean score, shrunk by one virtual
    row of either label, so that no finite block is certain.
    """
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # rows, labels, scores
    for s, t in zip(score[order], y[order], strict=True):
        blocks.append([1.0, float(t), float(s)])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            n, t1, s1 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + n, blocks[-1][1] + t1, blocks[-1][2] + s1]
    if not blocks:
        return np.array([0.0]), np.array([0.5])
    b = np.array(blocks)
    return b[:, 2] / b[:, 0], np.maximum.accumulate((b[:, 1] + 0.5 * 0.2) / (b[:, 0] + 0.2))


def calibrated(raw: np.ndarray, knots: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Probabilities on the line through the knots; a thousandth keeps the order within ties."""
    p = np.interp(raw, *knots)
    return np.clip(0.999 * p + 0.001 / (1 + np.exp(-np.clip(raw, -50, 50))), 0.0, 1.0)
