"""Gradient-boosted trees for two classes: logistic loss, second-order gains, quantile bins."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Tree:
    """A complete binary tree: node i has the children 2i + 1 (x < cut) and 2i + 2; feature -1 marks a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray


@dataclass(frozen=True)
class Boosted:
    base: float
    trees: tuple[Tree, ...]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for t in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                f = t.feature[at]
                if (f < 0).all():
                    break
                step = 2 * at + 1 + (x[rows, np.maximum(f, 0)] >= t.cut[at])
                at = np.where(f < 0, at, step)
            out += t.value[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 64, l2: float = 1.0, min_hessian: float = 1.0) -> Boosted:
    """Deterministic: no rows or features are drawn."""
    x, y = np.asarray(x, np.float64), np.asarray(y, np.float64)
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:], method="nearest")) for f in range(width)]
    # bins of all features in one range, so that a level's histograms are one count
    first = np.concatenate([[0], np.cumsum([len(c) + 1 for c in cuts])])
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], "right") + first[f] for f in range(width)], 1)
    every, last = int(first[-1]), first[1:] - 1
    owner = np.repeat(np.arange(width), np.diff(first))
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    margin = np.full(n, base)
    out = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        size = 2 ** (depth + 1) - 1
        feature, cut, value = np.full(size, -1, np.int64), np.zeros(size), np.zeros(size)
        at = np.zeros(n, np.int64)
        for level in range(depth + 1):
            top, count = 2**level - 1, 2**level
            live = np.flatnonzero(at >= top)
            if not len(live):
                break
            own = at[live] - top
            gs, hs = np.bincount(own, g[live], count), np.bincount(own, h[live], count)
            value[top : top + count] = -rate * gs / (hs + l2)
            if level == depth:
                break
            place = (own[:, None] * every + binned[live]).ravel()
            left_g = np.cumsum(np.bincount(place, np.repeat(g[live], width), count * every).reshape(count, every), 1)
            left_h = np.cumsum(np.bincount(place, np.repeat(h[live], width), count * every).reshape(count, every), 1)
            # sums within each feature
            left_g -= owner * gs[:, None]
            left_h -= owner * hs[:, None]
            right_g, right_h = gs[:, None] - left_g, hs[:, None] - left_h
            gain = left_g**2 / (left_h + l2) + right_g**2 / (right_h + l2) - (gs**2 / (hs + l2))[:, None]
            gain[(left_h < min_hessian) | (right_h < min_hessian)] = 0
            gain[:, last] = 0
            pick = gain.argmax(1)
            for k in range(count):
                if gain[k, pick[k]] > 1e-6:
                    f = int(owner[pick[k]])
                    feature[top + k], cut[top + k] = f, cuts[f][pick[k] - first[f]]
            f = feature[at[live]]
            moved = 2 * at[live] + 1 + (x[live, np.maximum(f, 0)] >= cut[at[live]])
            at[live] = np.where(f < 0, at[live], moved)
        margin += value[at]
        out.append(Tree(feature, cut, value))
    return Boosted(base, tuple(out))
