"""Gradient-boosted trees in numpy: histogram splits, logistic loss, monotonic constraints, flat node arrays."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """All trees in flat arrays. Node k of tree t: go left if x[feature] <= threshold; leaves point to themselves."""

    feature: np.ndarray  # (trees, nodes) int
    threshold: np.ndarray  # (trees, nodes) float
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def leaves(self, x: np.ndarray, t: int) -> np.ndarray:
        """The nodes of tree t that the rows reach; every step moves all rows at once."""
        rows, node = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
        for _ in range(self.depth):
            go = x[rows, self.feature[t, node]] <= self.threshold[t, node]
            node = np.where(go, self.left[t, node], self.right[t, node])
        return node

    def margin(self, x: np.ndarray, trees: int | None = None) -> np.ndarray:
        """The sum of the leaves that the rows reach in the first trees, or in all."""
        x, total = np.asarray(x), np.full(len(x), self.base)
        for t in range(len(self.feature) if trees is None else trees):
            total += self.value[t, self.leaves(x, t)]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


#: Unit of the sums of gradients: whole numbers, so the order in which rows are added does not matter.
UNIT = 1 << 20


def bins_of(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """The bin of each value, a byte: bin b is at most edge b."""
    return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1).astype(np.uint8)


def histograms(binned: np.ndarray, y: np.ndarray, margin: np.ndarray, node: np.ndarray, level: int, bins: int) -> np.ndarray:
    """Sums (2, features, nodes of the level, bins) of the loss's gradients and curvatures, in whole units."""
    p = 1 / (1 + np.exp(-margin))
    place, nodes = node - (2**level - 1), 2**level
    here = place >= 0  # the others have come to a leaf above
    at = place[here] * bins
    out = np.zeros((2, binned.shape[1], nodes, bins))
    for k, value in enumerate((p - y, np.maximum(p * (1 - p), 1e-6))):
        value = np.rint(value[here] * UNIT)
        for f in range(binned.shape[1]):
            out[k, f] = np.bincount(at + binned[here, f], value, nodes * bins).reshape(nodes, bins)
    return out


def sums_held(binned: np.ndarray, y: np.ndarray, bins: int) -> Callable[[Trees, int, int], np.ndarray]:
    """The histograms of rows that are held in memory; margins are kept from tree to tree."""
    kept = {"t": 0, "margin": None}

    def sums(trees: Trees, t: int, level: int) -> np.ndarray:
        if kept["margin"] is None:
            kept["margin"] = np.full(len(y), trees.base)
        while kept["t"] < t:
            kept["margin"] += trees.value[kept["t"], trees.leaves(binned, kept["t"])]
            kept["t"] += 1
        return histograms(binned, y, kept["margin"], trees.leaves(binned, t), level, bins)

    return sums


def fit(x: np.ndarray, y: np.ndarray, monotone: dict[int, int] | None = None, bins: int = 64, **kinds) -> Trees:
    """Trees for P(y = 1) from rows held in memory."""
    x, y = np.asarray(x, np.float64), np.asarray(y, np.float64)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    return grow(edges, y.mean() if len(y) else 0.5, sums_held(bins_of(x, edges), y, bins), monotone, **kinds)


def grow(
    edges: list[np.ndarray],
    share: float,
    sums: Callable[[Trees, int, int], np.ndarray],
    monotone: dict[int, int] | None = None,
    trees: int = 60,
    depth: int = 3,
    rate: float = 0.2,
    l2: float = 1.0,
    least: float = 0.5,
) -> Trees:
    """Trees from the sums that a function of (trees over bins, number of the tree, level) gives, wherever the rows are.

    share: of rows with y = 1. monotone: +1 or -1 by feature: the prediction never falls, or never rises, with it.
    A split that breaks a constraint is not made, and the middle of a constrained split bounds both sides'
    values below it, so the constraint holds over the whole tree, and so over the sum.
    """
    monotone = monotone or {}
    size = 2 ** (depth + 1) - 1
    shape = (trees, size)
    feature, cut, threshold = np.zeros(shape, np.int64), np.zeros(shape), np.zeros(shape)
    left, right = np.tile(np.arange(size), (trees, 1)), np.tile(np.arange(size), (trees, 1))
    value = np.zeros(shape)
    share = np.clip(share, 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    over_bins = Trees(feature, cut, left, right, value, depth, base)
    for t in range(trees):
        todo = [(0, -np.inf, np.inf)]
        for level in range(depth):
            if not todo:
                break
            grads, curves = sums(over_bins, t, level) / UNIT
            below = []
            for node, low, high in todo:
                here = node - (2**level - 1)
                gain, split = 1e-6, None
                gs, hs = grads[0, here].sum(), curves[0, here].sum()
                weight = lambda a, b, low=low, high=high: np.clip(-a / (b + l2), low, high)
                score = lambda a, b, w: -(a * w + 0.5 * (b + l2) * w * w)
                own = weight(gs, hs)
                if hs >= 2 * least:
                    for f in range(len(edges)):
                        k = len(edges[f]) + 1
                        if k < 2:
                            continue
                        gl, hl = np.cumsum(grads[f, here, :k])[:-1], np.cumsum(curves[f, here, :k])[:-1]
                        wl, wr = weight(gl, hl), weight(gs - gl, hs - hl)
                        made = score(gl, hl, wl) + score(gs - gl, hs - hl, wr) - score(gs, hs, own)
                        made[(hl < least) | (hs - hl < least)] = -1
                        if f in monotone:
                            made[(wr - wl) * monotone[f] < 0] = -1
                        b = int(np.argmax(made))
                        if made[b] > gain:
                            gain, split = made[b], (f, b, wl[b], wr[b])
                if split is None:
                    value[t, node] = rate * own
                    continue
                f, b, wl, wr = split
                feature[t, node], cut[t, node], threshold[t, node] = f, b, edges[f][b]
                left[t, node], right[t, node] = 2 * node + 1, 2 * node + 2
                # What the sides are worth, should they not be split again.
                value[t, 2 * node + 1], value[t, 2 * node + 2] = rate * wl, rate * wr
                middle, low_l, high_l, low_r, high_r = (wl + wr) / 2, low, high, low, high
                if monotone.get(f, 0) > 0:
                    high_l, low_r = middle, middle
                elif monotone.get(f, 0) < 0:
                    low_l, high_r = middle, middle
                below += [(2 * node + 1, low_l, high_l), (2 * node + 2, low_r, high_r)]
            todo = below
    return Trees(feature, threshold, left, right, value, depth, base)
