"""A bulk-loaded R-tree over count vectors with an overlap bound.

A point holds how many of a set's tokens fall in each hash group.  Two sets
share at most ``sum(min(a_g, b_g))`` tokens; for a node, the box's upper
corner takes the place of ``b``, so a node whose bound fails holds no partner.
Boxes and the first test of a point use groups folded ``FOLD`` to one; points
that survive are tested on all groups, where fewer differences cancel out.
"""

from __future__ import annotations

import numpy as np

FANOUT = 32
FOLD = 8


class CountTree:
    def __init__(self, points: np.ndarray, sizes: np.ndarray, num: int, den: int):
        """points: (n, groups) counts; a pair links at den * overlap >= num * union."""
        self.num, self.den = num, den
        self.fine, self.sizes = points.astype(np.int32), sizes.astype(np.int64)
        self.points = self.fine.reshape(len(points), -1, FOLD).sum(axis=2)
        spread = np.argsort(-self.points.var(axis=0), kind="stable")[:2]
        #: Sort-tile order: by size, then by the two widest coordinates inside a slab.
        order = np.argsort(self.sizes, kind="stable")
        slab = max(FANOUT, int(np.ceil(len(order) ** 0.5 / FANOUT)) * FANOUT)
        self.order = np.concatenate([s[np.lexsort(self.points[s][:, spread].T)] for s in (order[i : i + slab] for i in range(0, len(order), slab))]) if len(order) else order
        #: Boxes of each level, root first: upper corner, least and greatest size of what is below.
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        upper, least, most = self.points[self.order], self.sizes[self.order], self.sizes[self.order]
        while len(upper) > 1 or not self.levels:
            at = np.arange(0, len(upper), FANOUT)
            if len(at):
                upper, least, most = np.maximum.reduceat(upper, at, axis=0), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)
            self.levels.insert(0, (upper, least, most))

    def survives(self, bound: np.ndarray, total: np.ndarray) -> np.ndarray:
        return (self.num + self.den) * bound >= self.num * total

    def _below(self, nodes: np.ndarray, count: int) -> np.ndarray:
        at = (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
        return at[at < count]

    def leaves(self, point: np.ndarray, size: int) -> np.ndarray:
        """Leaves that may hold a partner, from the root down: best possible overlap against least union."""
        hit = np.arange(len(self.levels[0][0]))
        for depth, (upper, least, most) in enumerate(self.levels):
            if depth:
                hit = self._below(hit, len(upper))
            bound = np.minimum(upper[hit], point).sum(axis=1)
            bound = np.minimum(bound, np.minimum(most[hit], size))
            hit = hit[self.survives(bound, np.maximum(least[hit], bound) + size)]
        return hit

    def search(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(index, overlap bound) of all points that may link with point i, itself included."""
        point, size = self.points[i], int(self.sizes[i])
        idx = self.order[self._below(self.leaves(point, size), len(self.order))]
        idx = idx[self.survives(np.minimum(self.points[idx], point).sum(axis=1), self.sizes[idx] + size)]
        bound = np.minimum(self.fine[idx], self.fine[i]).sum(axis=1)
        ok = self.survives(bound, self.sizes[idx] + size)
        return idx[ok], bound[ok]
