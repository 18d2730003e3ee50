"""A geometric near-neighbour access tree over a few integer points, asked with many queries at once.

A node holds split points and a subtree for each, of the points nearest to it.  For every split
point and subtree the tree keeps the range of distances between the two; a query's distance to the
split point then bounds its distance to all of the subtree.  Bounds are computed in doubles rounded
away from elimination, a subtree falls only where its bound lies strictly beyond the best distance,
and what is compared in the end are squared distances in integers, ties to the lower index.
"""

from __future__ import annotations

import numpy as np

SPLITS = 8
LEAF = 8
_UP, _DOWN = 1 + 2.0 ** -48, 1 - 2.0 ** -48


def squared(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Squared distances of each row of ``q`` to each row of ``p``, exact in 64 bits."""
    d = np.zeros((len(q), len(p)), np.int64)
    for k in range(q.shape[1]):
        d += (q[:, k, None] - p[None, :, k]) ** 2
    return d


class Gnat:
    def __init__(self, points: np.ndarray, index: np.ndarray | None = None):
        index = np.arange(len(points)) if index is None else index
        self.index, self.points, self.children = index, points[index], []
        if len(index) <= LEAF:
            return
        chosen = [0]  # far from each other: each is the farthest from those before
        away = squared(self.points, self.points[:1])[:, 0]
        while len(chosen) < SPLITS and away.max() > 0:
            chosen.append(int(away.argmax()))
            away = np.minimum(away, squared(self.points, self.points[chosen[-1:]])[:, 0])
        if len(chosen) < 2:  # all points alike
            return
        d = squared(self.points, self.points[chosen])
        group = d.argmin(axis=1)
        rest = np.ones(len(index), bool)
        rest[chosen] = False
        reach = np.sqrt(d.astype(np.float64))
        low, high = [], []
        for j in range(len(chosen)):
            members = np.flatnonzero((group == j) & rest)
            if len(members):
                low.append(reach[members].min(axis=0) * _DOWN)
                high.append(reach[members].max(axis=0) * _UP)
                self.children.append(Gnat(points, index[members]))
        self.low, self.high = (np.array(x).reshape(len(self.children), len(chosen)) for x in (low, high))
        self.index, self.points = index[chosen], self.points[chosen]

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest point of each query and the squared distance."""
        best = np.full(len(q), np.iinfo(np.int64).max)
        at = np.full(len(q), np.iinfo(np.int64).max)
        self._visit(q, np.arange(len(q)), best, at)
        return at, best

    def _visit(self, q: np.ndarray, rows: np.ndarray, best: np.ndarray, at: np.ndarray) -> None:
        d = squared(q[rows], self.points)
        least = d.min(axis=1)
        # of equally near points the one of the lowest index
        first = np.where(d == least[:, None], self.index[None, :], np.iinfo(np.int64).max).min(axis=1)
        better = (least < best[rows]) | ((least == best[rows]) & (first < at[rows]))
        best[rows[better]], at[rows[better]] = least[better], first[better]
        if not self.children:
            return
        reach = np.sqrt(d.astype(np.float64))
        for child, low, high in zip(self.children, self.low, self.high):
            bound = np.maximum(reach * _DOWN - high, low - reach * _UP).max(axis=1)
            alive = bound <= np.sqrt(best[rows].astype(np.float64)) * _UP
            if alive.any():
                child._visit(q, rows[alive], best, at)
