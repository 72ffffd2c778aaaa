"""Groups of near points with their boxes, for searches that compare only what can be near.

A task cuts its references and the block's queries by medians of the widest dimension.  A group of
queries meets the leaves of references in the order of the least possible key between their boxes
and stops where no query of the group could gain.  Bounds are summed in the order of the dimensions
from the gaps of the boxes, so rounding never lifts a bound above a key: nothing is lost to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Rows of a leaf and of a group of queries.
LEAF = 256
GROUP = 32
#: Leaves that are compared at once, at first and at most.
FIRST, MOST = 2, 16


@dataclass(frozen=True)
class Groups:
    """``order[first[i]:first[i + 1]]`` are the rows of group i, ``low`` and ``high`` its corners."""

    order: np.ndarray
    first: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def rows(self, i: int) -> np.ndarray:
        return self.order[self.first[i] : self.first[i + 1]]


def grouped(points: np.ndarray, size: int) -> Groups:
    """Groups of at most ``size`` points."""
    order, todo = np.arange(len(points)), [(0, len(points))] if len(points) else []
    first, low, high = [], [], []
    while todo:
        a, b = todo.pop()
        own = points[order[a:b]]
        lo, hi = own.min(axis=0), own.max(axis=0)
        if b - a <= size:
            first.append(a)
            low.append(lo)
            high.append(hi)
            continue
        widest, middle = int(np.argmax(hi - lo)), (b - a) // 2
        if hi[widest] > lo[widest]:
            order[a:b] = order[a:b][np.argpartition(own[:, widest], middle)]
        todo += [(a + middle, b), (a, a + middle)]
    width = points.shape[1] if points.ndim == 2 else 0
    corners = (np.stack(x) if x else np.empty((0, width)) for x in (low, high))
    return Groups(order, np.array([*first, len(points)]), *corners)


def gaps(low: np.ndarray, high: np.ndarray, of: Groups) -> np.ndarray:
    """The least possible key between a box and each group's box."""
    total = np.zeros(len(of.low))
    for d in range(of.low.shape[1]):
        gap = np.maximum(np.maximum(of.low[:, d] - high[d], low[d] - of.high[:, d]), 0)
        total += gap * gap
    return total


def near_pairs(queries: Groups, leaves: Groups, ids: np.ndarray, best) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query rows, reference rows) to compare, given ``best`` so far (``worst`` and ``worst_id`` of each query), which is read anew at each step."""
    least_id = np.array([ids[leaves.rows(j)].min() for j in range(len(leaves.low))])
    for i in range(len(queries.low)):
        rows, bound = queries.rows(i), gaps(queries.low[i], queries.high[i], leaves)
        near = np.lexsort((least_id, bound))
        bound, at, step = bound[near], 0, FIRST
        while at < len(near):
            worst = best.worst[rows]
            rows = rows[worst >= bound[at]]
            if not len(rows):
                break
            # a leaf at the very distance of the last neighbour matters for smaller ids only
            worst, last = best.worst[rows].max(), best.worst_id[rows].max()
            some = near[at : at + step]
            reach = (bound[at : at + step] < worst) | ((bound[at : at + step] == worst) & (least_id[some] <= last))
            if reach.any():
                yield rows, np.concatenate([leaves.rows(j) for j in some[reach]])
            at, step = at + step, min(2 * step, MOST)
