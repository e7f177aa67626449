"""A ball tree over the rows of one shard, and best-first search for the largest inner products in it.

A node holds a run of rows, the mean of these and the radius around it. The inner product of q with any row of a node is at
most q . centre + |q| * radius. A node with more than ``leaf`` rows is halved at the median along the line between two of
its rows that lie far apart. Search opens nodes by their bound, the highest first, and ends when the highest bound left is
below the score that a row must reach; equal bounds are opened, as ties are told apart by ids.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

LEAF = 128
#: Bounds are rounded up by this share, so that no rounding error in them hides a row.
SLACK = 1e-9


@dataclass
class BallTree:
    """rows stand in the order of the leaves; ids[offsets[i]:offsets[i+1]] are the ids of row i, in order."""

    rows: np.ndarray
    ids: np.ndarray
    offsets: np.ndarray
    centres: np.ndarray
    radii: np.ndarray
    nodes: np.ndarray  # start, end, left, right; left is -1 for a leaf

    FIELDS = ("rows", "ids", "offsets", "centres", "radii", "nodes")

    def packed(self) -> dict[str, bytes]:
        return {f: np.ascontiguousarray(getattr(self, f)).tobytes() for f in self.FIELDS}

    @classmethod
    def unpacked(cls, found: dict[str, bytes], width: int) -> BallTree:
        floats, longs = (lambda f: np.frombuffer(found[f], np.float64)), (lambda f: np.frombuffer(found[f], np.int64))
        return cls(floats("rows").reshape(-1, width), longs("ids"), longs("offsets"), floats("centres").reshape(-1, width), floats("radii"), longs("nodes").reshape(-1, 4))

    @classmethod
    def built(cls, rows: np.ndarray, ids: list[np.ndarray], leaf: int = LEAF) -> BallTree:
        order, centres, radii, nodes = np.arange(len(rows)), [], [], []
        todo = [(0, len(rows), -1)]
        while todo:
            start, end, above = todo.pop()
            mine = order[start:end]
            x = rows[mine]
            centre = x.mean(0)
            far = ((x - centre) ** 2).sum(1)
            here = len(nodes)
            nodes.append([start, end, -1, -1])
            centres.append(centre)
            radii.append(np.sqrt(far.max()) * (1 + SLACK))
            if above >= 0:
                nodes[above][2 if nodes[above][2] < 0 else 3] = here
            if end - start > leaf and far.max() > 0:
                one = x[far.argmax()]
                other = x[((x - one) ** 2).sum(1).argmax()]
                half = (end - start) // 2
                order[start:end] = mine[np.argpartition(x @ (other - one), half)]
                todo += [(start + half, end, here), (start, start + half, here)]
        sizes = np.array([len(ids[i]) for i in order], np.int64)
        return cls(rows[order], np.concatenate([ids[i] for i in order]).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), np.array(centres), np.array(radii), np.array(nodes, np.int64))


class Best:
    """The k best (score, id) so far of each query; ties go to the smaller id."""

    def __init__(self, floors: np.ndarray, k: int) -> None:
        self.k = k
        self.scores = np.full((len(floors), k), -np.inf)
        self.ids = np.full((len(floors), k), np.iinfo(np.int64).max)
        self.floors = floors.astype(float).copy()

    def offer(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate([self.scores[q], scores]), np.concatenate([self.ids[q], ids])
        order = np.lexsort((i, -s))[: self.k]
        self.scores[q], self.ids[q] = s[order], i[order]
        self.floors[q] = max(self.floors[q], self.scores[q, -1])


def search(tree: BallTree, queries: np.ndarray, best: Best, at_once: int = 1024) -> int:
    """Takes the shard's rows into best; gives the number of leaves that were scored."""
    scored = 0
    nodes = tree.nodes.tolist()
    lengths = np.sqrt((queries * queries).sum(1))
    for begin in range(0, len(queries), at_once):
        part = queries[begin : begin + at_once]
        reach = lengths[begin : begin + at_once, None] * tree.radii[None, :]
        middle = part @ tree.centres.T
        bounds = middle + reach + SLACK * (np.abs(middle) + reach) + SLACK
        for i, q in enumerate(part):
            bound, at = bounds[i].tolist(), begin + i
            heap = [(-bound[0], 0)]
            while heap and -heap[0][0] >= best.floors[at]:
                start, end, left, right = nodes[heapq.heappop(heap)[1]]
                if left >= 0:
                    for n in (left, right):
                        if bound[n] >= best.floors[at]:
                            heapq.heappush(heap, (-bound[n], n))
                    continue
                scored += 1
                s = tree.rows[start:end] @ q
                met = np.flatnonzero(s >= best.floors[at])
                if len(met):
                    cuts = [(tree.offsets[start + m], tree.offsets[start + m + 1]) for m in met]
                    best.offer(at, np.repeat(s[met], [b - a for a, b in cuts]), np.concatenate([tree.ids[a:b] for a, b in cuts]))
    return scored
