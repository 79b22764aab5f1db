"""A forest of random-projection trees over a bounded sample of vectors, and its shared-queue search."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Trees as arrays: a node has a direction, a threshold and two children; a child below 0 is leaf -child - 1."""

    directions: np.ndarray
    thresholds: np.ndarray
    children: np.ndarray
    roots: list[int]
    leaves: int
    longest: float

    def lifted(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Vectors with one more component, such that the largest inner product is the nearest direction."""
        x = np.asarray(x, np.float64)
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.longest**2 - np.einsum("ij,ij->i", x, x), 0))
        return np.column_stack([x, more])

    def routed(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        x = self.lifted(x).astype(np.float32)
        out = np.empty((len(x), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            at = np.full(len(x), root)
            while (inner := np.flatnonzero(at >= 0)).size:
                node = at[inner]
                side = np.einsum("ij,ij->i", x[inner], self.directions[node]) > self.thresholds[node]
                at[inner] = self.children[node, side.astype(int)]
            out[:, t] = -at - 1
        return out

    def search(self, query: np.ndarray, visits: int) -> list[int]:
        """Leaves for one query, the most promising first, over all trees by one queue.

        A branch is as promising as the smallest margin by which the query lies on its side of any split above it.
        """
        q = self.lifted(query[None], query=True)[0].astype(np.float32)
        heap = [(-np.inf, r) for r in self.roots]
        out = []
        while heap and len(out) < visits:
            worst, node = heapq.heappop(heap)
            if node < 0:
                out.append(-node - 1)
                continue
            margin = float(q @ self.directions[node] - self.thresholds[node])
            left, right = self.children[node].tolist()
            heapq.heappush(heap, (max(worst, margin), left))
            heapq.heappush(heap, (max(worst, -margin), right))
        return out


def grow(sample: np.ndarray, trees: int, leaf: int, longest: float, seed: int = 11) -> Forest:
    """Trees whose splits halve the sample at the median of a projection on a line through two of its points.

    Medians keep leaves equally full wherever the vectors lie; nodes of at most ``leaf`` sample points are leaves.
    """
    rng = np.random.default_rng(seed)
    f = Forest(np.empty(0), np.empty(0), np.empty(0), [], 0, longest)
    x = f.lifted(sample).astype(np.float32) if len(sample) else np.zeros((0, 1), np.float32)
    directions, thresholds, children = [], [], []

    def node(rows: np.ndarray) -> int:
        if len(rows) > leaf:
            for _ in range(5):
                a, b = rng.choice(len(rows), 2, replace=False)
                line = x[rows[a]] - x[rows[b]]
                size = float(np.linalg.norm(line))
                if size == 0:
                    continue
                line = line / size
                along = x[rows] @ line
                cut = float(np.median(along))
                up = along > cut
                if 0 < up.sum() < len(rows):
                    here = len(directions)
                    directions.append(line)
                    thresholds.append(cut)
                    children.append([0, 0])
                    children[here] = [node(rows[~up]), node(rows[up])]
                    return here
        f.leaves += 1
        return -f.leaves

    f.roots = [node(np.arange(len(x))) for _ in range(trees)]
    f.directions = np.array(directions, np.float32).reshape(len(directions), x.shape[1])
    f.thresholds, f.children = np.array(thresholds, np.float32), np.array(children, np.int64).reshape(-1, 2)
    return f
