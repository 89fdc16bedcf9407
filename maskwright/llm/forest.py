"""A forest of random-projection trees over vectors, searched through one shared priority queue.

A tree splits a bounded sample in halves again and again. All nodes of one level of a tree project
on the same random direction and differ in their threshold, the median of the sample there, so that
a block of vectors finds its leaves with one matrix product. Every vector of the table, of the
sample or not, belongs to one leaf of each tree.

A query starts at all roots. What waits in its queue is ordered by how far the query would have to
move to get there: the sum of the squared margins of the splits crossed. Leaves come out nearest
first, over all trees, until they hold enough vectors.
"""

from __future__ import annotations

import heapq

import numpy as np


class Forest:
    """``trees`` complete trees of one depth, whose leaves hold about ``leaf`` vectors of the sample."""

    def __init__(self, sample: np.ndarray, trees: int, leaf: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        n, d = sample.shape if len(sample) else (0, sample.shape[1])
        self.depth = max(0, int(np.floor(np.log2(max(1, n / leaf)))))
        self.trees, self.leaves = trees, 2**self.depth
        directions = rng.normal(size=(trees, self.depth, d))
        if n > 1:  # directions along which the sample really spreads: between two of its vectors
            a, b = rng.integers(0, n, (2, trees, self.depth, 8))
            directions = (sample[a] - sample[b]).mean(axis=2) + 1e-9 * directions
        self.directions = directions / np.maximum(np.linalg.norm(directions, axis=2, keepdims=True), 1e-12)
        self.bounds = np.zeros((trees, max(1, self.leaves - 1)))
        cast = self.project(sample)
        for t in range(trees):
            node = np.zeros(n, dtype=np.int64)
            for level in range(self.depth):
                order = np.lexsort((cast[:, t, level], node))
                sizes = np.bincount(node, minlength=2**level)
                ends = np.cumsum(sizes)
                middle = np.minimum(ends - sizes + sizes // 2, n - 1)
                self.bounds[t, 2**level - 1 : 2 ** (level + 1) - 1] = cast[order[middle], t, level]
                node = node * 2 + (cast[:, t, level] >= self.bounds[t, 2**level - 1 + node])

    def project(self, x: np.ndarray) -> np.ndarray:
        """Projections of each vector: trees x levels."""
        return (x @ self.directions.reshape(-1, self.directions.shape[2]).T).reshape(len(x), self.trees, self.depth)

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        cast = self.project(x)
        node = np.zeros((len(x), self.trees), dtype=np.int64)
        tree = np.arange(self.trees)
        for level in range(self.depth):
            node = node * 2 + (cast[:, :, level] >= self.bounds[tree, 2**level - 1 + node])
        return node

    def probes(self, x: np.ndarray, held: np.ndarray, enough: int) -> list[list[tuple[int, int]]]:
        """For each query the (tree, leaf) to look into: nearest first until they hold ``enough`` vectors.

        ``held``: vectors in each leaf, trees x leaves.
        """
        out = []
        bounds, sizes = self.bounds.tolist(), held.tolist()
        for cast in self.project(x).tolist():
            waiting = [(0.0, t, 0, 0) for t in range(self.trees)]
            found, total = [], 0
            while waiting and total < enough:
                far, t, level, node = heapq.heappop(waiting)
                own, limits = cast[t], bounds[t]
                while level < self.depth:
                    margin = own[level] - limits[2**level - 1 + node]
                    side = margin >= 0
                    level += 1
                    heapq.heappush(waiting, (far + margin * margin, t, level, node * 2 + (not side)))
                    node = node * 2 + side
                if sizes[t][node]:
                    found.append((t, node))
                    total += sizes[t][node]
            out.append(found)
        return out
