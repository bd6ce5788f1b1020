"""Burkhard-Keller forests over bit fingerprints, built and searched a level at a time with numpy.

A tree's children hang at the integer Hamming distance to their parent. By the triangle
inequality a search with radius r that is at distance d of a node follows only the edges
d - r to d + r.
"""

from __future__ import annotations

import numpy as np

#: Pairs of (query, node) that one step of a search holds at most, times the children of a node.
FRONTIER = 1 << 18


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of rows of 64-bit words."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def roots_of(parent: np.ndarray) -> np.ndarray:
    """Each node's root in a forest of parent pointers."""
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def join_pairs(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each a node's least partner) after joining the classes of a[i] and b[i]."""
    while len(a):
        a, b = label[a], label[b]
        open_ = a != b
        a, b = a[open_], b[open_]
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(label, high, low)
        label = roots_of(label)
    return label


class Forest:
    """One tree for each shard of the rows given. `words`: n x w fingerprints; `shard`: n shard numbers.

    Rows that are within `near` of a node on their way down while the trees are built
    are joined at once; `label` holds the classes so far (those given, to begin with).
    """

    def __init__(self, words: np.ndarray, shard: np.ndarray, near: int, label: np.ndarray | None = None):
        n, self.words = len(words), words
        self.bits = 64 * words.shape[1]
        first = np.unique(shard, return_index=True)[1]
        self.root = first[np.searchsorted(shard[first], shard)] if n else np.zeros(0, np.int64)
        self.label = np.arange(n) if label is None else label
        self.parent, self.edge, self.depth = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
        waiting = np.flatnonzero(self.root != np.arange(n))
        at, depth = self.root[waiting], 0
        while len(waiting):
            depth += 1
            d = distance(words[waiting], words[at])
            close = (d <= near) & (self.label[waiting] != self.label[at])
            self.label = join_pairs(self.label, waiting[close], at[close])
            key = at * (self.bits + 1) + d
            order = np.argsort(key, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
            child = order[starts]  # the first of those that go down the same edge becomes the child
            new = waiting[child]
            self.parent[new], self.edge[new], self.depth[new] = at[child], d[child], depth
            down = np.empty(len(waiting), np.int64)
            down[order] = np.repeat(new, np.diff(np.r_[starts, len(order)]))
            rest = down != waiting
            waiting, at = waiting[rest], down[rest]
        inner = np.flatnonzero(self.parent != np.arange(n))
        keys = self.parent[inner] * (self.bits + 1) + self.edge[inner]
        order = np.argsort(keys)
        self.child_keys, self.children = keys[order], inner[order]

    def _pure(self) -> np.ndarray:
        """Whether the whole subtree of a node has the node's own label."""
        pure = np.ones(len(self.label), bool)
        for depth in range(int(self.depth.max(initial=0)), 0, -1):
            nodes = np.flatnonzero(self.depth == depth)
            bad = nodes[~pure[nodes] | (self.label[nodes] != self.label[self.parent[nodes]])]
            pure[self.parent[bad]] = False
        return pure

    def search(self, queries: np.ndarray, radius: int):
        """Yields arrays (query, node, distance) of pairs within the radius whose labels differ.

        Subtrees that hold only the query's own class aren't entered: they have no new link.
        """
        pure = self._pure()
        stack = [(queries[i : i + 4096], self.root[queries[i : i + 4096]]) for i in range(0, len(queries), 4096)]
        while stack:
            q, node = stack.pop()
            if len(q) > FRONTIER:
                half = len(q) // 2
                stack += [(q[:half], node[:half]), (q[half:], node[half:])]
                continue
            same = self.label[q] == self.label[node]
            d = distance(self.words[q], self.words[node])
            found = (d <= radius) & ~same
            if found.any():
                yield q[found], node[found], d[found]
            go = ~(same & pure[node])
            q, node, d = q[go], node[go], d[go]
            low = np.searchsorted(self.child_keys, node * (self.bits + 1) + np.maximum(d - radius, 0), "left")
            high = np.searchsorted(self.child_keys, node * (self.bits + 1) + np.minimum(d + radius, self.bits), "right")
            n = high - low
            if n.sum():
                within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                stack.append((np.repeat(q, n), self.children[np.repeat(low, n) + within]))

    def link_all(self, radius: int) -> np.ndarray:
        """Joins all pairs of a shard within the radius; returns the labels."""
        n, done, size = len(self.label), 0, 1024
        while done < n:  # a few queries first: what they join is skipped by the rest
            queries = np.arange(done, min(n, done + size))
            for q, node, _ in self.search(queries, radius):
                self.label = join_pairs(self.label, q, node)
            done, size = done + size, min(size * 4, 1 << 16)
        return self.label
