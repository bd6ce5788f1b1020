"""Signatures of sets: any two sets of a least Jaccard similarity share one. Exact, by the pigeonhole principle.

Sizes are cut into bands that grow by the inverse of the least similarity t. Two such sets a and b, of which the larger one is in
a band up to size u, differ in at most k = 2u(1 - t) / (1 + t) members. Dealt by a hash to m > k buckets, at least m - k buckets
are equal. A full bucket's content is a signature. Only buckets that both have empty can be equal without sharing one; a
set of which m - k buckets or more are empty also gives its first members in hash order, as
many as leave out fewer than t of it: of two such sets of the least similarity these have one in common.
A set takes part in its own band and in those of the larger sets that it may be similar to.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import lru_cache
from math import ceil

import numpy as np

#: Buckets beyond the k that may differ, as a share of k: with more of them hardly any large set has too many empty ones.
SPARE = 0.2
#: Bits of a sketch at least, and bytes of sketches that are compared at once.
LEAST_SKETCH, COMPARED_BYTES = 512, 4 << 20
_ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _ODD[1]
    x = (x ^ (x >> np.uint64(27))) * _ODD[2]
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=8)
def bands(similarity: float) -> list[int]:
    """The least size of each band."""
    starts = [1]
    while starts[-1] < 1 << 40:
        starts.append(max(starts[-1] + 1, ceil(starts[-1] / similarity - 1e-9)))
    return starts


def signatures(members: np.ndarray, similarity: float) -> np.ndarray:
    """Signatures of a set of different 64-bit hashes, which are sorted. Empty sets have one of their own."""
    n, starts = len(members), bands(similarity)
    if not n:
        return np.zeros(1, np.uint64)
    found, mixed, high = [], mix(members), members >> np.uint64(32)
    for band in range(bisect_right(starts, n) - 1, bisect_right(starts, int(n / similarity + 1e-9))):
        differ = int(2 * (starts[band + 1] - 1) * (1 - similarity) / (1 + similarity) + 1e-9)
        buckets = differ + 1 + ceil(SPARE * differ)
        bucket = high * np.uint64(buckets) >> np.uint64(32)  # rises with the members: a bucket is a run of them
        first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        found.append(mix(np.add.reduceat(mixed, first) + (bucket[first] + np.uint64(band << 40)) * _ODD[0]))
        if len(first) <= differ:
            least = members[: n - ceil(similarity * n - 1e-9) + 1]
            found.append(mix(least * _ODD[0] + np.array([band + 1], np.uint64) * _ODD[1]))
    return np.concatenate(found)


def odd_sketch(members: np.ndarray) -> bytes:
    """Whether an odd number of a set's members falls to each bit (Mitzenmacher et al., 2014): two bits a member, a power of two in all.

    The sketches of two sets differ in as many bits as the sets do in members, or fewer. A wide sketch folds to a narrower one by
    exclusive or of its halves.
    """
    bits = max(LEAST_SKETCH, 1 << (2 * len(members) - 1).bit_length() if len(members) else 0)
    return np.packbits(np.bincount((members & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1 == 1).tobytes()


class OddSketches:
    """Sketches of many sets, to compare pairs of them."""

    def __init__(self, sketches: list[bytes], sizes: np.ndarray):
        self.sizes, self.width = sizes, np.array([len(s) for s in sketches], np.int64)
        self.place, self.folded = {}, {}
        for width in np.unique(self.width).tolist():
            rows = np.flatnonzero(self.width >= width)
            self.place[width] = np.full(len(sketches), -1)
            self.place[width][rows] = np.arange(len(rows))
            parts = [np.bitwise_xor.reduce(np.frombuffer(sketches[i], np.uint64).reshape(-1, width // 8), axis=0) for i in rows.tolist()]
            self.folded[width] = np.stack(parts)

    def may_be_similar(self, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
        """Of pairs of sets, which may have this similarity: all that have, and few others."""
        most, width = (self.sizes[a] + self.sizes[b]) * ((1 - similarity) / (1 + similarity)) + 1e-6, np.minimum(self.width[a], self.width[b])
        good = np.zeros(len(a), bool)
        for w, place in self.place.items():
            these = np.flatnonzero(width == w)
            step = max(1, COMPARED_BYTES // w)
            for start in range(0, len(these), step):
                some = these[start : start + step]
                good[some] = np.bitwise_count(self.folded[w][place[a[some]]] ^ self.folded[w][place[b[some]]]).sum(axis=1) <= most[some]
        return good
