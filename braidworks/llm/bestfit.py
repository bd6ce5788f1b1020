"""Best-fit-decreasing packing of whole documents, with a segment tree over remaining capacities."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import END_OF_DOCUMENT, place
from .wordtokens import word_encoder_at

SEQUENCE_TOKENS = 2048
#: Pieces that one group holds on average: rows of a few numbers, so a group is some megabytes of a task's memory.
GROUP_PIECES = 65_536


class OpenBins:
    """Open bins by the room that is left in them: the tightest one for a length is found in logarithmic time.

    The leaves of the segment tree are the amounts of room from 0 to the capacity; a node says whether a bin is open
    below it. From a length's leaf the way goes up to the first node with a right neighbour that has one, and from there
    down to its leftmost.
    """

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()  # more than capacity
        self.any_open = bytearray(2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, bin_: int, room: int) -> None:
        self.bins[room].append(bin_)
        node = self.leaves + room
        while node and not self.any_open[node]:
            self.any_open[node] = 1
            node >>= 1

    def tightest(self, length: int) -> int | None:
        """The least room that a length fits in, of those that a bin has; None if no bin has as much."""
        open_, node = self.any_open, self.leaves + length
        while not open_[node]:
            while node & 1:  # a right child: what is above it on the right begins further up
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.leaves:
            node *= 2
            if not open_[node]:
                node += 1
        return node - self.leaves

    def take(self, room: int) -> int:
        """The bin that has had this room for the shortest time; it's open no more until it is put back."""
        bin_ = self.bins[room].pop()
        if not self.bins[room]:
            node = self.leaves + room
            self.any_open[node] = 0
            while node > 1 and not self.any_open[node ^ 1]:
                node >>= 1
                self.any_open[node] = 0
        return bin_


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece: longest first, each into the open bin that it leaves the least room in; else into a new one.

    Equal lengths go in the order given; of bins with equal room the one that came to it last is taken.
    """
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_, used = OpenBins(capacity), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        room = open_.tightest(length)
        if room is None:
            room, bins[i], used = capacity, used, used + 1
        else:
            bins[i] = open_.take(room)
        offsets[i] = capacity - room
        if room > length:
            open_.put(int(bins[i]), room - length)
    return bins, offsets


def cut_documents(documents: DataFrame, path: str, capacity: int = SEQUENCE_TOKENS) -> DataFrame:
    """doc_id, piece, start, length, ids of each piece: a document's ids and its end mark; only what is longer than `capacity` is cut.

    `ids` are little-endian unsigned 32-bit numbers. A null text is empty: one piece, the end mark.
    """
    end = END_OF_DOCUMENT.to_bytes(4, "little")

    @F.pandas_udf("array<binary>")
    def tokenize(texts: pd.Series) -> pd.Series:
        encoder, step, rows = word_encoder_at(path), 4 * capacity, []
        for text in texts.fillna(""):
            ids = encoder.packed_ids(text) + end
            rows.append([ids[i : i + step] for i in range(0, len(ids), step)])
        return pd.Series(rows, dtype=object)

    pieces = documents.select("doc_id", F.posexplode(tokenize.asNondeterministic()("text")).alias("piece", "ids"))
    start = (F.col("piece").cast("long") * capacity).alias("start")
    return pieces.select("doc_id", "piece", start, (F.octet_length("ids") / 4).cast("long").alias("length"), "ids")


def pack_best_fit(documents: DataFrame, path: str, capacity: int = SEQUENCE_TOKENS, group_pieces: int = GROUP_PIECES, with_ids: bool = True) -> DataFrame:
    """Every document's pieces with their place in a sequence of at most `capacity` tokens, in few sequences.

    doc_id, piece, start, length, ids_crc32, sequence_id, offset; and the ids themselves unless `with_ids` is false. Pieces are
    dealt to groups at random, and each group is packed by itself, best fit decreasing: a group's last bins are all that it wastes
    more than packing everything at once. A null text packs as its end mark alone, a null doc_id stays
    null, rows that repeat are packed each, pieces of equal length go in the order of the dealt table, an empty table gives an empty
    one, and other columns aren't read. A text of any length is cut into as many pieces as it needs.
    """
    pieces = cut_documents(documents, path, capacity)
    kept = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), *["ids"] * with_ids)
    return place(kept, capacity, group_pieces, packer=best_fit_decreasing)
