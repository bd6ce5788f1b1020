"""First-fit-decreasing packing of token pieces, with a tournament tree of bin capacities."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh
from .tokens import encode, encoder_at

SEQUENCE_TOKENS = 1024
#: Pieces that one group holds on average; groups are packed apart, so this bounds a task's memory.
GROUP_PIECES = 8192
END_OF_DOCUMENT = 0


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece: longest first, each into the first bin that has room.

    The tree's leaves are the room in each bin, an inner node the most room below it; the first
    bin with enough room is found from the root by going left wherever the left has it.
    """
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    leaves = 1 << max(0, n - 1).bit_length()
    room = [capacity] * (2 * leaves)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need, node = int(lengths[i]), 1
        while node < leaves:
            node *= 2
            if room[node] < need:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - room[node]
        room[node] -= need
        while node > 1:
            node //= 2
            most = max(room[2 * node], room[2 * node + 1])
            if room[node] == most:
                break
            room[node] = most
    return bins, offsets


def cut_pieces(documents: DataFrame, path: str, capacity: int = SEQUENCE_TOKENS) -> DataFrame:
    """doc_id, doc_tokens, start, ids of each piece: a document's ids and its end mark, cut every `capacity` ids.

    `ids` are little-endian unsigned 32-bit numbers. A null text is empty: one piece, the end mark.
    """

    @F.pandas_udf("struct<doc_tokens: long, pieces: array<binary>>")
    def tokenize(texts: pd.Series) -> pd.DataFrame:
        encoder, rows = encoder_at(path), []
        for text in texts.fillna(""):
            ids = np.append(encode(encoder, text), np.uint32(END_OF_DOCUMENT)).astype("<u4", copy=False)
            rows.append((len(ids), [ids[i : i + capacity].tobytes() for i in range(0, len(ids), capacity)]))
        return pd.DataFrame(rows, columns=["doc_tokens", "pieces"])

    tokenized = documents.select("doc_id", tokenize.asNondeterministic()("text").alias("t"))
    pieces = tokenized.select("doc_id", "t.doc_tokens", F.posexplode("t.pieces").alias("nth", "ids"))
    return pieces.select("doc_id", "doc_tokens", (F.col("nth").cast("long") * capacity).alias("start"), "ids")


def place(pieces: DataFrame, capacity: int = SEQUENCE_TOKENS, group_pieces: int = GROUP_PIECES, seed: int = 42, packer=first_fit_decreasing) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces that has doc_id, start and length (at most `capacity`).

    Pieces are dealt to groups at random, by a hash of the piece and of its place in the
    input, so rows that repeat spread too; each group is packed apart, by `packer(lengths, capacity)`. The table is written
    to the shared checkpoint folder first: a lost executor can't deal a piece anew. All
    columns are kept, whatever their names.
    """
    nth, part = fresh(pieces, "__nth"), fresh(pieces, "__group")
    pieces = cut(pieces.withColumn(nth, F.monotonically_increasing_id()))
    groups = max(1, -(-pieces.count() // group_pieces))
    schema = pieces.drop(nth).schema.add("sequence_id", "long").add("offset", "long")

    def pack(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), (nth, "ascending")])
        bins, offsets = packer(group["length"].to_numpy(), capacity)
        group = group.append_column("sequence_id", pa.array((key[0].as_py() << 32) + bins)).append_column("offset", pa.array(offsets))
        return group.select(schema.names)

    dealt = pieces.withColumn(part, F.pmod(F.xxhash64("doc_id", "start", nth, F.lit(seed)), F.lit(groups)))
    return dealt.groupBy(part).applyInArrow(pack, schema)


def pack_documents(documents: DataFrame, path: str, capacity: int = SEQUENCE_TOKENS, with_ids: bool = True) -> DataFrame:
    """Every document's pieces with their place in a sequence of at most `capacity` tokens.

    doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; and the ids themselves
    unless `with_ids` is false. A null text packs as empty (its end mark alone), a null doc_id
    stays null, rows that repeat are packed each, an empty table gives an empty one, other
    columns aren't read. A text of any length is cut into as many pieces as it needs.
    """
    pieces = cut_pieces(documents, path, capacity).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", *["ids"] * with_ids
    )
    return place(pieces, capacity)
