"""Polynomial prefix hashes: any span's hash in constant time, longest common extensions by binary search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Hashes are modulo 2**31 - 1, whose products fit 64 bits and which is reduced by shifts, for two bases: both must agree.
MODULUS = np.uint64(2**31 - 1)
BASES = np.array([1102937413, 736492951], np.uint64)
#: Code points of a block that is looked up anywhere in another text.
BLOCK = 32
#: Bytes of text in a range of neighbouring ids, about.
RANGE_BYTES = 256 << 20
#: Results that a task puts out at once.
BATCH_ROWS = 1024


def reduced(values: np.ndarray) -> np.ndarray:
    """Values modulo 2**31 - 1, in place."""
    for _ in range(2):
        high = values >> np.uint64(31)
        values &= MODULUS
        values += high
    values[values >= MODULUS] -= MODULUS
    return values


class Powers:
    """Powers of both bases, as many as the longest text of late has needed: what a very long one needed is given back."""

    KEPT = 1 << 22
    table = np.ones((2, 1), np.uint64)

    @classmethod
    def upto(cls, n: int) -> np.ndarray:
        if cls.table.shape[1] > cls.KEPT >= n:
            cls.table = cls.table[:, : cls.KEPT].copy()
        while cls.table.shape[1] < n:
            top = reduced(cls.table[:, -1] * BASES)
            cls.table = np.concatenate([cls.table, reduced(cls.table * top[:, None])], axis=1)
        return cls.table


class PrefixHashes:
    """Of a text's code points: prefix[:, i] = sum of (c[j] + 1) * base**j over j < i, for each base."""

    def __init__(self, text: str, prefix: np.ndarray | None = None):
        self.text = text
        if prefix is not None:
            self.n, self.prefix = len(text), prefix
            return
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        self.n = len(points)
        terms = reduced((points.astype(np.uint64) + np.uint64(1)) * Powers.upto(self.n + 1)[:, : self.n])
        self.prefix = np.zeros((2, self.n + 1), np.uint64)
        np.cumsum(terms, axis=1, out=self.prefix[:, 1:])  # of fewer than 2**33 terms: no overflow
        self.prefix = reduced(self.prefix)

    def spliced(self, keep: int, other: "PrefixHashes", taken: int) -> "PrefixHashes":
        """Hashes of text[:keep] + other.text[:taken], from the two prefix arrays alone."""
        moved = reduced(other.prefix[:, 1 : taken + 1] * Powers.upto(keep + 1)[:, keep : keep + 1])
        prefix = np.concatenate([self.prefix[:, : keep + 1], reduced(moved + self.prefix[:, keep : keep + 1])], axis=1)
        return PrefixHashes(self.text[:keep] + other.text[:taken], prefix)

    def span(self, k: int, begin: int, end: int, at: int) -> int:
        """Hash for base k of text[begin:end] as if it began at `at` (not before `begin`)."""
        value = self.prefix.item(k, end) - self.prefix.item(k, begin)
        return value * Powers.upto(at - begin + 1).item(k, at - begin) % int(MODULUS)

    def equal(self, begin: int, other: "PrefixHashes", other_begin: int, length: int) -> bool:
        """Whether two spans of a length are equal."""
        at = max(begin, other_begin)
        return all(self.span(k, begin, begin + length, at) == other.span(k, other_begin, other_begin + length, at) for k in (0, 1))

    def extension(self, begin: int, other: "PrefixHashes", other_begin: int) -> int:
        """The longest common extension to the right of two positions, by binary search."""
        low, high = 0, min(self.n - begin, other.n - other_begin)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self.equal(begin, other, other_begin, middle) else (low, middle - 1)
        return low

    def extension_left(self, end: int, other: "PrefixHashes", other_end: int) -> int:
        """The longest common extension to the left of two positions."""
        low, high = 0, min(end, other_end)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self.equal(end - middle, other, other_end - middle, middle) else (low, middle - 1)
        return low

    @cached_property
    def fingerprint(self) -> str:
        """Length and hash of the whole text: equal for equal texts."""
        return f"{self.n:08x}" + "".join(f"{int(h):08x}" for h in self.prefix[:, -1])


    def windows(self, length: int, step: int, at: int) -> np.ndarray:
        """Hashes of the spans of a length that begin at every step, as if all began at `at`, both bases in one number."""
        last = self.n - length
        values = reduced(self.prefix[:, length :: step][:, : last // step + 1] + MODULUS - self.prefix[:, : last + 1 : step])
        values = reduced(values * Powers.upto(at + 1)[:, at - last : at + 1][:, ::-1][:, ::step])
        return values[0] << np.uint64(31) | values[1]


def likeness(a: PrefixHashes, b: PrefixHashes) -> float:
    """Share of the longer text that the other one covers; 1 only for equal texts.

    Covered are the longest common extensions from both ends, and each block of BLOCK code points
    of the shorter text that stands anywhere in the longer one.
    """
    short, long = (a, b) if a.n <= b.n else (b, a)
    if a.n == b.n and a.fingerprint == b.fingerprint:
        return 1.0
    covered = np.zeros(short.n, bool)
    covered[: short.extension(0, long, 0)] = True
    covered[short.n - short.extension_left(short.n, long, long.n) :] = True
    if short.n >= BLOCK and not covered.all():
        blocks, there = short.windows(BLOCK, BLOCK, long.n), long.windows(BLOCK, 1, long.n)
        hint = np.zeros(1 << 16, bool)  # most windows are no block's: their low bits say so
        hint[blocks & np.uint64(0xFFFF)] = True
        same = np.isin(blocks, there[hint[there & np.uint64(0xFFFF)]])
        covered[: len(blocks) * BLOCK] |= np.repeat(same, BLOCK)
    return min(int(covered.sum()), long.n - 1) / long.n


def edited(own: PrefixHashes, following: PrefixHashes) -> PrefixHashes:
    """The last half of a text replaced by as much of the beginning of the one that follows."""
    half = own.n // 2
    return own.spliced(own.n - half, following, min(half, following.n))


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: What a task puts out: results (`range` is null), and the first and last document of its range, whose neighbours are elsewhere.
_EDGES = RESULT + ", range int, first struct<doc_id: long, text: string>, last struct<doc_id: long, text: string>"


def _compared(doc_id: int | None, own: PrefixHashes, following: PrefixHashes) -> tuple:
    """A document's row of the result."""
    other = edited(own, following)
    sha = hashlib.sha256(other.text.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, own.n, sha, own.fingerprint, other.fingerprint, likeness(own, other), likeness(own, following)


def compare_with_edits(documents: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they and the next document's are.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. A null
    text is empty; two empty texts are alike (1). Of rows that repeat, each is the next of the one
    before; a single row is its own next. Null ids come first; equal ids go by their texts' hashes. Empty tables give empty ones.

    Documents are dealt to sorted ranges of about `range_bytes`, so a text is shuffled once, and a task streams through its range with two
    texts in hand. What remains are a range's last document and the next range's first one: a pair a range, compared apart. Bounds
    are sampled from ids and hashes alone, so many rows of one id are more than one range.
    """
    spark = documents.sparkSession
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // range_bytes)
    order = [F.asc_nulls_first("doc_id"), F.col("hash"), F.col("text")]
    dealt = docs.repartitionByRange(ranges, *order[:2]).sortWithinPartitions(*order).select("doc_id", "text", F.spark_partition_id().alias("range"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results() -> Iterator[tuple]:
            before = first = None
            for batch in batches:
                for doc_id, text, number in zip(*(column.to_pylist() for column in batch.columns)):
                    hashes = PrefixHashes(text)
                    if before is None:
                        first = (number, {"doc_id": doc_id, "text": text})
                    else:
                        yield *_compared(*before, hashes), None, None, None
                    before = (doc_id, hashes)
            if before is not None:
                yield *[None] * 7, *first, {"doc_id": before[0], "text": before[1].text}

        rows = results()
        while part := list(islice(rows, BATCH_ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), types)], schema=pa.schema(list(zip(names, types))))

    edge = pa.struct([("doc_id", pa.int64()), ("text", pa.string())])
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "range", "first", "last"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), edge, edge]
    done = cut(dealt.mapInArrow(compare, _EDGES))
    inside = done.where("range is null").select(*names[:7])
    ends = done.where("range is not null").select("range", "first", "last")
    numbers = sorted(r["range"] for r in ends.select("range").collect())  # numbers of ranges that have rows
    after = spark.createDataFrame(list(zip(numbers, numbers[1:] + numbers[:1])), "range int, next int")
    pairs = ends.select("range", "last").join(after, "range").join(ends.select(F.col("range").alias("next"), "first"), "next")

    def compare_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, following in zip(*(column.to_pylist() for column in batch.columns)):
                row = _compared(doc_id, PrefixHashes(text), PrefixHashes(following))
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], schema=pa.schema(list(zip(names[:7], types[:7]))))

    apart = pairs.select(F.col("last.doc_id").alias("doc_id"), F.col("last.text").alias("text"), F.col("first.text").alias("following")).mapInArrow(compare_ends, RESULT)
    return inside.unionByName(apart)
