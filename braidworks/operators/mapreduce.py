"""Split, map, combine, shuffle, reduce, merge: as a declared plan.

A job names its records, what a record emits, how a key's values combine and in what order
the output is wanted. Spark combines before the shuffle wherever the combiner allows it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



@dataclass(frozen=True)
class Combiner:
    """`partial` combines values of a key, `final` makes the value that is put out."""

    partial: Callable[[Column], Column]
    final: Callable[[Column], Column] = field(default=lambda c: c)


#: AG04: a sum from zero.
SUM = Combiner(F.sum)
COUNT = Combiner(lambda v: F.count(v))
#: AG01: all values, sorted, so that their order is the same in every run.
BUFFER = Combiner(F.collect_list, F.array_sort)


def last_by(order: str) -> Combiner:
    """AG05: one value wins: the last by the order column."""
    return Combiner(lambda v: F.max_by(v, F.col(order)))


def vector_sum(size: int) -> Combiner:
    """AG06: element-wise sums of arrays of a known length, and how many there were."""
    return Combiner(lambda v: F.struct(F.array(*[F.sum(v[i]) for i in range(size)]).alias("sums"), F.count(v).alias("n")))


@dataclass(frozen=True)
class Job:
    """MR01-08. `emit` makes (key, value, ...) rows of the records, none or many of each."""

    records: DataFrame
    emit: Callable[[DataFrame], DataFrame]
    combiner: Combiner = BUFFER

    def run(self) -> DataFrame:
        """MR02-06: (key, val), one row a key."""
        combined = self.emit(self.records).groupBy("key").agg(self.combiner.partial(F.col("value")).alias("val"))
        return combined.select("key", self.combiner.final(F.col("val")).alias("val"))

    def run_every(self) -> DataFrame:
        """MR05 without a reducer of one's own: every combined value is put out, one row each."""
        return self.run().select("key", F.explode("val").alias("val"))

    def run_sorted(self, *order: Column) -> DataFrame:
        """MR07: in a total order; by key unless said otherwise, and by key where that ties."""
        return self.run().orderBy(*order, "key")

    def run_dense(self, n: int, empty: Column) -> DataFrame:
        """CT03: each key from 0 to n - 1, those without values with the combiner's empty value."""
        keys = self.records.sparkSession.range(n).withColumnRenamed("id", "key")
        return keys.join(self.run(), "key", "left").select("key", F.coalesce("val", empty).alias("val"))


#: Values that one list of a fold holds at most; and how often lists are folded to lists before the last one.
FOLD_BLOCK, FOLD_LEVELS = 4096, 3


def fold(rows: DataFrame, key: str, value: str, init: Callable[[], Column], merge: Callable[[Column, Column], Column], block: int = FOLD_BLOCK, levels: int = FOLD_LEVELS) -> DataFrame:
    """AG02, AG03: a user's associative and commutative fold, of which `init` gives the neutral value. `block` is a power of two.

    Rows are numbered where they are; a key's values among `block` neighbouring numbers are one list, folded to one value, then those of `block` neighbouring
    lists, and so on: however hot a key is, no list holds more than `block`, but for the last, which has one of block**levels rows (and of eight partitions) each.
    """
    if block & (block - 1):
        raise ValueError("a block is a power of two")
    folded = lambda df, *by: df.groupBy(*by).agg(F.aggregate(F.collect_list(value), init(), merge).alias(value))
    parts = rows.select(key, value, F.monotonically_increasing_id().alias("__at"))
    for _ in range(levels):
        parts = folded(parts.withColumn("__at", F.shiftrightunsigned("__at", (block - 1).bit_length())), key, "__at")
    return folded(parts, key)


def by_index(rows: DataFrame, index: str, value: str) -> DataFrame:
    """CT04: one writer a key: no combining, hence no shuffle."""
    return rows.select(F.col(index).alias("key"), F.col(value).alias("val"))


def words(rows: DataFrame, text: str) -> DataFrame:
    """(key, value): each space-separated word of a text, with 1."""
    return rows.select(F.explode(F.split(text, " ")).alias("key"), F.lit(1).cast("long").alias("value"))
