"""Work along an order within a key, in ranges: what a range needs of the ones before it is carried in one row.

A key with more than HOT_ROWS rows is dealt to ranges, and each is a task's work. Only keys with rows in several
ranges need a carry, which is at most one more than there are ranges, and two rows a range; these are broadcast. The other
keys need no ranges: all rows of such a key are less than a task's work, and meet by a hash of the key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from braidworks.sources.checkpoints import snapshot

from .keyed import TASK_ROWS, in_ranges

PART = "__range"
#: Rows of a key above which it goes by ranges.
HOT_ROWS = 1 << 20


def hot_apart(table: DataFrame, key: str, hot_rows: int) -> tuple[DataFrame | None, DataFrame]:
    """The rows of keys with more than `hot_rows` rows (None if there is no such key), and all others. Hot keys are so few that they are broadcast."""
    hot = table.groupBy(key).agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > hot_rows).where(F.col(key).isNotNull()).select(key)
    if hot.isEmpty():
        return None, table
    hot = snapshot(hot)
    return table.join(F.broadcast(hot), key, "left_semi"), table.join(F.broadcast(hot), key, "left_anti")


def hot_ranges(hot: DataFrame, key: str, *order: str, ranges: int | None = None) -> DataFrame:
    """Hot keys' rows in ranges of TASK_ROWS rows on average, each in one task: as many ranges as rows ask for, which adaptive execution leaves apart."""
    ranges = ranges or max(1, -(-hot.count() // TASK_ROWS))
    return in_ranges(hot, key, *order, into=PART, ranges=ranges).repartitionByRange(ranges, PART)  # a hash would put several in a task


def within(key: str, *order: str | Column) -> Window:
    """The rows of a key in a range up to each, in order."""
    return Window.partitionBy(PART, key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def carried(ranged: DataFrame, key: str, **carries: tuple[Column, Callable]) -> DataFrame:
    """(key, range, a column for each carry) of the ranges whose key has rows in earlier ones, for tables dealt by in_ranges(key, ...).

    A carry is an aggregate of a range's rows and the function that puts those of the earlier ranges together.
    """
    sums = ranged.groupBy(key, PART).agg(*[own.alias(name) for name, (own, _) in carries.items()], F.lit(1).alias("__one"))
    earlier = Window.partitionBy(key).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    put = [together(F.col(name)).over(earlier).alias(name) for name, (_, together) in carries.items()]
    return sums.select(key, PART, *put, F.count("__one").over(earlier).alias("__ranges")).where("__ranges > 0").drop("__ranges")


def with_carries(ranged: DataFrame, key: str, **carries: tuple[Column, Callable]) -> DataFrame:
    """The rows with those carries as columns; null where there's no earlier range."""
    return ranged.join(F.broadcast(carried(ranged, key, **carries)), [key, PART], "left")


def running_total(table: DataFrame, key: str, order: list[str], value: str, into: str, hot_rows: int = HOT_ROWS, ranges: int | None = None) -> DataFrame:
    """The table with the sum of `value` over a key's rows up to each, in order, however many rows a key has."""
    hot, rest = hot_apart(table, key, hot_rows)
    done = rest.withColumn(into, F.sum(value).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    if hot is None:
        return done
    joined = with_carries(hot_ranges(hot, key, *order, ranges=ranges), key, __before=(F.sum(value), F.sum))
    total = F.sum(value).over(within(key, *order)) + F.coalesce("__before", F.lit(0))
    return done.unionByName(joined.withColumn(into, total).drop("__before", PART))


def previous(table: DataFrame, key: str, order: str, columns: list[str], into: str, hot_rows: int = HOT_ROWS, ranges: int | None = None) -> DataFrame:
    """The table with the columns of the key's row before as a struct, null for the first, however many rows a key has. One row a key and place in the order."""
    hot, rest = hot_apart(table, key, hot_rows)
    done = rest.withColumn(into, F.lag(F.struct(*columns)).over(Window.partitionBy(key).orderBy(order)))
    if hot is None:
        return done
    row = F.struct(order, *[c for c in columns if c != order])
    joined = with_carries(hot_ranges(hot, key, order, ranges=ranges), key, __earlier=(F.max(row), F.max))
    before = F.lag(F.struct(*columns)).over(Window.partitionBy(PART, key).orderBy(order))
    earlier = F.when(F.col("__earlier").isNotNull(), F.struct(*[F.col("__earlier")[c].alias(c) for c in columns]))
    return done.unionByName(joined.withColumn(into, F.coalesce(before, earlier)).drop("__earlier", PART))


#: Rounds after which carries that still change are taken for a fault.
MOST_ROUNDS = 1000
#: Relative change of a carry below which it counts as settled.
SETTLED = 1e-13


def smoothed(table: DataFrame, key: str, order: list[str], value: str, weight: float, hot_rows: int = HOT_ROWS, ranges: int | None = None) -> DataFrame:
    """(key, average) after all of a key's rows in order: weight * value + (1 - weight) * average, where an average of zero is replaced by the value.

    Rows are sorted by key and order in their task and folded as a stream. Of a hot key a
    range's rows are a map of the average before them, in two branches: what comes of zero, and a + b * average for any other.
    Composed along the key's ranges these give the average before each range. From there its ranges are folded once more as they
    are, which also sees an average that comes to be zero on its way; where one comes out otherwise than
    composed, those after it are folded again, until nothing changes. Rows without key or value take no part.
    """
    known = table.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(key, *order, F.col(value).cast("double").alias("__x"))
    hot, rest = hot_apart(known, key, hot_rows)
    alone = _folded(rest.withColumns({PART: F.lit(0), "__start": F.lit(0.0)}).repartition(key), key, order, weight).select(key, "average")
    if hot is None:
        return alone
    ranged = hot_ranges(hot, key, *order, ranges=ranges)
    place = [ranged.schema[key], ranged.schema[PART]]
    chains: dict = {}
    for row in sorted(_folded(ranged.withColumn("__start", F.lit(0.0)), key, order, weight).collect(), key=lambda r: r[PART]):  # two rows a range at most
        chains.setdefault(row[key], []).append(row)
    starts, ends = {}, {}
    for own, chain in chains.items():
        average = 0.0
        for row in chain:
            starts[own, row[PART]] = average
            average = ends[own, row[PART]] = row["average"] if average == 0 else row["a"] + row["b"] * average
    changed = dict(starts)
    for _ in range(MOST_ROUNDS):
        if not changed:
            break
        given = table.sparkSession.createDataFrame([(*k, v) for k, v in changed.items()], StructType([*place, StructField("__start", DoubleType())]))
        ends |= {(r[key], r[PART]): r["average"] for r in _folded(ranged.join(F.broadcast(given), [key, PART]), key, order, weight).collect()}
        changed = {}
        for own, chain in chains.items():
            for before, after in zip(chain, chain[1:]):
                average, at = ends[own, before[PART]], (own, after[PART])
                if abs(average - starts[at]) > SETTLED * abs(average) or (average == 0) != (starts[at] == 0):
                    starts[at] = changed[at] = average
    else:
        raise ValueError("averages that don't settle")
    last = [(own, ends[own, chain[-1][PART]]) for own, chain in chains.items()]
    return alone.unionByName(table.sparkSession.createDataFrame(last, StructType([place[0], StructField("average", DoubleType())])))


def _folded(rows: DataFrame, key: str, order: list[str], weight: float) -> DataFrame:
    """(key, range, average, a, b) of each range's rows of a key (key, order, __x, __start, range), which are in one partition."""
    schema = StructType([rows.schema[key], rows.schema[PART], *[StructField(c, DoubleType()) for c in ("average", "a", "b")]])
    return rows.sortWithinPartitions(PART, key, *order).select(key, PART, "__x", "__start").mapInArrow(_fold(key, weight), schema)


def _fold(key: str, weight: float):
    """Rows sorted by range and key, folded in order: (key, range, average from its start, a, b) of each key in a range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, average, a, b, kinds = None, 0.0, 0.0, 1.0, []

        def put(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], [key, PART, "average", "a", "b"])

        for batch in batches:
            kinds, done = [*(batch.schema.field(c).type for c in (key, PART)), *[pa.float64()] * 3], []
            for own, part, x, start in zip(*(batch[c].to_pylist() for c in (key, PART, "__x", "__start"))):
                if (own, part) != here:
                    if here is not None:
                        done.append((*here, average, a, b))
                    here, average, a, b = (own, part), start, 0.0, 1.0
                average = x if average == 0 else weight * x + (1 - weight) * average
                a, b = weight * x + (1 - weight) * a, (1 - weight) * b
            yield put(done)
        if here is not None:
            yield put([(*here, average, a, b)])

    return run
