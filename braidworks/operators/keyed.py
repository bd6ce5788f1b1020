"""Tables with one row a key. A change gives a new table; nothing is changed in place.

Every operation is an aggregate or a join on the key, so one hash partitioning serves all of
them: `repartition(2**p, key)` (or a bucketed table) once, and later steps on the key don't shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidworks.sources.checkpoints import snapshot

UNSIGNED_64 = 1 << 64
#: Rows that a task gets on average where rows are dealt by their number.
TASK_ROWS = 1 << 18


def dealt(table: DataFrame, rows: int, *keys: str) -> DataFrame:
    """The table dealt by the keys to as many tasks as `rows` asks for. Left to itself, adaptive execution puts up to 64 MB of compressed
    rows in a task, whose sorts and hash tables are then a gigabyte."""
    return table.repartition(max(1, -(-rows // TASK_ROWS)), *keys)


def build(rows: DataFrame, key: str, power: int | None = None) -> DataFrame:
    """KV01: the rows, hash-partitioned by key into 2**power partitions (as many as the session says, by default)."""
    return rows.repartition(key) if power is None else rows.repartition(1 << power, key)


def violations(table: DataFrame, key: str) -> DataFrame:
    """Keys that aren't unique, with their number of rows: empty for a sound table."""
    return table.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def get(table: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """KV02, KV05, KV06: each requested key with its value; nulls where there is none."""
    return requests.join(table, key, "left")


def get_with_location(table: DataFrame, requests: DataFrame, key: str, location: Column | None = None) -> DataFrame:
    """KV03, KV04: as get, and the `partition` that holds the row (null where there is none): by the column given, or Spark's own number of it."""
    return requests.join(table.withColumn("partition", F.spark_partition_id() if location is None else location), key, "left")


def multi_get(table: DataFrame, requests: DataFrame, ids: str, key: str) -> DataFrame:
    """KV13: rows for each id in a request's array, with their place in it as `pos`; misses are dropped."""
    wanted = requests.select("*", F.posexplode(ids).alias("pos", key)).drop(ids)
    return wanted.join(table, key)


def upsert(table: DataFrame, updates: DataFrame, key: str, order: list[str]) -> DataFrame:
    """KV07: the whole row of the last update of a key, else the table's. `updates` has the table's columns and those of `order`."""
    values = [c for c in table.columns if c != key]
    new = updates.select(key, F.struct(F.lit(1), *order).alias("__seq"), F.struct(*values).alias("__row"))
    old = table.select(key, F.struct(F.lit(0), *[F.lit(None).cast(updates.schema[c].dataType).alias(c) for c in order]).alias("__seq"), F.struct(*values).alias("__row"))
    return old.unionByName(new).groupBy(key).agg(F.max_by("__row", "__seq").alias("__row")).select(key, *[F.col("__row")[v].alias(v) for v in values])


def insert_if_absent(table: DataFrame, new: DataFrame, key: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """KV08: the table with those of `new` whose key it lacks (the first of each by `order`); and each new key with `inserted`."""
    values = [c for c in table.columns if c != key]
    first = new.groupBy(key).agg(F.min_by(F.struct(*values), F.struct(*order)).alias("__row")).select(key, *[F.col("__row")[v].alias(v) for v in values])
    flags = first.join(table.select(key, F.lit(False).alias("inserted")), key, "left").select(key, F.coalesce("inserted", F.lit(True)).alias("inserted"))
    return table.unionByName(first.join(table, key, "left_anti")), flags


def remove(table: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """KV09: the table without the keys; and each key with whether it `existed`."""
    asked = keys.select(key).distinct()
    existed = asked.join(table.select(key, F.lit(True).alias("existed")), key, "left").select(key, F.coalesce("existed", F.lit(False)).alias("existed"))
    return table.join(asked, key, "left_anti"), existed


def take(table: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """KV10: the rows of the keys, and the table without them."""
    asked = keys.select(key).distinct()
    return table.join(asked, key, "left_semi"), table.join(asked, key, "left_anti")


def apply(table: DataFrame, updates: DataFrame, key: str, value: str, default: object, change: Callable[[Column, Column], Column]) -> DataFrame:
    """KV11: change(old value, update) of each key with an update; a key that's missing starts at `default`. One update a key."""
    joined = table.join(updates.withColumn("__updated", F.lit(True)), key, "full")
    old = F.coalesce(F.col(value), F.lit(default))
    changed = F.when(F.col("__updated"), change(old, F.col("update"))).otherwise(F.col(value))
    return joined.select(key, changed.alias(value))


def pairs(table: DataFrame) -> DataFrame:
    """KV14: all rows."""
    return table


def for_each_until(table: DataFrame, visit: Callable[[dict], bool]) -> bool:
    """RC05: visits rows until `visit` says False; whether all were visited.

    Partitions are opened a few at a time, four times as many whenever none of the last ones has stopped it; what
    is beyond those isn't read. In a partition the rows after the one that stopped it aren't visited; others opened with it may go on for a while.
    """

    def scan(batches):
        for batch in batches:
            for row in batch.to_pylist():
                if not visit(row):
                    yield pa.RecordBatch.from_pydict({"stopped": [True]})
                    return

    return not table.mapInArrow(scan, "stopped boolean").take(1)


def hashes_and_keys(table: DataFrame, key: str, hashed: Column | None = None) -> DataFrame:
    """KV15: 64-bit hash and key of each row; by `hashed`, if not xxhash64 of the key."""
    return table.select((F.xxhash64(key) if hashed is None else hashed).alias("hash"), key)


def reduce(table: DataFrame, *aggregates: Column) -> DataFrame:
    """KV16: one row of aggregates; partial ones a partition, then merged."""
    return table.agg(*aggregates)


def reduce_shards(table: DataFrame, key: str, power: int, *aggregates: Column, hashed: Column | None = None) -> DataFrame:
    """KV17: aggregates of each shard that has rows. `hashed` is the unsigned 64-bit hash that shards go by, if not xxhash64 of the key."""
    return table.groupBy(shard_index(unsigned(F.xxhash64(key)) if hashed is None else hashed, power).alias("shard")).agg(*aggregates)


def drain(table: DataFrame, *aggregates: Column) -> tuple[DataFrame, DataFrame]:
    """KV18: the reduction, and the emptied table."""
    return table.agg(*aggregates), clear(table)


def unsigned(h: Column) -> Column:
    """A signed 64-bit hash as the unsigned number with its bits."""
    wide = h.cast("decimal(20,0)")
    return F.when(h < 0, wide + F.lit(Decimal(UNSIGNED_64))).otherwise(wide)


def shard_index(h: Column, power: int) -> Column:
    """KV19: shard of an unsigned 64-bit hash: it divided by (2**64 - 1) >> power; the few hashes at the top stay in the last shard."""
    width = F.lit(Decimal((UNSIGNED_64 - 1) >> power)).cast("decimal(20,0)")
    return F.least(F.call_function("div", h.cast("decimal(20,0)"), width), F.lit((1 << power) - 1).cast("long"))


def copy(table: DataFrame) -> DataFrame:
    """KV22: a snapshot in the shared folder, which later changes of the source don't reach."""
    return snapshot(table)


def save(table: DataFrame, path: str, key: str | None = None) -> None:
    """KV23: as Parquet, sorted by key within files so that lookups skip row groups."""
    (table.sortWithinPartitions(key) if key else table).write.mode("overwrite").parquet(path)


def load(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def compare_and_set(table: DataFrame, swaps: DataFrame, key: str, value: str) -> DataFrame:
    """RC03: `new_value` where the value is `old_value` (nulls are equal); one swap a key. `swapped` tells."""
    joined = table.join(swaps.withColumn("__swap", F.lit(True)), key, "left")
    hit = F.coalesce(F.col("__swap") & F.col(value).eqNullSafe(F.col("old_value")), F.lit(False))
    return joined.select(key, F.when(hit, F.col("new_value")).otherwise(F.col(value)).alias(value), hit.alias("swapped"))


def remove_if_equals(table: DataFrame, expected: DataFrame, key: str, value: str) -> DataFrame:
    """RC04: without the rows whose key and value are both given."""
    return table.join(expected.select(key, value).distinct(), [key, value], "left_anti")


def live_references(changes: DataFrame, key: str, amount: str) -> DataFrame:
    """RC08: keys whose puts (+1) outnumber removes (-1), with the count."""
    return changes.groupBy(key).agg(F.sum(amount).alias("references")).where("references > 0")


def net_state(log: DataFrame, key: str, order: list[str], deleted: Column, values: list[str]) -> DataFrame:
    """PF13: what an operation log leaves: each key's last operation, unless it deletes."""
    last = log.groupBy(key).agg(F.max_by(F.struct(deleted.alias("__gone"), *values), F.struct(*order)).alias("__last"))
    return last.where(~F.col("__last.__gone")).select(key, *[F.col("__last")[v].alias(v) for v in values])


def in_ranges(table: DataFrame, *order: str | Column, into: str = "__range", ranges: int | None = None) -> DataFrame:
    """A snapshot of the table in ranges of like size of the order columns, with the number of each row's range.

    Spark samples the bounds; equal rows share a range. Ranges follow each other in order, and a window over one is a task's work.
    """
    dealt = table.repartitionByRange(ranges, *order) if ranges else table.repartitionByRange(*order)
    return snapshot(dealt.withColumn(into, F.spark_partition_id()))


def numbered(table: DataFrame, order: list[str], into: str = "number") -> DataFrame:
    """Rows numbered from 0 in an order, without a task that sees them all: inside ranges, plus the rows of the ranges before."""
    ranged = in_ranges(table, *order)
    counts = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("n"))  # a row a range
    before = F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    joined = ranged.withColumn("__inside", inside).join(F.broadcast(counts.select("__range", before.alias("__before"))), "__range")
    return joined.withColumn(into, F.col("__inside") + F.col("__before")).drop("__range", "__inside", "__before")


def successors(probes: DataFrame, keys: DataFrame, probe: str, key: str) -> DataFrame:
    """PF13: each probe with the least key that isn't below it (`successor`; null if none).

    Keys and probes are dealt to ranges together. Within a range one sort answers its
    probes; what finds none there takes the first key of the next range that has any, from
    a table of one row a range. So there's no range join, and a range is a task's work.
    """
    kept = keys.select(F.col(key).alias("__at"), F.lit(None).cast(probes.schema[probe].dataType).alias(probe), F.lit(True).alias("__is_key")).where("__at is not null").distinct()
    asked = probes.select(F.col(probe).alias("__at"), probe, F.lit(False).alias("__is_key"))
    rows = in_ranges(kept.unionByName(asked), "__at")
    above = Window.partitionBy("__range").orderBy(F.desc("__at"), F.desc("__is_key")).rowsBetween(Window.unboundedPreceding, 0)  # downwards: a running frame
    found = rows.withColumn("__own", F.last(F.when(F.col("__is_key"), F.col("__at")), ignorenulls=True).over(above)).where(~F.col("__is_key"))
    firsts = rows.groupBy("__range").agg(F.min(F.when(F.col("__is_key"), F.col("__at"))).alias("__first"))
    later = Window.orderBy("__range").rowsBetween(1, Window.unboundedFollowing)
    joined = found.join(F.broadcast(firsts.select("__range", F.min("__first").over(later).alias("__next"))), "__range")
    return joined.select(probe, F.when(F.col(probe).isNotNull(), F.coalesce("__own", "__next")).alias("successor"))


# Ordered containers: a table with a key or sequence column that orders it.


def size(table: DataFrame) -> DataFrame:
    """GC01: number of rows and whether there are none."""
    return table.agg(F.count(F.lit(1)).alias("size")).withColumn("empty", F.col("size") == 0)


def clear(table: DataFrame) -> DataFrame:
    """GC03."""
    return table.limit(0)


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    """GC04 of a container that takes equal keys."""
    return table.unionByName(rows)


def push(table: DataFrame, rows: DataFrame, sequence: str, front: bool = False) -> DataFrame:
    """GC06: rows put before the first or after the last, in the order of their own sequence column."""
    ends = table.agg(F.coalesce(F.min(sequence), F.lit(0)).alias("__low"), F.coalesce(F.max(sequence), F.lit(-1)).alias("__high"))
    own = rows.agg(F.min(sequence).alias("__own_low"), F.max(sequence).alias("__own_high"))
    shift = F.col("__low") - 1 - F.col("__own_high") if front else F.col("__high") + 1 - F.col("__own_low")
    moved = rows.crossJoin(F.broadcast(ends.crossJoin(own))).withColumn(sequence, F.col(sequence) + shift)  # one row
    return table.unionByName(moved.select(table.columns))


def nth(table: DataFrame, key: str, n: int) -> DataFrame:
    """GC08: the row with n smaller keys."""
    return table.orderBy(key).offset(n).limit(1)


def ends(table: DataFrame, key: str) -> DataFrame:
    """GC09: first and last row as structs."""
    whole = F.struct(*table.columns)
    return table.agg(F.min_by(whole, key).alias("front"), F.max_by(whole, key).alias("back"))


def pop(table: DataFrame, key: str, n: int, front: bool = True) -> tuple[DataFrame, DataFrame]:
    """GC10: up to n rows from one end, and the rest. Keys are unique."""
    popped = table.orderBy(F.col(key).asc() if front else F.col(key).desc()).limit(n)
    return popped, table.join(F.broadcast(popped.select(key)), key, "left_anti") if n <= 100_000 else table.join(popped.select(key), key, "left_anti")


def split(table: DataFrame, key: str, middle: object) -> tuple[DataFrame, DataFrame]:
    """GC11: rows below the middle key, and the others. merge is insert()."""
    return table.where(F.col(key) < F.lit(middle)), table.where(F.col(key) >= F.lit(middle))


def for_all(table: DataFrame, **changes: Column) -> DataFrame:
    """GC12: columns changed in all rows."""
    return table.withColumns(changes)


def ordered(table: DataFrame, key: str, descending: bool = False) -> DataFrame:
    """GC13."""
    return table.orderBy(F.col(key).desc() if descending else F.col(key).asc())


def rebase(table: DataFrame, key: str, base: int) -> DataFrame:
    """GC14: keys counted from a new base."""
    return table.withColumn(key, F.col(key) - base)


def compute(table: DataFrame, closure, schema) -> DataFrame:
    """GC15: a closure over the batches of each partition."""
    return table.mapInPandas(closure, schema)


def append_batch_if(table: DataFrame, rows: DataFrame, most: int) -> DataFrame:
    """GC16: with the rows if the table has at most so many now, else as it is."""
    small = F.broadcast(table.agg((F.count(F.lit(1)) <= most).alias("__fits")))
    return table.unionByName(rows.crossJoin(small).where("__fits").drop("__fits"))  # the other side is one row


# Sets: a table with a key alone.


def set_contains(members: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """RC07: each asked key with whether it's `there`."""
    known = members.select(key).distinct().withColumn("there", F.lit(True))
    return asked.join(known, key, "left").withColumn("there", F.coalesce("there", F.lit(False)))


def set_put(members: DataFrame, new: DataFrame) -> DataFrame:
    return members.union(new).distinct()


def set_remove(members: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return members.join(gone, key, "left_anti")
