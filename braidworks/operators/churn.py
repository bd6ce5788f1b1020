"""Replay of a log of puts and deletes in which a delete removes the least live key from its probe on."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from braidworks.sources.checkpoints import snapshot

from .keyed import in_ranges
from .ordered import running_total

#: Ranges of keys at most: a put's first place in each is what is broadcast.
MOST_RANGES = 1 << 16
#: Keys of a block of an ordered set.
BLOCK = 512


class OrderedKeys:
    """A set of keys in blocks of bounded size, in order: adding, removing and finding the next key take a search among blocks and one inside."""

    def __init__(self):
        self.blocks: list[list] = []
        self.highest: list = []

    def add(self, key) -> bool:
        """Whether the key is new."""
        b = min(bisect_left(self.highest, key), len(self.blocks) - 1)
        if b < 0:
            self.blocks.append([key])
            self.highest.append(key)
            return True
        block = self.blocks[b]
        at = bisect_left(block, key)
        if at < len(block) and block[at] == key:
            return False
        block.insert(at, key)
        if len(block) > BLOCK:
            self.blocks[b : b + 1] = [block[: BLOCK // 2], block[BLOCK // 2 :]]
            self.highest[b : b + 1] = [block[BLOCK // 2 - 1], block[-1]]
        else:
            self.highest[b] = block[-1]
        return True

    def pop_from(self, probe):
        """Removes the least key that isn't below the probe, and gives it; None if there's none."""
        b = bisect_left(self.highest, probe)
        if b == len(self.blocks):
            return None
        block = self.blocks[b]
        key = block.pop(bisect_left(block, probe))
        if block:
            self.highest[b] = block[-1]
        else:
            del self.blocks[b], self.highest[b]
        return key


class Ways:
    """Where a delete goes whose range has no key for it: the next range that has had a put of its set by then."""

    def __init__(self, firsts: dict):
        self.firsts = firsts

    def next(self, thread, part: int, seq) -> int | None:
        for later, first in self.firsts.get(thread, ()):
            if later > part and first < seq:
                return later
        return None


def _replayed(rows: DataFrame, ways, final: bool) -> DataFrame:
    """One pass over all rows (thread, seq, is_delete, key, nth, part), each range of a set by itself in order of seq.

    If `final`: what each entry did, unless it went on to another range. Else: those that go on, with their next range as `part`.
    """
    ordered = rows.repartition("part").sortWithinPartitions("part", "thread", "seq", "is_delete", "key", "nth").select("thread", "seq", "is_delete", "key", "nth", "part")
    done = [StructField("victim", ordered.schema["key"].dataType), StructField("change", IntegerType())]
    schema = StructType([*ordered.schema.fields, *(done if final else [])])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, live = None, OrderedKeys()
        for batch in batches:
            kept, parts, victims, changes = [], [], [], []
            columns = (batch[c].to_pylist() for c in ("thread", "seq", "is_delete", "key", "part"))
            for k, (thread, seq, is_delete, key, part) in enumerate(zip(*columns)):
                if (part, thread) != here:
                    here, live = (part, thread), OrderedKeys()
                victim, to = None, None
                if not is_delete:
                    change = int(live.add(key))
                else:
                    victim = live.pop_from(key)
                    change = -1 if victim is not None else 0
                    to = ways.value.next(thread, part, seq) if victim is None else None
                if final == (to is None):
                    kept.append(k)
                    parts.append(part if final else to)
                    victims.append(victim)
                    changes.append(change)
            out = batch.select(["thread", "seq", "is_delete", "key", "nth"]).take(pa.array(kept, pa.int64())).columns
            out.append(pa.array(parts, batch.schema.field("part").type))
            if final:
                out += [pa.array(victims, batch.schema.field("key").type), pa.array(changes, pa.int32())]
            yield pa.RecordBatch.from_arrays(out, schema.names)

    return ordered.mapInArrow(fold, schema)


def replay(log: DataFrame, ranges: int | None = None) -> DataFrame:
    """PF13: (thread, seq, is_delete, key, victim, change) of each entry of a log of (thread, seq, is_delete, key), replayed in order of seq.

    Each thread has a set of its own. A put adds its key (`change` 1, 0 if it's there already); a delete removes the least key that isn't
    below its own (`victim`, -1), or nothing if there is none (0). Equal seqs go puts first, then by key. Entries with a null take no part.

    Sets are dealt to ranges of keys of like size, and each range is replayed by itself, streamed in order; a task keeps the range's live
    keys only. A delete that finds no key in its range is handed to the next range that can have one, and the ranges that were
    handed something are replayed again with it. A range that gets more deletes never has more keys at any time, so
    what was handed on stays handed on, and the rounds end with the first that hands on nothing new. There are as many
    as the longest chain of ranges that are empty when a delete comes by.
    """
    known = log.where(" AND ".join(f"{c} IS NOT NULL" for c in ("thread", "seq", "is_delete", "key"))).select("thread", "seq", "is_delete", "key", F.monotonically_increasing_id().alias("nth"))
    rows = in_ranges(known, "thread", "key", into="part", ranges=min(ranges, MOST_RANGES) if ranges else None)
    spread = rows.groupBy("thread").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high")  # as many as ranges at most
    firsts = rows.where("NOT is_delete").join(F.broadcast(spread.select("thread")), "thread").groupBy("thread", "part").agg(F.min("seq").alias("first"))
    ways: dict = {}
    for r in sorted(firsts.collect(), key=lambda r: r["part"]):
        ways.setdefault(r["thread"], []).append((r["part"], r["first"]))
    sent = rows.sparkSession.sparkContext.broadcast(Ways(ways))
    handed, source = None, rows
    while ways:
        moved = snapshot(_replayed(source, sent, final=False))
        new = moved if handed is None else moved.join(handed, ["nth", "part"], "left_anti")
        if new.isEmpty():
            break
        touched = F.broadcast(new.select("part").distinct())  # as many rows as ranges at most
        handed = snapshot(new if handed is None else handed.unionByName(new))
        source = rows.unionByName(handed).join(touched, "part", "left_semi")
    return _replayed(rows if handed is None else rows.unionByName(handed), sent, final=True).drop("nth", "part")


def until_size(replayed: DataFrame, size: int) -> DataFrame:
    """A replayed log up to the entry at which a thread's set first holds `size` keys: what a generator with that goal writes. Threads that never do are whole."""
    sized = running_total(replayed, "thread", ["seq", "is_delete", "key"], "change", "held")
    full = sized.where(F.col("held") >= size).groupBy("thread").agg(F.min(F.struct("seq", "is_delete", "key")).alias("last"))
    inside = F.col("last").isNull() | (F.struct("seq", "is_delete", "key") <= F.col("last"))
    return sized.join(full, "thread", "left").where(inside).drop("last")


def commands(replayed: DataFrame) -> DataFrame:
    """What a table is to be sent: (thread, seq, is_delete, key) of puts, and of deletes that found a key with that key."""
    hit = replayed.where("NOT is_delete OR victim IS NOT NULL")
    return hit.select("thread", "seq", "is_delete", F.coalesce("victim", "key").alias("key"))
