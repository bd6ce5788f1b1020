"""Keyed state over streams: read-modify-write by key, sessions that expire, and windows of late data."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _on_disk(df: DataFrame) -> DataFrame:
    """State is kept by RocksDB: its size isn't bound by an executor's heap. The session's setting, which holds for streams started from now on."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return df


class _RunningValue(StatefulProcessor):
    def __init__(self, key: str, change: Callable, default: int):
        self.key, self.change, self.default = key, change, default

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("value", "value long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        value = self.value.get()[0] if self.value.exists() else self.default
        for part in rows:
            value = int(self.change(value, part["update"]))
        self.value.update((value,))
        yield pd.DataFrame({self.key: [key[0]], "value": [value]})

    def close(self) -> None:
        pass


def running_values(updates: DataFrame, key: str, change: Callable[[int, pd.Series], int], default: int = 0) -> DataFrame:
    """KV11 on a stream: (key, value) after each batch: change(value, the key's updates of the batch); a new key starts at `default`.

    `updates` is (key, update), both long. A key's rows come in several parts if they're many; `change` folds part by part.
    """
    rows = _on_disk(updates).select(key, "update").groupBy(key)
    return rows.transformWithStateInPandas(_RunningValue(key, change, default), f"{key} long, value long", "update", "none")


class _Sessions(StatefulProcessor):
    def __init__(self, key: str, ttl_us: int):
        self.key, self.ttl_us = key, ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.expires = handle.getMapState("expires", "session string", "expires long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        for session, at in pd.concat(list(rows)).sort_values(["at", "session"])[["session", "at"]].itertuples(index=False):
            until = self.expires.getValue((session,))[0] if self.expires.containsKey((session,)) else None
            if until is not None and until < at:
                out.append((session, "expired", until))
                until = None
            out.append((session, "opened" if until is None else "renewed", at))
            self.expires.updateValue((session,), (max(until or 0, at + self.ttl_us),))
            self.handle.registerTimer((at + self.ttl_us) // 1000 + 1)
        yield self._frame(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        gone = [(session, until) for (session,), (until,) in self.expires.iterator() if until < now]
        for session, _ in gone:
            self.expires.removeKey((session,))
        yield self._frame(key, [(session, "expired", until) for session, until in gone])

    def _frame(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        texts = {c: pd.Series([r[i] for r in rows], dtype=object) for i, c in enumerate(("session", "event"))}
        return pd.DataFrame({self.key: [key[0]] * len(rows), **texts, "at": pd.Series([r[2] for r in rows], dtype="int64")})

    def close(self) -> None:
        pass


def sessions_with_ttl(uses: DataFrame, key: str, time: str, ttl_seconds: int, late: str = "0 seconds") -> DataFrame:
    """FE02 on a stream: (key, session, event, at) where a session is opened, renewed by a use, or expired: a use later than at + ttl opens it anew.

    `uses` is (key long, session string, time). `at` is in microseconds: of the use, or when the session ended. A map of each key's sessions is its state,
    and timers of event time end them once the watermark has passed, whether or not the key is seen again. A key's uses of one micro-batch are sorted in
    memory; the source's rate bounds them.
    """
    rows = _on_disk(uses).withWatermark(time, late).select(key, "session", time, F.unix_micros(F.col(time)).alias("at")).groupBy(key)
    return rows.transformWithStateInPandas(_Sessions(key, ttl_seconds * 1_000_000), f"{key} long, session string, event string, at long", "append", "eventTime")


def session_events(uses: DataFrame, key: str, time: str, ttl_seconds: int) -> DataFrame:
    """What sessions_with_ttl gives once its stream has ended and all time has passed, for a table at rest."""
    from pyspark.sql import Window

    ttl = ttl_seconds * 1_000_000
    order = Window.partitionBy(key, "session").orderBy("at")
    rows = uses.select(key, "session", F.unix_micros(F.col(time)).alias("at"))
    rows = rows.withColumns({"before": F.lag("at").over(order), "after": F.lead("at").over(order)})
    used = rows.select(key, "session", F.when(F.col("at") - F.col("before") <= ttl, "renewed").otherwise("opened").alias("event"), "at")
    ended = rows.where((F.col("after") - F.col("at") > ttl) | F.col("after").isNull()).select(key, "session", F.lit("expired").alias("event"), (F.col("at") + ttl).alias("at"))
    return used.unionByName(ended)


def windowed_counts(events: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts a window and key; rows later than the watermark are dropped. `time` is a timestamp with a time zone."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Counts a session: rows of a key no farther apart than the gap."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n"))
