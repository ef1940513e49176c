"""Streams with state of their own: stalls, sliding counts, and collectors that fire once.

Each is a keyed state with timers on event time: an event waits until the watermark says that nothing earlier can still come,
so events out of order count as in a batch, and those later than the watermark are dropped. State lives no longer than its
events matter. The state store must be RocksDB, which with_state() sees to.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state(spark: SparkSession) -> None:
    """Sets the store that keyed state needs, unless the session has one of another name already."""
    if not spark.conf.get(STORE, "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set(STORE, ROCKS)


class Waiting(StatefulProcessor):
    """Events of a key as (micros, id) in a list; they are judged in order once the watermark has passed them by `seconds`."""

    def __init__(self, seconds: int) -> None:
        self.micros = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "at bigint, id bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due = set()
        for batch in rows:
            events = [(int(a), int(i)) for a, i in zip(batch["at"], batch["id"], strict=True)]
            self.events.appendList(events)
            due |= {self.due(a) for a, _ in events}
        for ms in sorted(due):
            self.handle.registerTimer(ms)
        yield pd.DataFrame()

    def due(self, at: int) -> int:
        """The millisecond of the watermark from which on the event can be judged."""
        return (at + self.micros) // 1000 + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        events = sorted((int(a), int(i)) for a, i in self.events.get())
        found = self.judged(events, now)
        kept = self.kept(events, now)
        if kept:
            self.events.put(kept)
        elif events:
            self.events.clear()
        yield pd.DataFrame([(*key, *f) for f in found], columns=self.columns) if found else pd.DataFrame()

    def close(self) -> None:
        pass


class Stalls(Waiting):
    columns = ["key", "id", "at"]

    def judged(self, events: list, now: int) -> list:
        later = [*events[1:], None]
        return [(i, a) for (a, i), after in zip(events, later, strict=False) if self.due(a) <= now and (after is None or after[0] - a > self.micros)]

    def kept(self, events: list, now: int) -> list:
        return [e for e in events if self.due(e[0]) > now]


class Sliding(Waiting):
    columns = ["key", "id", "at", "in_last"]

    def due(self, at: int) -> int:
        return at // 1000 + 1

    def __init__(self, seconds: int) -> None:
        super().__init__(seconds)
        self.told = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.told = handle.getValueState("told", "upto bigint")  # events due up to this watermark have been told

    def judged(self, events: list, now: int) -> list:
        last = int(self.told.get()[0]) if self.told.exists() else -1
        self.told.update((now,))
        return [(i, a, sum(a - self.micros <= b <= a for b, _ in events)) for a, i in events if last < self.due(a) <= now]

    def kept(self, events: list, now: int) -> list:
        """Those not told yet, and those that still count for an event that may come."""
        kept = [e for e in events if e[0] + self.micros >= (now - 1) * 1000]
        if not kept:
            self.told.clear()
        return kept


def keyed(events: DataFrame, key: str, time: str, id: str, late: str) -> DataFrame:
    with_state(events.sparkSession)
    rows = events.select(F.col(key).alias("key"), F.col(id).cast("long").alias("id"), F.col(time).cast("timestamp").alias("_ts")).filter("key is not null and id is not null and _ts is not null")
    return rows.withColumn("at", F.unix_micros("_ts")).withWatermark("_ts", late)


def stalls(events: DataFrame, key: str, time: str, id: str, seconds: int = 180, late: str = "10 minutes") -> DataFrame:
    """key, id, at: events of a stream after which nothing came for longer than the limit, told when the watermark has passed it.

    Of events at one time that of the largest id counts. Rows without key, id or time are left out.
    """
    kind = dict(events.dtypes)[key]
    out = keyed(events, key, time, id, late).groupBy("key").transformWithStateInPandas(Stalls(seconds), f"key {kind}, id bigint, at bigint", "append", "eventTime")
    return out.select(F.col("key").alias(key), F.col("id").alias(id), F.timestamp_micros("at").alias(time))


def in_last(events: DataFrame, key: str, time: str, id: str, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """key, id, at, in_last: for each event of a stream how many of its key fall into the seconds up to it, itself included."""
    kind = dict(events.dtypes)[key]
    out = keyed(events, key, time, id, late).groupBy("key").transformWithStateInPandas(Sliding(seconds), f"key {kind}, id bigint, at bigint, in_last bigint", "append", "eventTime")
    return out.select(F.col("key").alias(key), F.col("id").alias(id), F.timestamp_micros("at").alias(time), "in_last")


class Collector(StatefulProcessor):
    """Counts a key's events; at the planned number it fires, once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("done", "done bigint, fired boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done, fired = self.state.get() if self.state.exists() else (0, False)
        total = None
        for batch in rows:
            done += len(batch)
            total = int(batch["total"].iloc[0])
        fires = not fired and total is not None and done >= total
        self.state.update((int(done), bool(fired or fires)))
        yield pd.DataFrame({"key": [key[0]], "done": [int(done)], "total": [total]}) if fires else pd.DataFrame()

    def close(self) -> None:
        pass


def collected_once(events: DataFrame, key: str, totals: DataFrame) -> DataFrame:
    """key, done, total: one row for each key, when its events of a stream reach the planned number (totals: key, total, static).

    The state is a number and a mark for each key and lives in the checkpoint: after a restart a key that has fired stays silent.
    Events of keys without a planned number are left out; a number of 0 or less fires with the first event.
    """
    with_state(events.sparkSession)
    kind = dict(events.dtypes)[key]
    rows = events.join(totals.select(key, F.col("total").cast("long").alias("total")), key).select(F.col(key).alias("key"), "total")
    out = rows.groupBy("key").transformWithStateInPandas(Collector(), f"key {kind}, done bigint, total bigint", "append", "none")
    return out.withColumnRenamed("key", key)
