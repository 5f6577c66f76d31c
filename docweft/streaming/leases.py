"""Leases in an event stream: a key that falls silent loses its lease, told by a timer and not by its next event.

Every event of a key renews its lease until LEASE seconds later; a terminal one ends it. Events wait in the key's list
state until the watermark reaches them, so that they count in order of time however they arrive; those behind it are
dropped by the watermark. Each key has one event-time timer, at the earliest waiting event or its deadline. A lease that
runs out gives one lapse, at its deadline; the next event takes it anew. State that is of no more use is removed: a lapsed
or ended key has none but, for `keep` seconds after a terminal event, the mark that swallows what still comes.

Defined results: events without a key or time are left out; of events of one millisecond the terminal ones come last;
repeated events count each and change nothing else. An empty stream gives no lapses.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.history import LEASE_SECONDS

LAPSE = "key string, deadline_ms long, beats long"
#: The state store that timers need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Leases(StatefulProcessor):
    """lease, keep: milliseconds. beats counts the events since the lease was taken."""

    def __init__(self, lease: int, keep: int):
        self.lease, self.keep = lease, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "last long, beats long, ended boolean, due long")
        self.waiting = handle.getListState("waiting", "ms long, terminal boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = self._state()
        for batch in rows:
            self.waiting.appendList([*zip(batch["ms"].tolist(), batch["terminal"].tolist(), strict=True)])
            first = int(batch["ms"].min())
            if state[3] is None or first < state[3]:
                state = (*state[:3], self._due(state[3], first))
        self.held.update(state)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        last, beats, ended, _ = self._state()
        events = sorted(self.waiting.get()) if self.waiting.exists() else []
        ready, later = [e for e in events if e[0] <= mark], [e for e in events if e[0] > mark]
        lapses = []
        for ms, terminal in [*ready, (None, False)]:
            until = mark + 1 if ms is None else ms
            if last is not None and not ended and last + self.lease < until:
                lapses.append((str(key[0]), last + self.lease, beats))
                last, beats = None, 0
            if ended and last + self.keep < until:
                last, beats, ended = None, 0, False
            if ms is not None and not ended:
                last, beats, ended = ms, beats + 1, terminal
        self.waiting.clear()
        due = [e[0] for e in later[:1]] + ([last + (self.keep if ended else self.lease)] if last is not None else [])
        if later:
            self.waiting.put(later)
        if due:
            self.held.update((last, beats, ended, self._due(None, min(due))))
        else:
            self.held.clear()
        if lapses:
            yield pd.DataFrame(lapses, columns=["key", "deadline_ms", "beats"])

    def _state(self) -> tuple:
        return tuple(self.held.get()) if self.held.exists() else (None, 0, False, None)

    def _due(self, old: int | None, new: int) -> int:
        """Moves the key's timer."""
        if old is not None:
            self.handle.deleteTimer(old)
        self.handle.registerTimer(new)
        return new

    def close(self) -> None:
        pass


def lapses(events: DataFrame, terminal: Column, delay: str = "1 hour", lease: int = LEASE_SECONDS, keep: int = 365 * 86_400) -> DataFrame:
    """A streaming DataFrame of (key, deadline_ms, beats) from streaming events(key, ts); delay: how far events may lie behind the latest."""
    rows = events.select(F.col("key").cast("string").alias("key"), "ts", F.unix_millis("ts").alias("ms"), F.coalesce(terminal, F.lit(False)).alias("terminal")).where("key is not null and ts is not null")
    return rows.withWatermark("ts", delay).groupBy("key").transformWithStateInPandas(Leases(1000 * lease, 1000 * keep), LAPSE, "Append", "EventTime")


def batch_lapses(events: DataFrame, terminal: Column, mark_ms: Column, lease: int = LEASE_SECONDS) -> DataFrame:
    """The lapses up to a watermark from a finished table; a terminal event counts for good."""
    rows = events.select(F.col("key").cast("string").alias("key"), F.unix_millis("ts").alias("ms"), F.coalesce(terminal, F.lit(False)).alias("terminal"), mark_ms.alias("mark")).where("key is not null and ms <= mark")
    w = W.partitionBy("key").orderBy("ms", "terminal")
    rows = rows.withColumn("over", F.coalesce(F.max("terminal").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(False))).where("not over")
    deadline = F.col("ms") + 1000 * lease
    rows = rows.withColumns({"lapse": (F.coalesce(F.lead("ms").over(w), F.col("mark") + 1) > deadline) & ~F.col("terminal"), "n": F.row_number().over(w)})
    lapsed = rows.where("lapse").select("key", deadline.alias("deadline_ms"), (F.col("n") - F.coalesce(F.lag("n").over(W.partitionBy("key").orderBy("ms", "n")), F.lit(0))).cast("long").alias("beats"))
    return lapsed


def drained(spark: SparkSession, rows: DataFrame, at: str) -> DataFrame:
    """Runs a streaming DataFrame over all that its source has now, its rows and checkpoint in the shared folder `at`."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        query = rows.writeStream.outputMode("append").format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(rows.schema).parquet(f"{at}/out")
