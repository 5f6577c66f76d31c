"""Job states from an event stream: claim, lease and terminal rules as a stateful operator."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.history import LEASE_SECONDS

STATE = "last_us long, status string, events long, lapses long, late long, terminal boolean"
OUT = "key long, last_us long, status string, events long, lapses long, late long, terminal boolean"


def fold(state: tuple | None, events: list[tuple[int, str]], terminal: tuple[str, ...], lease_us: int) -> tuple:
    """The state after events in order of time: terminal states absorb, events before the last one count as late, gaps over the lease as lapses."""
    last, status, n, lapses, late, done = state or (None, None, 0, 0, 0, False)
    for at, kind in sorted(events):
        if done or last is not None and at < last:
            late += 1
            continue
        lapses += last is not None and at - last > lease_us
        last, status, n, done = at, kind, n + 1, kind in terminal
    return last, status, n, lapses, late, done


def states(events: DataFrame, terminal: tuple[str, ...], lease: int = LEASE_SECONDS) -> DataFrame:
    """A streaming DataFrame of changed states from streaming events(key, us, kind); memory is one small state a key."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = [x for b in batches for x in zip(b["us"].tolist(), b["kind"].tolist(), strict=True)]
        new = fold(state.get if state.exists else None, rows, terminal, lease * 1_000_000)
        state.update(new)
        yield pd.DataFrame([(key[0], *new)], columns=["key", "last_us", "status", "events", "lapses", "late", "terminal"])

    return events.groupBy("key").applyInPandasWithState(step, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def batch_states(events: DataFrame, terminal: tuple[str, ...], lease: int = LEASE_SECONDS) -> DataFrame:
    """The same states from a finished table, by windows: what the stream must agree with if it gets every event in order."""
    from pyspark.sql import Window as W

    w = W.partitionBy("key").orderBy("us", "kind")
    before = F.coalesce(F.max(F.col("kind").isin(*terminal)).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(False))
    rows = events.withColumns({"_dead": before, "_gap": F.col("us") - F.lag("us").over(w) > lease * 1_000_000})
    live = ~F.col("_dead")
    return rows.groupBy("key").agg(
        F.max(F.when(live, F.col("us"))).alias("last_us"), F.max_by("kind", F.when(live, F.struct("us", "kind"))).alias("status"), F.count_if(live).alias("events"),
        F.count_if(live & F.col("_gap")).alias("lapses"), F.count_if(~live).alias("late"), F.max(F.col("kind").isin(*terminal)).alias("terminal"),
    )


def drained(spark: SparkSession, path: str, schema, terminal: tuple[str, ...], at: str, lease: int = LEASE_SECONDS, name: str = "*.parquet") -> DataFrame:
    """Runs the stream over all files in a folder that fit name and returns the last state of each key; at: a shared folder for its checkpoint and output."""
    raw = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(path)
    rows = raw.select(F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_type").alias("kind"))

    def put(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{at}/out/n={n}")

    query = states(rows, terminal, lease).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.parquet(f"{at}/out")
    fields = ["last_us", "status", "events", "lapses", "late", "terminal"]
    return out.groupBy("key").agg(F.max_by(F.struct(*fields), "batch").alias("s")).select("key", "s.*")


def session_funnel(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Events by session of inactivity, for streams and tables alike; rows later than the watermark are left out of a stream."""
    return events.withWatermark("ts", late).groupBy("key", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events")).select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")
