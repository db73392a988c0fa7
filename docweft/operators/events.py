"""Event logs: latest state, stage times, replay after a cursor, bounded fan-out, rate limits."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: States after which a document sends nothing more (fixed values).
TERMINAL = ("done", "failed")


def _micros(c: str = "ts"):
    return F.unix_micros(F.col(c).cast("timestamp"))


def latest_events(events: DataFrame, key: str = "doc_id") -> DataFrame:
    """The newest event of each document."""
    names = [c for c in events.columns if c != key]
    newest = events.groupBy(key).agg(F.max(F.struct("event_id", *(c for c in names if c != "event_id"))).alias("e"))
    return newest.select(key, *(F.col(f"e.{c}").alias(c) for c in names))


def stage_durations(events: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each event with the milliseconds since the document's event before it."""
    w = Window.partitionBy(key).orderBy("event_id")
    return events.withColumn("duration_ms", (_micros() - F.lag(_micros()).over(w)) / 1000.0)


def replay_after(events: DataFrame, document: int, cursor: int, key: str = "doc_id") -> DataFrame:
    return events.filter((F.col(key) == document) & (F.col("event_id") > cursor)).orderBy("event_id")


def fan_out(events: DataFrame, most: int = 100, key: str = "doc_id") -> DataFrame:
    """What a subscriber of bounded memory still holds: the newest ``most`` events of each key."""
    w = Window.partitionBy(key).orderBy(F.desc("event_id"))
    return events.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_r")


def replay_then_live(replayed: DataFrame, live: DataFrame) -> DataFrame:
    """Replayed and live events, each id once."""
    return replayed.unionByName(live).dropDuplicates(["event_id"])


def admitted(empty: float, now: float, rpm: float, capacity: float, cost: float = 1.0) -> tuple[float, bool, float]:
    """A request at ``now`` to a bucket that fills at rpm / 60 a second: its new state, whether the request passes, and the seconds to wait.

    The state is one number, the time at which the bucket was or would have been empty: it
    holds min(capacity, rate (now - empty)) tokens.  A request that passes moves it on by
    cost / rate.  A full bucket has the state -inf.
    """
    rate = rpm / 60
    empty = max(empty, now - capacity / rate)
    wait = empty + cost / rate - now
    return (empty, False, wait) if wait > 1e-9 else (empty + cost / rate, True, 0.0)


def rate_limited(requests: DataFrame, rpm: float, capacity: float | None = None, key: str = "doc_id") -> DataFrame:
    """(event_id, key, allowed, retry_after): a bucket for each key over its requests in order.

    Keys are dealt over tasks and come sorted, so a task holds one number, however long a key's history is.
    """
    rows = requests.select("event_id", key, (_micros() / 1e6).alias("s")).repartition(key).sortWithinPartitions(key, "event_id")
    schema = T.StructType([rows.schema["event_id"], rows.schema[key], T.StructField("allowed", T.BooleanType()), T.StructField("retry_after", T.DoubleType())])
    size = float(rpm if capacity is None else capacity)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, empty = object(), 0.0
        for batch in batches:
            found = []
            for k, now in zip(batch.column(key).to_pylist(), batch.column("s").to_pylist(), strict=True):
                if k != owner:
                    owner, empty = k, float("-inf")
                empty, allowed, wait = admitted(empty, now, rpm, size)
                found.append((allowed, wait))
            yield pa.RecordBatch.from_arrays([batch.column("event_id"), batch.column(key), pa.array([f[0] for f in found], pa.bool_()), pa.array([f[1] for f in found], pa.float64())], schema.names)

    return rows.mapInArrow(fold, schema)
