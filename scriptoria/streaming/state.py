"""Streams with a state of their own: the last events of a key, and queues that stand still."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def last_events(events: DataFrame, key: str, time: str, value: str, most: int = 60, late: str = "10 minutes") -> DataFrame:
    """A ring of the `most` latest events of each key by event time: after each trigger, for
    each key with new events, (key, n, newest, p50, p95) of the ring. Write it in update mode.

    The state is one ring a key, whatever the stream's length. Rows behind the watermark are
    left out, late rows before it take their place by time; equal times are ordered by value;
    a null value counts as an event without one."""
    rows = events.withWatermark(time, late).select(F.col(key).cast("string").alias("key"), F.col(time).alias("time"), F.col(value).cast("double").alias("value"))

    def kept(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            return
        times, values = state.get if state.exists else ([], [])
        ring = list(zip(times, values, strict=True))
        for b in batches:
            ring += zip((b["time"].astype("int64")).tolist(), [None if pd.isna(v) else float(v) for v in b["value"]], strict=True)
            ring = sorted(ring, key=lambda r: (r[0], r[1] is not None, r[1] or 0.0))[-most:]
        state.update(([t for t, _ in ring], [v for _, v in ring]))
        known = pd.Series([v for _, v in ring if v is not None], dtype="float64")
        unit = b["time"].dtype.unit if hasattr(b["time"].dtype, "unit") else "ns"
        quantile = lambda q: None if known.empty else float(known.quantile(q))
        yield pd.DataFrame({"key": [name[0]], "n": [len(ring)], "newest": [pd.Timestamp(ring[-1][0], unit=unit)], "p50": [quantile(0.5)], "p95": [quantile(0.95)]})

    return rows.groupBy("key").applyInPandasWithState(kept, "key string, n long, newest timestamp, p50 double, p95 double", "times array<long>, vals array<double>", "update", GroupStateTimeout.NoTimeout)


def stuck_queues(events: DataFrame, key: str, time: str, change: str, threshold: str = "5 minutes", late: str = "1 minute") -> DataFrame:
    """(key, last, pending) of a queue whose last event lies `threshold` back by the watermark
    while jobs are pending. `change` is by how many jobs an event changes the queue (1:
    queued, -1: done). A queue is reported once each time that it comes to a halt, by an
    event-time timer; a new event sets it again. Write it in append mode."""
    wait = int(pd.Timedelta(threshold).total_seconds() * 1000)
    rows = events.withWatermark(time, late).select(F.col(key).cast("string").alias("key"), F.col(time).alias("time"), F.unix_millis(time).alias("at"), F.coalesce(F.col(change), F.lit(0)).cast("long").alias("change"))

    def watched(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last, pending = state.get
            state.update((last, pending))  # it stays, without a timer, until the next event
            if pending > 0:
                yield pd.DataFrame({"key": [name[0]], "last": [pd.Timestamp(last, unit="ms")], "pending": [pending]})
            return
        last, pending = state.get if state.exists else (0, 0)
        for b in batches:
            last, pending = max(last, int(b["at"].max())), pending + int(b["change"].sum())
        state.update((last, pending))
        state.setTimeoutTimestamp(max(last + wait, state.getCurrentWatermarkMs() + 1))

    return rows.groupBy("key").applyInPandasWithState(watched, "key string, last timestamp, pending long", "last long, pending long", "append", GroupStateTimeout.EventTimeTimeout)
