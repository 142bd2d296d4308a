"""An event bus as a stream with keyed state: bounded queues, rings of the newest events, progress of tasks.

State lives in the query's state store and is committed with its checkpoint, so a restart goes on where the last
committed trigger ended and counts nothing twice. Sinks are told the number of the trigger: a trigger that runs
again after a failure writes the same folder again, and what it published is not published a second time.

`transformWithState` needs the RocksDB state store; `with_state_store` sets it for a session.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: Events that a subscriber's queue, and a ring, hold.
QUEUE, RING = 500, 500
#: State of a key goes after so long without events.
TTL_MS = 86_400_000
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EVENT = "ts timestamp, event_id long, event_type string"


def with_state_store(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    return spark


def _rows(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    frames = [b for b in batches if len(b)]
    frame = pd.concat(frames) if frames else pd.DataFrame(columns=["ts", "event_id", "event_type"])
    return frame.sort_values(["ts", "event_id"])


def _tuples(frame: pd.DataFrame) -> list[tuple]:
    return [(t.to_pydatetime(), int(i), k) for t, i, k in zip(frame["ts"], frame["event_id"], frame["event_type"], strict=True)]


class BoundedQueue(StatefulProcessor):
    """A subscriber's queue: what does not fit is dropped and counted; each trigger or timer delivers up to `drain`."""

    def __init__(self, limit: int = QUEUE, drain: int = QUEUE, wait_ms: int = 1000, ttl_ms: int = TTL_MS):
        self.limit, self.drain, self.wait_ms, self.ttl_ms = limit, drain, wait_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.queue = handle.getListState("queue", _EVENT, self.ttl_ms)
        self.dropped = handle.getValueState("dropped", "n long", self.ttl_ms)

    def _deliver(self, key: Any, now: int, held: list[tuple], lost: int) -> Iterator[pd.DataFrame]:
        out, rest = held[: self.drain], held[self.drain :]
        if rest:
            self.queue.put(rest)
            self.handle.registerTimer(now + self.wait_ms)
        elif self.queue.exists():
            self.queue.clear()
        self.dropped.update((lost,))
        if out:
            ts, ids, kinds = zip(*out, strict=True)
            yield pd.DataFrame({"subscriber": [key[0]] * len(out), "ts": ts, "event_id": ids, "event_type": kinds, "waiting": len(rest), "dropped": lost})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = list(self.queue.get()) if self.queue.exists() else []
        lost = self.dropped.get()[0] if self.dropped.exists() else 0
        new = _tuples(_rows(rows))
        room = max(0, self.limit - len(held))
        yield from self._deliver(key, timerValues.getCurrentProcessingTimeInMs(), held + new[:room], lost + len(new[room:]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = list(self.queue.get()) if self.queue.exists() else []
        lost = self.dropped.get()[0] if self.dropped.exists() else 0
        yield from self._deliver(key, timerValues.getCurrentProcessingTimeInMs(), held, lost)

    def close(self) -> None:
        pass


def delivered(events: DataFrame, subscribers: DataFrame, limit: int = QUEUE, drain: int = QUEUE, wait_ms: int = 1000) -> DataFrame:
    """(subscriber, ts, event_id, event_type, waiting, dropped): every event to every subscriber of its type.

    subscribers: (subscriber, event_type), a null type for all. `dropped` counts what the queue has refused so far.
    """
    wanted = F.col("s.event_type").isNull() | (F.col("s.event_type") == F.col("e.event_type"))
    rows = events.alias("e").join(subscribers.alias("s"), wanted).select("subscriber", "e.ts", "e.event_id", "e.event_type")
    return rows.groupBy("subscriber").transformWithStateInPandas(
        BoundedQueue(limit, drain, wait_ms), f"subscriber string, {_EVENT}, waiting long, dropped long", "append", "processingTime")


class Ring(StatefulProcessor):
    """The newest events of a key; each trigger tells what it holds."""

    def __init__(self, keep: int = RING, ttl_ms: int = TTL_MS):
        self.keep, self.ttl_ms = keep, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getListState("newest", _EVENT, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = list(self.newest.get()) if self.newest.exists() else []
        events = sorted({r[1]: tuple(r) for r in held + _tuples(_rows(rows))}.values())[-self.keep :]
        self.newest.put(events)
        errors = sum(e[2] == "error" for e in events)
        yield pd.DataFrame({"shard": [key[0]], "first": [events[0][0]], "last": [events[-1][0]], "held": [len(events)], "errors": [errors], "event_ids": [[e[1] for e in events]]})

    def close(self) -> None:
        pass


def rings(events: DataFrame, keep: int = RING, shards: int = 16) -> DataFrame:
    """(shard, first, last, held, errors, event_ids): rings of the newest `keep` events, dealt over shards by their id.

    The newest `keep` of all events are among those of the shards.
    """
    rows = events.select(F.pmod(F.xxhash64("event_id"), F.lit(shards)).alias("shard"), "ts", "event_id", "event_type")
    return rows.groupBy("shard").transformWithStateInPandas(
        Ring(keep), "shard long, first timestamp, last timestamp, held long, errors long, event_ids array<long>", "update", "processingTime")


class Progress(StatefulProcessor):
    """Counts of a task's finished and failed steps, its terminal status, and a stall where nothing came for long."""

    def __init__(self, total: int, stall_ms: int, done: str, failed: str, ttl_ms: int = TTL_MS):
        self.total, self.stall_ms, self.done_type, self.failed_type, self.ttl_ms = total, stall_ms, done, failed, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "done long, failed long", self.ttl_ms)

    def _row(self, key: Any, done: int, failed: int, status: str) -> pd.DataFrame:
        return pd.DataFrame({"task": [key[0]], "done": [done], "failed": [failed], "percent": [min(100, 100 * done // self.total)], "status": [status]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        done, failed = self.seen.get() if self.seen.exists() else (0, 0)
        kinds = _rows(rows)["event_type"]
        done, failed = done + int((kinds == self.done_type).sum()), failed + int((kinds == self.failed_type).sum())
        self.seen.update((done, failed))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        status = "failed" if failed else "done" if done >= self.total else "running"
        if status == "running":
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.stall_ms)
        yield self._row(key, done, failed, status)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        done, failed = self.seen.get() if self.seen.exists() else (0, 0)
        yield self._row(key, done, failed, "stalled")

    def close(self) -> None:
        pass


def task_progress(events: DataFrame, task: str, total: int, stall_ms: int = 600_000, done: str = "done", failed: str = "failed") -> DataFrame:
    """(task, done, failed, percent, status): running, done, failed, or stalled after `stall_ms` without an event."""
    rows = events.select(F.col(task).cast("string").alias("task"), "ts", "event_id", "event_type")
    return rows.groupBy("task").transformWithStateInPandas(
        Progress(total, stall_ms, done, failed), "task string, done long, failed long, percent long, status string", "update", "processingTime")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder has been committed (its writer has left its success file)."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def once(folder: str, publish: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch, idempotent by the trigger's number.

    The rows go to folder/batch=N, which a second run of trigger N overwrites; `publish` gets the written rows
    and N, and a note in folder/published/batch=N is left behind it: a trigger with a note is not published again.
    A crash between publishing and the note publishes N once more, with the same number, so that a receiver can tell.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if batch.isEmpty():  # a trigger that only looked at timers
            return
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
        if publish is not None and not exists(spark, f"{folder}/published/batch={number}"):
            publish(spark.read.parquet(f"{folder}/rows/batch={number}"), number)
            spark.range(1).write.mode("overwrite").parquet(f"{folder}/published/batch={number}")

    return write


def latest_ring(folder: str, keep: int = RING) -> Callable[[DataFrame, int], None]:
    """A sink that keeps the newest events in versions: trigger N writes folder/version=N from the last version before N.

    Nothing is overwritten but the own version of a trigger that runs again, so a crash leaves the last one whole;
    the version before the last is kept, older ones are not needed and may be removed.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        newest = batch.select("event_id", "ts", "event_type")
        before = number - 1
        while before >= 0 and not exists(spark, f"{folder}/version={before}"):
            before -= 1
        if before >= 0:
            newest = newest.unionByName(spark.read.parquet(f"{folder}/version={before}")).dropDuplicates(["event_id"])
        newest.orderBy(F.desc("ts"), F.desc("event_id")).limit(keep).write.mode("overwrite").parquet(f"{folder}/version={number}")

    return write


def run(rows: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", available: bool = False) -> StreamingQuery:
    """The stream to a foreachBatch sink: until it is stopped, or all that is there (`available`).

    A stream with timers looks at them in every trigger and so never runs out of triggers by itself.
    """
    query = rows.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if available else query).start()
