"""Trace events as streams: window statistics, exact rate limits, session states."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
LIMIT, WINDOW_S = 30, 60
#: State of a key is dropped after so many seconds without its events.
EXPIRE_S = 86_400
ORDER = ["pending", "ingesting", "auditing", "aggregating", "done"]


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """Events from the Parquet files of a folder; triggers take a few files, which holds back the source."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def window_stats(events: DataFrame, width: str = "20 minutes", late: str = "1 hour") -> DataFrame:
    """Counts and totals by window and type; rows later than `late` are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def rate_limited(events: DataFrame, limit: int = LIMIT, seconds: int = WINDOW_S) -> DataFrame:
    """(user_id, event_id, accepted): an attempt is refused if `limit` accepted ones lie within the seconds before.

    State is the times of accepted attempts still in the window, at most `limit` of them for each user.
    """

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        accepted = []
        for at in rows.ts.astype("datetime64[us]").astype("int64"):
            recent = [x for x in recent if x > at - seconds * 1_000_000]
            accepted.append(len(recent) < limit)
            if accepted[-1]:
                recent.append(int(at))
        state.update((recent,))
        state.setTimeoutDuration(1000 * EXPIRE_S)
        yield pd.DataFrame({"user_id": rows.user_id, "event_id": rows.event_id, "accepted": accepted})

    return events.select("user_id", "event_id", "ts").groupBy("user_id").applyInPandasWithState(
        decide, "user_id long, event_id long, accepted boolean", "recent array<long>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def session_states(events: DataFrame) -> DataFrame:
    """(user_id, state, n_done, failed): the furthest state of each session; events may come in any order."""

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        step, done, failed = state.get if state.exists else (0, 0, False)
        for rows in batches:
            step = max([step, *[ORDER.index(x) for x in rows.stage if x in ORDER]])
            done += int((rows.stage == "dimension").sum())
            failed = failed or bool((rows.stage == "failed").any())
        state.update((step, done, failed))
        state.setTimeoutDuration(1000 * EXPIRE_S)
        yield pd.DataFrame({"user_id": [key[0]], "state": ["failed" if failed else ORDER[step]], "n_done": [done], "failed": [failed]})

    return events.select("user_id", "stage").groupBy("user_id").applyInPandasWithState(
        advance, "user_id long, state string, n_done long, failed boolean", "step int, done long, failed boolean", "update", GroupStateTimeout.ProcessingTimeTimeout)


def progress(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """(user_id, done, failed, last): counts of finished and failed steps by task, kept as events come."""
    return events.withWatermark("ts", late).groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "purchase").alias("done"), F.count_if(F.col("event_type") == "error").alias("failed"), F.max("ts").alias("last"))


def recent_and_forwarded(batch: DataFrame, ring: str, keep: int, publish) -> None:
    """One trigger of a monitor: the batch goes on to `publish`, and the newest `keep` events replace the ring's files."""
    spark = batch.sparkSession
    newest = batch.orderBy(F.desc("ts"), F.desc("event_id")).limit(keep)
    try:
        old = spark.createDataFrame(spark.read.parquet(ring).collect(), batch.schema)  # at most `keep` rows
        newest = old.unionByName(newest).dropDuplicates(["event_id"]).orderBy(F.desc("ts"), F.desc("event_id")).limit(keep)
    except AnalysisException:
        pass  # the first trigger has no ring yet
    newest.coalesce(1).write.mode("overwrite").parquet(ring)
    publish(batch)


def monitor(events: DataFrame, ring: str, checkpoint: str, publish, keep: int = 500):
    """The consuming loop: each trigger's events to the ring of the newest `keep` and to `publish`."""
    return events.writeStream.foreachBatch(lambda batch, _: recent_and_forwarded(batch, ring, keep, publish)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
