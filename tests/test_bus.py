"""The bus over files that arrive in turns, stopped and restarted from its checkpoint."""

import datetime as dt
import time

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidemark.streaming import bus, trace


def events(n, first=0, kinds=("step", "done", "error")):
    start = dt.datetime(2024, 1, 1)
    return [(i, start + dt.timedelta(seconds=i), i % 4, kinds[i % len(kinds)], float(i), None) for i in range(first, first + n)]


@pytest.fixture
def feed(spark, tmp_path):
    bus.with_state_store(spark)
    folder = tmp_path / "events"

    def add(rows):
        spark.createDataFrame(rows, trace.EVENT).coalesce(1).write.mode("append").parquet(str(folder))

    add(events(30))
    return str(folder), add, tmp_path


def all_rows(spark, folder):
    return spark.read.parquet(f"{folder}/rows")


def until(query, holds):
    """Runs a stream that does not end by itself until something holds."""
    end = time.time() + 90
    try:
        while time.time() < end and query.exception() is None:
            try:
                if holds():
                    return
            except AnalysisException:
                pass  # nothing is written yet
            time.sleep(1)
        raise AssertionError(query.exception() or "not in time")
    finally:
        query.stop()


def test_bounded_queues_drop_count_and_go_on_after_a_restart(spark, feed):
    path, add, tmp = feed
    subscribers = spark.createDataFrame([("all", None), ("errors", "error")], "subscriber string, event_type string")
    published = []

    def go(n):
        rows = bus.delivered(trace.read_events(spark, path, 1), subscribers, limit=12, drain=8, wait_ms=3_600_000)
        until(bus.run(rows, bus.once(str(tmp / "out"), lambda df, n: published.append((n, df.count()))), str(tmp / "ck")), lambda: all_rows(spark, tmp / "out").count() >= n)

    go(16)
    rows = all_rows(spark, tmp / "out")
    got = {s: sorted(r.event_id for r in rows.where(F.col("subscriber") == s).collect()) for s in ("all", "errors")}
    assert got["errors"] == list(range(2, 24, 3)) and got["all"] == list(range(8))  # 12 held, 8 of them delivered
    assert rows.where("subscriber = 'all'").agg(F.max("dropped"), F.max("waiting")).first() == (18, 4)
    add(events(5, first=100))
    go(25)  # from the checkpoint: the four that waited come first
    ids = [r.event_id for r in all_rows(spark, tmp / "out").where("subscriber = 'all' and batch > 0").orderBy("ts").collect()]
    assert ids == [8, 9, 10, 11, 100, 101, 102, 103]
    assert len({n for n, _ in published}) == len(published)


def test_a_replayed_trigger_writes_the_same_and_publishes_once(spark, tmp_path):
    published = []
    sink = bus.once(str(tmp_path), lambda df, n: published.append(n))
    batch = spark.createDataFrame(events(5), trace.EVENT)
    for number in (0, 1, 1, 0):
        sink(batch, number)
    assert published == [0, 1] and spark.read.parquet(f"{tmp_path}/rows").count() == 10


def test_versions_of_a_ring_survive_a_replay(spark, tmp_path):
    ring = bus.latest_ring(str(tmp_path), keep=7)
    ring(spark.createDataFrame(events(5), trace.EVENT), 0)
    late = spark.createDataFrame(events(6, first=5), trace.EVENT)
    for _ in range(2):  # the second time as after a crash
        ring(late, 1)
    assert sorted(r.event_id for r in spark.read.parquet(f"{tmp_path}/version=1").collect()) == list(range(4, 11))
    assert sorted(r.event_id for r in spark.read.parquet(f"{tmp_path}/version=0").collect()) == list(range(5))


def test_rings_hold_the_newest(spark, feed):
    path, add, tmp = feed
    add(events(6, first=200))

    def newest():
        w = all_rows(spark, tmp / "out").groupBy("shard").agg(F.max_by("event_ids", "batch").alias("ids"), F.max_by("held", "batch").alias("held")).collect()
        assert all(r.held == len(r.ids) <= 4 for r in w)
        return sorted((i for r in w for i in r.ids), reverse=True)[:4]

    rows = bus.rings(trace.read_events(spark, path, 1), keep=4, shards=3)
    until(bus.run(rows, bus.once(str(tmp / "out")), str(tmp / "ck"), "update"), lambda: newest() == [205, 204, 203, 202])
    add(events(3, first=100))  # older than what is held
    add(events(1, first=300))
    rows = bus.rings(trace.read_events(spark, path, 1), keep=4, shards=3)
    until(bus.run(rows, bus.once(str(tmp / "out")), str(tmp / "ck"), "update"), lambda: newest() == [300, 205, 204, 203])


def test_progress_goes_on_after_a_restart_and_ends(spark, feed):
    path, add, tmp = feed

    status = lambda: {r.task: (r.done, r.failed, r.percent, r.status) for r in all_rows(spark, tmp / "out").groupBy("task").agg(*[F.max_by(c, "batch").alias(c) for c in ("done", "failed", "percent", "status")]).collect()}

    def go(holds):
        rows = bus.task_progress(trace.read_events(spark, path, 1), "user_id", total=3, stall_ms=10**9, failed="error")
        until(bus.run(rows, bus.once(str(tmp / "out")), str(tmp / "ck"), "update"), holds)

    go(lambda: len(status()) == 4)
    counts = {str(u): [sum(e[2] == u and e[3] == k for e in events(30)) for k in ("done", "error")] for u in range(4)}
    assert status() == {u: (d, f, min(100, 100 * d // 3), "failed" if f else "running") for u, (d, f) in counts.items()}
    add([(900 + i, dt.datetime(2024, 2, 1), 7, "done", 0.0, None) for i in range(2)])
    go(lambda: status().get("7") == (2, 0, 66, "running"))
    add([(950, dt.datetime(2024, 2, 1), 7, "done", 0.0, None)])
    go(lambda: status().get("7") == (3, 0, 100, "done"))
