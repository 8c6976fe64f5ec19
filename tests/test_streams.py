"""Streams in several files, with restarts, late rows and repeats, against their batch twins."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sievemark.streaming import ledgers as L
from sievemark.streaming.keyed import KeyedSink
from sievemark.streaming.stateful import budget_stream, coverage_stream, rocks

SCHEMA = "event_id long, ts timestamp, user_id long, value double, error string, state string"
DAY = dt.datetime(2024, 1, 1)


def events(seed, n, days=0, users=6):
    r = random.Random(seed)
    return [(seed * 10_000 + i, DAY + dt.timedelta(days=days, minutes=i), r.randrange(users), r.choice((0.1, 7.3, 50.0, None)), r.choice((None, "timeout")), r.choice(("open", "done", "lost"))) for i in range(n)]


class Feed:
    """A folder that files come to, and a stream over it that is started anew for each."""

    def __init__(self, spark, folder, schema=SCHEMA):
        self.spark, self.folder, self.schema, self.n = spark, str(folder), schema, 0

    def put(self, rows):
        self.n += 1
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(f"{self.folder}/in/f{self.n}")

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/in/*")

    def run(self, df, mode="append", batch=None):
        out = df.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{self.folder}/progress")
        out = out.foreachBatch(batch) if batch else out.format("parquet").option("path", f"{self.folder}/out")
        out.start().awaitTermination()

    def out(self):
        return self.spark.read.parquet(f"{self.folder}/out")

    def all(self):
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/in/*")


@pytest.fixture
def feed(spark, tmp_path):
    return Feed(spark, tmp_path)


def test_ingest_over_restarts(feed):
    a, b = events(1, 40), events(2, 40)
    for rows in (a, b[:20] + a[:10], b + a):
        feed.put(rows)
        feed.run(L.ingest_ledger(feed.stream(), ["event_id"]))
    assert sorted(r.event_id for r in feed.out().collect()) == sorted(r[0] for r in a + b)


def test_ingest_lets_late_rows_go(feed):
    a = events(1, 10)
    for rows in (a, events(2, 10, days=9), events(3, 10, days=10), a[:5]):
        feed.put(rows)
        feed.run(L.ingest_ledger(feed.stream(), ["event_id"], "ts", "1 hour"))
    got = [r.event_id for r in feed.out().collect()]
    assert len(got) == 30 and len(set(got)) == 30  # the late repeats neither came again nor were kept


def test_budget_cut_over_restarts(spark, feed):
    rocks(spark)
    names = ["event_id", "user_id", "value"]
    for k in range(3):
        rows = events(k, 50)
        random.Random(k).shuffle(rows)  # within a batch any order
        feed.put(rows)
        feed.run(budget_stream(feed.stream().select(*names), "user_id", "event_id", "value", 60.0))
    want = L.budget_cut(feed.all().select(*names), "user_id", "event_id", "value", 60.0)
    got = {tuple(r) for r in feed.out().select(*names, "spent", "allowed").collect()}
    assert got == {tuple(r) for r in want.select(*names, "spent", "allowed").collect()} and 0 < sum(r[4] for r in got) < len(got)


def test_done_jobs_by_upsert(spark, feed, tmp_path):
    """Update mode into a keyed table: restarts, repeated runs of a batch, compaction; the state of old windows goes."""
    sink = KeyedSink(f"{tmp_path}/keyed", ["user_id", "start"], compact=2)

    def twice(batch, i):
        batch.persist()
        sink.upsert(batch, i)
        sink.upsert(batch, i)  # as after a failure before the batch was committed

    for k, days in enumerate((0, 1, 2, 5, 6)):
        feed.put(events(k, 30, days))
        feed.run(L.done_jobs(feed.stream(), "user_id", "error", "ts", "1 hour", "12 hours"), "update", twice)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(L.all_windows(sink.read(spark), "user_id")) == key(L.done_jobs(feed.all(), "user_id"))
    before = key(sink.read(spark))
    feed.put(events(9, 30, 0))  # five days late: left out, not counted twice
    feed.run(L.done_jobs(feed.stream(), "user_id", "error", "ts", "1 hour", "12 hours"), "update", twice)
    assert key(sink.read(spark)) == before


def test_binding_by_upsert(spark, feed, tmp_path):
    sink = KeyedSink(f"{tmp_path}/keyed", ["user_id", "start"])
    for k in range(3):
        feed.put(events(k, 30, k))
        feed.run(L.bind_latest(feed.stream(), ["user_id"], "event_id", ["state"], "ts", "1 hour"), "update", sink.upsert)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    got = L.bind_latest(sink.read(spark), ["user_id"], "event_id", ["state"])
    assert key(got) == key(L.bind_latest(feed.all(), ["user_id"], "event_id", ["state"]))


def test_nothing_written(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        KeyedSink(f"{tmp_path}/none", ["k"]).read(spark)


def test_coverage_once_time_is_over(spark, feed, tmp_path):
    rocks(spark)
    at = lambda h: DAY + dt.timedelta(hours=h)
    schema = "user_id long, ts timestamp, declared boolean, state string, seq long"
    feed.schema = schema

    def step(rows):
        feed.put(rows)
        s = feed.stream()
        feed.run(coverage_stream(s.where("declared").select("user_id", "ts"), s.where("not declared").select("user_id", "ts", "state", "seq"), "user_id", ["done"], "ts", "1 hour", "10 hours"))
        return sorted(tuple(r) for r in feed.out().collect())

    declared = [(u, at(0), True, None, None) for u in range(5)]
    assert step(declared + [(1, at(1), False, "open", 1), (9, at(1), False, "open", 1)]) == []  # 9 was never declared
    # 1 ends in time, though its rows come in another order; 2 is on its way, 3 ended and was opened again.
    assert step([(1, at(2), False, "done", 5), (1, at(2), False, "open", 4), (2, at(2), False, "open", 2), (3, at(2), False, "done", 1), (3, at(3), False, "open", 2)]) == []
    assert step([(100, at(9), False, "open", 1)]) == []
    got = step([(100, at(40), False, "done", 2)])
    assert got == [(0, "missing"), (2, "not terminal"), (3, "not terminal"), (4, "missing")]
    twin = L.state_coverage(feed.all().where("declared").select("user_id"), feed.all().where("not declared").select("user_id", "state", "seq"), ["user_id"], ["done"])
    assert got == sorted(tuple(r) for r in twin.collect())
    assert step([(101, at(80), False, "done", 1)]) == got


def test_coverage_of_shared_buckets(spark, feed):
    """Keys that share a bucket end each at its own time, over several runs; null is a key, and a null state no terminal one."""
    rocks(spark)
    r = random.Random(7)
    at = lambda h: DAY + dt.timedelta(hours=h)
    feed.schema = "user_id long, ts timestamp, declared boolean, state string, seq long"

    def step(rows):
        feed.put(rows)
        s = feed.stream()
        feed.run(coverage_stream(s.where("declared").select("user_id", "ts"), s.where("not declared").select("user_id", "ts", "state", "seq"), "user_id", ["done"], "ts", "1 hour", "10 hours", buckets=3))
        return sorted((tuple(r) for r in feed.out().collect()), key=str)

    keys = [None, (1 << 60) + 1, *range(40)]
    rows = [(u, at(0), True, None, None) for u in keys]
    more = [(r.choice(keys[:30]), at(r.randrange(1, 4) + k // 30 * 3), False, r.choice(["open", "done", None]), (1 << 55) + k) for k in range(60)]
    assert step(rows + more[:30]) == [] and step(more[30:]) == []
    assert step([(39, at(9), False, "done", 1), (39, at(9), False, "open", 1)]) == []
    assert step([(100, at(9), False, "open", 1)]) == []
    got = step([(100, at(40), False, "open", 2)])
    last = {u: state for u, _, _, state, _ in sorted(more, key=lambda x: x[4])} | {39: "done"}
    want = [(u, "missing" if u not in last else "not terminal") for u in keys if u not in last or last[u] != "done"]
    assert got == sorted(want, key=str) and len(want) > 15
