"""Streams in several batches: a folder that gets one file after another, and queries that start again from their state."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from quern.streaming import sessions, upkeep

AT = datetime.datetime(2024, 5, 1)


def minute(k):
    return None if k is None else AT + datetime.timedelta(minutes=k)


class Feed:
    """Rows of one schema, put into a folder batch by batch."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema = spark, str(folder), schema

    def put(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")

    def stream(self):
        return self.spark.readStream.schema(self.schema).parquet(f"{self.folder}/in")

    def run(self, result):
        sessions.written(result, f"{self.folder}/out", f"{self.folder}/state").awaitTermination()
        return sorted(map(tuple, self.spark.read.parquet(f"{self.folder}/out").collect()), key=str)


def test_sessions_wait_for_the_watermark_and_late_rows_are_dropped(spark, tmp_path):
    feed = Feed(spark, tmp_path, "user long, time timestamp")
    made = lambda: sessions.sessions(feed.stream(), "time", "10 minutes", "30 minutes", "user")
    feed.put([(1, minute(0)), (1, minute(5)), (2, minute(3)), (None, minute(4)), (3, None)])
    assert feed.run(made()) == []  # nothing has ended for sure
    feed.put([(1, minute(12)), (2, minute(40))])  # on time: the first session of 1 grows; the watermark goes to minute 10
    feed.put([(2, minute(100))])
    assert feed.run(made()) == sorted([(1, minute(0), minute(22), 3), (2, minute(3), minute(13), 1), (2, minute(40), minute(50), 1), (None, minute(4), minute(14), 1)], key=str)
    before = feed.run(made())
    feed.put([(1, minute(13)), (5, minute(69)), (5, minute(75))])  # minute 13 and 69 lie behind minute 70 less what is open
    feed.put([(9, minute(300))])
    after = feed.run(made())
    assert set(before) < set(after) and not any(r[0] == 1 and r[2] > minute(22) for r in after)
    assert [r for r in after if r[0] == 2 and r[1] == minute(100)] == [(2, minute(100), minute(110), 1)]


def test_sliding_windows_over_two_batches(spark, tmp_path):
    feed = Feed(spark, tmp_path, "kind string, time timestamp")
    made = lambda: sessions.sliding(feed.stream(), "time", "20 minutes", "10 minutes", "0 minutes", "kind")
    feed.put([("a", minute(1)), ("a", minute(11))])
    feed.run(made())
    feed.put([("a", minute(12)), ("a", minute(2)), ("b", minute(45))])  # minute 2 still counts where its window is open
    out = feed.run(made())
    assert ("a", minute(0), minute(20), 4) in out or ("a", minute(0), minute(20), 3) in out
    assert ("a", minute(10), minute(30), 2) in out and not any(r[2] > minute(45) for r in out)
    feed.put([("a", minute(3)), ("b", minute(90))])  # too late for any window
    assert [r for r in feed.run(made()) if r[0] == "a"] == [r for r in out if r[0] == "a"]


def test_repeats_go_across_batches_and_restarts(spark, tmp_path):
    feed = Feed(spark, tmp_path, "conv_id long, turn long, time timestamp")
    made = lambda: sessions.distinct(feed.stream(), "time", "1 hour", "conv_id", "turn").select("conv_id", "turn")
    feed.put([(1, 1, minute(0)), (1, 1, minute(0)), (1, 2, minute(1))])
    feed.run(made())
    feed.put([(1, 1, minute(20)), (1, 3, minute(30)), (2, 1, minute(31))])  # 1, 1 again, in another batch and another start
    assert feed.run(made()) == [(1, 1), (1, 2), (1, 3), (2, 1)]


def test_answers_in_later_batches_and_unanswered_questions(spark, tmp_path):
    feed = Feed(spark, tmp_path, "conv_id long, turn long, role string, time timestamp")
    made = lambda: sessions.answers(feed.stream(), "5 minutes", 30 * 60_000)
    feed.put([(1, 0, "user", minute(0)), (1, 1, "assistant", minute(2)), (1, 2, "user", minute(3)), (2, 0, "user", minute(1)), (2, 1, "user", minute(4)), (3, 0, "assistant", minute(1)), (4, 0, "user", None)])
    assert feed.run(made()) == [(1, 0, minute(0), minute(2)), (2, 0, minute(1), None)]
    feed.put([(1, 3, "assistant", minute(9)), (9, 0, "assistant", minute(10))])  # the answer comes in the next batch
    assert (1, 2, minute(3), minute(9)) in feed.run(made())
    feed.put([(9, 1, "assistant", minute(90))])
    feed.put([(9, 2, "assistant", minute(91))])
    assert (2, 1, minute(4), None) in feed.run(made())  # nobody answered within half an hour


WORK = staticmethod(lambda rows: rows.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top")))


def kept(spark, path):
    return sorted(map(tuple, upkeep.lists(spark, path).select("k", "n", "top").collect()), key=str)


def test_lists_after_batches_replays_and_restarts_equal_one_batch(spark, tmp_path):
    r = random.Random(3)
    batches = [[(r.choice([None, *range(20)]), r.randint(0, 30)) for _ in range(60)] for _ in range(4)]
    frame = lambda rows: spark.createDataFrame(rows, "k long, v long")
    whole, parts = f"{tmp_path}/whole", f"{tmp_path}/parts"
    put = lambda rows, n, path: upkeep.apply(frame(rows), n, path, ["k"], ["k", "v"], WORK.__func__, 8)
    put([x for b in batches for x in b], 0, whole)
    for n, rows in enumerate(batches):
        put(rows, n, parts)
        put(rows, n, parts)  # the batch failed after its work and is run again
    assert kept(spark, parts) == kept(spark, whole)
    upkeep.compact(spark, parts)
    assert kept(spark, parts) == kept(spark, whole) and upkeep.compact(spark, parts) == 0
    put(batches[3], 3, parts)
    assert kept(spark, parts) == kept(spark, whole)
    put([], 4, parts)
    assert kept(spark, parts) == kept(spark, whole)


def test_a_batch_leaves_other_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "lists")
    put = lambda rows, n: upkeep.apply(spark.createDataFrame(rows, "k long, v long"), n, path, ["k"], ["k", "v"], WORK.__func__, 16)
    put([(k, 1) for k in range(40)], 0)
    put([(7, 5)], 1)
    second = spark.read.parquet(f"{path}/lists").filter("batch = 1")
    assert second.select("bucket").distinct().count() == 1 and second.count() < 40
    assert (7, 2, 5) in kept(spark, path) and len(kept(spark, path)) == 40


def test_kept_lists_stream_goes_on_where_it_stopped(spark, tmp_path):
    feed = Feed(spark, tmp_path, "k long, v long")
    run = lambda: upkeep.keep(feed.stream(), f"{tmp_path}/kept", f"{tmp_path}/state", ["k"], ["k", "v"], WORK.__func__, 4).awaitTermination()
    feed.put([(1, 1), (2, 2)])
    run()
    feed.put([(1, 1), (1, 9), (3, 3)])
    run()
    run()
    assert kept(spark, f"{tmp_path}/kept") == [(1, 2, 9), (2, 1, 2), (3, 1, 3)]


@pytest.mark.parametrize("late", ["0 seconds", "1 hour"])
def test_empty_stream(spark, tmp_path, late):
    feed = Feed(spark, tmp_path, "user long, time timestamp")
    feed.put([])
    assert feed.run(sessions.sessions(feed.stream(), "time", "10 minutes", late, "user")) == []
