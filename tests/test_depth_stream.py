"""Call depths as a stream against the batch operator and plain Python, with late and idle threads."""

import random
import uuid
from datetime import datetime, timedelta

import pytest

from loomgraph.operators import analytics
from loomgraph.streaming import depth
from pyspark.sql import functions as F

START = datetime(2024, 1, 1)
SCHEMA = "thread bigint, seq bigint, ts timestamp, qname string, step int"


def fed(spark, folder, batches, **how):
    """Rows of a stream that gets ``batches`` one after the other: (thread, seq, depth)."""
    for i, rows in enumerate(batches):
        spark.createDataFrame([(t, s, START + timedelta(seconds=at), q, step) for t, s, at, q, step in rows], SCHEMA).coalesce(1).write.parquet(f"{folder}/in/lot-{i}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/lot-*")
    out = depth.run_to_end(depth.call_depths(stream, **how), f"{folder}/out")
    return sorted((tuple(r) for r in out.select("thread", "seq", "depth").collect()), key=repr)


def pending(spark, folder):
    reader = spark.read.format("statestore").option("stateVarName", "pending").option("flattenCollectionTypes", "true")
    return reader.load(f"{folder}/out/state").count()


def test_stream_equals_batch_on_shuffled_events(spark, tmp_path):
    rng = random.Random(3)
    events = [(rng.choice([1, 2, None]), i, i * 10, "f", rng.choice([1, -1, -1, 1, 1])) for i in range(120)]
    late = 25  # events move by fewer places than the lateness allows for
    order = sorted(events, key=lambda e: e[2] + rng.randrange(late * 10))
    batches = [order[i : i + 30] for i in range(0, 120, 30)] + [[(9, 999, 100_000, "end", 1)]]
    got = fed(spark, tmp_path, batches, late="250 seconds")
    rows = spark.createDataFrame([(t, s, START + timedelta(seconds=at), q, step) for t, s, at, q, step in events], SCHEMA)
    want = analytics.call_depths(rows).select("thread", "seq", "depth").collect()
    assert got == sorted(map(tuple, want), key=repr)
    assert pending(spark, tmp_path) == 1  # all final events have left the state


def test_late_events_are_dropped_and_pending_ones_wait(spark, tmp_path):
    batches = [[(1, 1, 0, "a", 1), (1, 2, 100, "b", 1)], [(1, 3, 1000, "c", 1)], [(1, 5, 990, "in time", -1)], [(1, 4, 50, "late", 1)], [(1, 6, 5000, "end", 1)]]
    assert fed(spark, tmp_path, batches, late="60 seconds") == [(1, 1, 1), (1, 2, 2), (1, 3, 2), (1, 5, 1)]
    assert pending(spark, tmp_path) == 1


@pytest.mark.parametrize(("idle", "last"), [(None, 3), (600_000, 1)])
def test_idle_threads_begin_anew(spark, tmp_path, idle, last):
    batches = [[(1, 1, 0, "a", 1), (1, 2, 1, "b", 1)], [(2, 3, 2000, "x", -1)], [(2, 4, 2001, "x", 1)], [(1, 5, 4000, "c", 1)], [(2, 6, 9000, "end", 1)], [(2, 7, 9001, "end", 1)]]
    got = fed(spark, tmp_path, batches, late="10 seconds", idle_ms=idle)
    assert (1, 5, last) in got and (1, 2, 2) in got


def test_captured_frames(spark):
    rows = spark.createDataFrame([("/a/x.py", "f"), ("/a/x.py", "f.<locals>.g"), ("/b/x.py", "f"), (None, "f")], "path string, qname string")
    assert [tuple(r) for r in depth.captured(rows, "/a/").collect()] == [("/a/x.py", "f")]


def test_replay_of_an_empty_table(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    stream, late = depth.replayed(spark, none, str(tmp_path / uuid.uuid4().hex), 2)
    assert depth.run_to_end(depth.call_depths(stream, late), str(tmp_path / "out")).count() == 0
    assert none.select(F.count("*")).first()[0] == 0


def test_state_is_kept_by_bucket_not_by_thread(spark, tmp_path):
    rng = random.Random(5)
    threads = [None, 0, -1, 2**62 + 1, 2**62 + 2, *range(10, 2005)]
    events = [(t, i * len(threads) + k, i * 10, "f", rng.choice([1, 1, -1, -1])) for i in range(3) for k, t in enumerate(threads)]
    ends = [(t, 10_000 + k, 100_000, None, 1) for k, t in enumerate(threads)]
    got = fed(spark, tmp_path, [events[::2], events[1::2], ends], late="250 seconds")
    rows = spark.createDataFrame([(t, s, START + timedelta(seconds=at), q, step) for t, s, at, q, step in events], SCHEMA)
    assert got == sorted(map(tuple, analytics.call_depths(rows).select("thread", "seq", "depth").collect()), key=repr)
    assert 0 < pending(spark, tmp_path) <= 512 < len(threads)


def test_idle_threads_of_one_bucket_are_as_those_of_many(spark, tmp_path):
    rng = random.Random(7)
    batches = [[(rng.randrange(12), i * 20 + j, i * 60 + rng.randrange(60), "f", rng.choice([1, 1, -1])) for j in range(5)] for i in range(9)] + [[(77, 999, 9000, "end", 1)]]
    one, many = (fed(spark, tmp_path / str(n), batches, late="70 seconds", idle_ms=10_000, buckets=n) for n in (1, 512))
    assert one == many and len(one) == 45
    rows = spark.createDataFrame([(t, s, START + timedelta(seconds=at), q, step) for t, s, at, q, step in sum(batches[:-1], [])], SCHEMA)
    never = analytics.call_depths(rows.withColumn("seq", F.unix_micros("ts") * 1000 + F.col("seq"))).select("thread", F.col("seq") % 1000, "depth")
    assert one != sorted((tuple(r) for r in never.collect()), key=repr)  # some thread was forgotten


def test_batches_of_a_replay_are_no_more_for_more_files(spark, tmp_path):
    rows = spark.range(0, 1200, 1, 150).select((F.col("id") % 7).alias("thread"), F.col("id").alias("seq"), F.timestamp_seconds(1_700_000_000 + F.col("id") % 8 * 150 + F.floor(F.col("id") / 8)).alias("ts"), F.lit("f").alias("qname"), F.when(F.col("id") % 3 == 0, -1).otherwise(1).alias("step"))
    stream, late = depth.replayed(spark, rows, str(tmp_path / "events"))  # 600 files
    got = depth.run_to_end(depth.call_depths(stream, late), str(tmp_path / "out"))
    assert len(list((tmp_path / "out/state/offsets").glob("[0-9]*"))) <= 7  # four lots, the last row, and batches without data
    want = analytics.call_depths(rows.withColumn("seq", F.unix_micros("ts"))).select("thread", "depth", F.timestamp_micros("seq").alias("ts"))
    assert sorted(map(tuple, got.select("thread", "depth", "ts").collect())) == sorted(map(tuple, want.collect()))
