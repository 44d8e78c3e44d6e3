"""S18, X19 as a stream: call depths of threads from call and return events that arrive late and out of order.

Threads are dealt to buckets, and a bucket is what Spark keeps state and a timer for: calls to the state cost per bucket, not per thread,
and its threads are walked together. State of a bucket is what its threads have pending, in lots as they came, and each thread's depth
and the time of its last event. Events wait until the watermark has passed their time, when none before them can come any more; a
timer for the earliest then wakes the bucket, which emits what is final, for each thread in the order of (ts, seq). So pending events
are those of the allowed lateness. With ``idle`` a thread without events for that long is forgotten, and begins anew at depth 0; without
it a thread keeps one number for good.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "thread bigint, seq bigint, ts timestamp, qname string, step int, depth int"
EVENTS = pa.schema([("known", pa.bool_()), ("thread", pa.int64()), ("at", pa.int64()), ("seq", pa.int64()), ("qname", pa.string()), ("step", pa.int32())])
THREADS = pa.schema([("known", pa.bool_()), ("thread", pa.int64()), ("depth", pa.int64()), ("last", pa.int64())])
KEY = ["known", "thread"]  # events without a thread have known false and thread 0
BUCKETS, FULL = 512, 50_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def captured(frames: DataFrame, prefix: str) -> DataFrame:
    """Events (path, qname, ...) of frames of files under ``prefix``, without those of inner functions."""
    return frames.where(F.col("path").startswith(prefix) & ~F.col("qname").contains(".<locals>."))


def packed(rows: pd.DataFrame, schema: pa.Schema) -> bytes:
    return pa.RecordBatch.from_pandas(rows, schema, preserve_index=False).serialize().to_pybytes()


def unpacked(lots: list[bytes], schema: pa.Schema) -> pd.DataFrame:
    return pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(lot), schema) for lot in lots], schema).to_pandas()


def walked(events: pd.DataFrame, so_far: pd.DataFrame) -> pd.DataFrame:
    """Events of many threads in the order of (at, seq) within a thread, with the ``depth`` after each, from the thread's depth in
    ``so_far`` on (else 0); never below 0."""
    out = events.sort_values([*KEY, "at", "seq"], kind="stable").merge(so_far[[*KEY, "depth"]], "left", KEY)
    level = out["depth"].fillna(0).astype("int64") + out.groupby(KEY)["step"].cumsum()
    out["depth"] = level - level.groupby([out[k] for k in KEY]).cummin().clip(upper=0)
    return out


class Depths(StatefulProcessor):
    def __init__(self, idle_ms: int | None) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "events binary")
        self.so_far = handle.getValueState("so_far", "threads binary")

    def _wake(self, timers: list[int], at_us: int | None) -> None:
        for timer in timers:
            self.handle.deleteTimer(timer)
        if at_us is not None:
            self.handle.registerTimer(at_us // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        low = None
        for frame in rows:
            self.pending.appendValue((packed(frame[EVENTS.names], EVENTS),))
            low = int(frame["at"].min()) if low is None else min(low, int(frame["at"].min()))
        timers = list(self.handle.listTimers())
        if low is not None and low // 1000 + 1 < min(timers, default=low // 1000 + 2):
            self._wake(timers, low)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        pending = unpacked([lot for (lot,) in self.pending.get()] if self.pending.exists() else [], EVENTS)
        so_far = unpacked(list(self.so_far.get()) if self.so_far.exists() else [], THREADS)
        final, rest = pending[pending["at"] <= passed], pending[pending["at"] > passed]
        threads, wakes = so_far, list(rest["at"])
        out = walked(final, so_far)
        if len(out):
            ends = out.drop_duplicates(KEY, keep="last").rename(columns={"at": "last"})
            threads = pd.concat([so_far, ends[THREADS.names]]).drop_duplicates(KEY, keep="last")
            if len(rest):
                self.pending.put([(packed(rest, EVENTS),)])
            else:
                self.pending.clear()
        if self.idle_ms is not None:
            waits = (threads[KEY].merge(rest[KEY].drop_duplicates(), "left", KEY, indicator=True)["_merge"] == "both").to_numpy()
            ends_us = threads["last"] + self.idle_ms * 1000
            wakes += list(ends_us[~waits & (ends_us > passed)])
            threads = threads[waits | (ends_us > passed)]
        if len(out) or len(threads) < len(so_far):
            if len(threads):
                self.so_far.update((packed(threads, THREADS),))
            else:
                self.so_far.clear()
        self._wake(list(self.handle.listTimers()), int(min(wakes)) if wakes else None)
        if len(out):
            thread = out["thread"].astype("Int64").where(out["known"])
            yield pd.DataFrame({"thread": thread, "seq": out["seq"], "ts": pd.to_datetime(out["at"], unit="us"), "qname": out["qname"], "step": out["step"], "depth": out["depth"]})

    def close(self) -> None:
        pass


def buckets_for(events: int) -> int:
    """Buckets that hold about ``FULL`` of so many events at most, and ``BUCKETS`` at least."""
    return max(BUCKETS, events // FULL)


def call_depths(stream: DataFrame, late: str = "10 minutes", idle_ms: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Events (thread, seq, ts, qname, step) with ``depth`` after each, as ``analytics.call_depths`` has it in the order (ts, seq).

    Events that come later than ``late`` after their time are dropped. The session needs the RocksDB state store and UTC. Events
    without a thread share one; rows without a time, a seq or a step are left out. A worker holds one of ``buckets`` at a time, each
    with the pending events and the depths of its threads; their number is fixed for the life of a checkpoint.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    known = stream.where("ts IS NOT NULL AND seq IS NOT NULL AND step IS NOT NULL").withWatermark("ts", late)
    thread = F.col("thread").cast("bigint")
    known = known.select(F.pmod(F.xxhash64(thread), F.lit(buckets)).alias("bucket"), thread.isNotNull().alias("known"), F.coalesce(thread, F.lit(0)).alias("thread"), F.col("seq").cast("bigint").alias("seq"), "ts", F.unix_micros("ts").alias("at"), "qname", F.col("step").cast("int").alias("step"))
    return known.groupBy("bucket").transformWithStateInPandas(Depths(idle_ms), OUT, "Append", "EventTime")


def run_to_end(df: DataFrame, folder: str) -> DataFrame:
    """What a stream gives until its source has no more, as a table in ``folder``; the checkpoint lies beside it, so a stream that was
    stopped goes on."""
    query = df.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/rows")


def replayed(spark: SparkSession, events: DataFrame, folder: str, lots: int = 4) -> tuple[DataFrame, str]:
    """Stored events (thread, seq, ts, qname, step) as a stream, and the lateness that it needs: ``lots`` parts of equal time, one
    after the other, each in any order; a batch takes a whole lot, so that batches are no more for more events. A last row, of step 0, moves the watermark past all of them and is never final itself."""
    events, at = events.select("thread", "seq", F.col("ts").cast("timestamp").alias("ts"), "qname", "step"), F.unix_micros("ts")
    low, high = events.agg(F.min(at), F.max(at)).first()
    low, high = low or 0, high or 0
    long = (high - low) // lots + 1
    for lot in range(lots):
        events.where((at >= low + lot * long) & (at < low + (lot + 1) * long)).write.parquet(f"{folder}/lot-{lot}")
    end, none = F.timestamp_micros(F.lit(high + 4 * long + 1_000_000)), F.lit(None)
    spark.range(1).select(none.cast("bigint").alias("thread"), F.lit(-1).cast("bigint").alias("seq"), end.alias("ts"), none.cast("string").alias("qname"), F.lit(0).alias("step")).write.parquet(f"{folder}/lot-{lots}")
    files = max(64, events.rdd.getNumPartitions())  # a lot has one for each partition at most
    stream = spark.readStream.schema("thread bigint, seq bigint, ts timestamp, qname string, step int").option("maxFilesPerTrigger", files).parquet(f"{folder}/lot-*")
    return stream, f"{2 * long} microseconds"
