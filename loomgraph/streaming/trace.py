"""Traces as streams (S18, A1): call events arrive as files; counts and windows are kept by Structured Streaming.

The batch operators in ``operators.analytics`` work on the same columns; these only add watermarks and sinks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "seq bigint, ts timestamp, thread bigint, qname string, step int"


def events(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of call (step 1) and return (step -1) events from JSON files in a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def visit_counts(stream: DataFrame) -> DataFrame:
    """A1 as a running count by name; for a sink in complete or update mode."""
    return stream.where("step = 1").groupBy("qname").agg(F.count("*").alias("visits"))


def windowed_counts(stream: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Calls by name and window; state older than the watermark goes, so it stays bounded."""
    return stream.where("step = 1").withWatermark("ts", late).groupBy(F.window("ts", window), "qname").agg(F.count("*").alias("visits"))


def to_memory(df: DataFrame, name: str, mode: str = "complete"):
    """A query that keeps its result in a table of the session, for tests and notebooks."""
    return df.writeStream.outputMode(mode).format("memory").queryName(name).start()
