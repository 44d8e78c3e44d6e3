"""Frame helpers: cutting lineage, first and last rows of a key, set tests."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names. Only where it names none and all runs in one process a temporary one is
    set; on a cluster that would be lost with its machine, so there it is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from there: loops keep plans of constant size and survive lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def one_per(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", n).where("__n = 1").drop("__n")


def in_order(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` with ``nth``, its rows' numbers from 0 in that order: sorted by ranges, counted per range, no task sees all rows."""
    # rows are numbered within the ranges as written, so that a second run can't deal them otherwise
    rows = cut(df.sort(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = rows.groupBy("__part").agg(F.count("*").alias("__size"))
    before = F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    return rows.join(F.broadcast(sizes.select("__part", before.alias("__before"))), "__part").withColumn("nth", F.col("__before") + F.col("__at")).drop("__part", "__at", "__before", "__size")


def running(df: DataFrame, key: str, n: str) -> DataFrame:
    """``df`` with ``below``: the sum of ``n`` over rows with a smaller ``key`` (each key once); by ranges, no task sees all rows."""
    rows = cut(df.sort(key).withColumn("__part", F.spark_partition_id()))
    before = rows.groupBy("__part").agg(F.sum(n).alias("__sum"))
    start = F.coalesce(F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    inside = F.coalesce(F.sum(n).over(Window.partitionBy("__part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("__in", inside).join(F.broadcast(before.select("__part", start.alias("__before"))), "__part").withColumn("below", F.col("__in") + F.col("__before")).drop("__part", "__in", "__before")


class Pile:
    """Rows found round by round: each round is written once, and all are packed together when they are many."""

    MOST = 8

    def __init__(self, df: DataFrame) -> None:
        self.parts = [df]

    def add(self, df: DataFrame) -> None:
        self.parts.append(df)
        if len(self.parts) > self.MOST:
            self.parts = [cut(self.all())]

    def all(self) -> DataFrame:
        out = self.parts[0]
        for df in self.parts[1:]:
            out = out.unionByName(df)
        return out


def lack(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key ``other`` doesn't have."""
    return df.join(other.select(*keys).distinct(), keys, "left_anti")


def have(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key ``other`` has."""
    return df.join(other.select(*keys).distinct(), keys, "left_semi")
