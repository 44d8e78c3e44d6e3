"""Small helpers that several corpus operators share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the data folder ``sf_dir`` (any path that Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and return the written rows.

    The folder is the session's ``spark.checkpoint.dir``. Files go when the frame is garbage-collected, if the session
    sets ``spark.cleaner.referenceTracking.cleanCheckpoints``. How many partitions what comes from a shuffle has is left to
    adaptive execution, which goes by their size. Where a session has that switched off, a task writes eight partitions, as
    hundreds of tiny files a step cost the driver more than they spread.
    """
    spark = df.sparkSession
    shared_folder(spark)
    on = all(spark.conf.get(k, "true").lower() == "true" for k in ("spark.sql.adaptive.enabled", "spark.sql.adaptive.coalescePartitions.enabled"))
    if not on:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    return df.checkpoint()


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


def delete(spark: SparkSession, folder: str) -> None:
    """Remove a folder of the shared file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def but(df: DataFrame, *names: str) -> list[str]:
    """The columns of ``df`` except those of these names in any case, as Spark's names have none."""
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]


def col(name: str) -> Column:
    """The column of exactly that name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, names: list[str]) -> Column:
    """The columns ``names`` as one struct, so that no working column can have the name of one of them."""
    return F.struct(*([col(c) for c in names] or [F.lit(0).alias("none")]))


def unpacked(struct: str, names: list[str]) -> list[Column]:
    return [F.col(struct).getField(c).alias(c) for c in names]


def spread(df: DataFrame) -> DataFrame:
    """At least one partition per core, for work that is costlier than its input is large."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


#: Rows of one key that make it hot: it is joined by broadcast, as there can't be more such keys than rows over this.
HOT = 1_000_000
#: Distinct keys up to which a join's smaller side goes to all executors as it is.
FEW = 100_000


def hot_join(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """``left`` with ``value`` of the row of ``right`` that has its ``key``, else null; one key may hold any share of ``left``.

    right: (key, n, value), a row for each key, written; n is at least the number of the key's rows in ``left``. Few keys are
    joined by broadcast. Of many, the hot ones are, and then only the others meet in a shuffle; rows of hot keys and without a
    key are spread over it.
    """
    if right.count() <= FEW:
        return left.join(F.broadcast(right.select(key, value)), key, "left")
    hot = F.broadcast(right.where(F.col("n") >= HOT).select(key, F.col(value).alias("__hot"), F.lit(True).alias("__is_hot")))
    marked = left.join(hot, key, "left")
    alone = F.col("__is_hot").isNotNull() | F.col(key).isNull()
    marked = marked.withColumn("__key", F.when(~alone, F.col(key))).withColumn("__lot", F.when(alone, F.pmod(F.monotonically_increasing_id(), F.lit(4096))).otherwise(-1))
    cold = right.where(F.col("n") < HOT).select(F.col(key).alias("__key"), F.lit(-1).cast("bigint").alias("__lot"), F.col(value).alias("__cold"))
    joined = marked.join(cold, ["__key", "__lot"], "left").withColumn(value, F.when(F.col("__is_hot").isNotNull(), F.col("__hot")).otherwise(F.col("__cold")))
    return joined.drop("__key", "__lot", "__hot", "__is_hot", "__cold")
