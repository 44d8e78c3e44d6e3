"""Corpus pipeline: toxicity filter, line dedup, near-duplicate removal, benchmark decontamination, tokenizing.

Every stage works on all documents that its predecessor kept. All but the last return the columns of documents;
the last returns doc_id, n_tokens, ids_sha256 and decoded_sha256. Rows with a null id are documents of their own, known by their
text; line dedup leaves them as they are. Null texts are empty texts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import byte_bpe, decontaminate, line_dedup, minhash, toxicity
from loomgraph.llm.common import cut, delete, shared_folder, table

#: Rejected rows that go to all executors; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def without(docs: DataFrame, rejected: DataFrame, id: str = "doc_id", how: str = "left_anti") -> DataFrame:
    """``docs`` without the rows of ``rejected`` (doc_id, text_hash), null-safe; with ``left_semi`` those rows alone."""
    rejected = rejected.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    small = F.broadcast(rejected) if rejected.count() <= BROADCAST_ROWS else rejected
    return docs.join(small, F.col(id).eqNullSafe(F.col("__id")) & F.xxhash64("text").eqNullSafe(F.col("__hash")), how)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; learned from the labelled rows that op4 may learn from too."""
    labels = table(spark, sf_dir, "labels").where(toxicity.fold(F.col("doc_id"), 5) != 0)
    model = toxicity.learn(docs.select("doc_id", "text"), labels)
    return toxicity.score(docs, model, keep_text=True, out="__toxicity").where("__toxicity < 0.5").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier one has; one that loses its last line goes."""
    out = line_dedup.dedup_lines(docs).where(~((F.col("n_dropped") > 0) & ~F.col("text").rlike(r"\S")))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at 0.8 over five-word shingles: the one with the smallest id. Of rows that repeat an id and a
    text one stays; rows without an id take part and come last. Texts without words are copies of nothing."""
    text = F.xxhash64("text")
    stand_in = F.lit(1 << 62) + text.bitwiseAND(F.lit((1 << 61) - 1))  # above all ids that are counted up
    own = F.coalesce(F.col("doc_id").cast("bigint"), stand_in)
    found = cut(minhash.near_duplicates(docs.select(own.alias("doc_id"), "text"), words=5, percent=80).where("n_shingles > 0"))
    docs_ = docs.withColumn("__own", own)
    left = without(docs_, found.where("NOT kept"), "__own")
    again = cut(found.where("kept").groupBy("doc_id", "text_hash").count().where("count > 1"))
    if not again.isEmpty():
        left = without(left, again, "__own").unionByName(without(left, again, "__own", "left_semi").dropDuplicates(["__own", "text"]))
    return left.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return without(docs, decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document that is left."""
    return byte_bpe.tokenize_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("tokenize", tokenize),
]

#: The toxicity model and edit-distance classes can't be said in SQL; tests/llm compares run() with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, written; the folders between the stages are gone by then."""
    docs = table(spark, sf_dir, "documents")
    folder, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            delete(spark, f"{folder}/{before}")
        before = name
    out = cut(STAGES[-1][1](spark, docs, sf_dir))
    delete(spark, folder)
    return out
