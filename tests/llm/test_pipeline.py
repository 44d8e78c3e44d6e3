"""The corpus pipeline against a plain version of it."""

import hashlib

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F
from test_joins import brute_duplicates, brute_lines
from test_text import brute_contamination

import corpus_pipeline
from loomgraph.llm import byte_bpe, toxicity


def test_pipeline_equals_a_plain_version(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").where(toxicity.fold(F.col("doc_id"), 5) != 0)
    score = toxicity.learn(docs.select("doc_id", "text"), labels).scorer()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if score(r["text"]) < 0.5]
    out = {d: (t, n) for d, t, n in brute_lines(rows)}
    rows = [(d, out[d][0]) for d, _ in rows if out[d][0].strip() or not out[d][1]]
    own = brute_duplicates(rows, 5, 80)
    rows = [(d, t) for d, t in rows if own[d][1] == d]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    dirty = {r[0] for r in brute_contamination(rows, items, 10) if r[5]}
    bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = {d: hashlib.sha256(" ".join(map(str, bpe.encode_ordinary(t))).encode()).hexdigest() for d, t in rows if d not in dirty}
    got = {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want and 0 < len(got) < docs.count()


def test_stages_handle_odd_rows(spark, sf, tmp_path):
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "a text without an id", "en", "s", 20), (1, None, "en", "s", 0), (2, "", None, None, 0), (2, "", None, None, 0), (3, "one two three four five six", "en", "s", 27)], spark.read.parquet(f"{sf}/documents.parquet").schema)
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns, name
            assert out.count() == docs.count(), name
        assert corpus_pipeline.tokenize(spark, docs, sf).count() == docs.count()


def test_one_row_of_each_group_stays(spark, sf):
    words = " ".join(f"word{i}" for i in range(40))
    rows = [(5, words, "en", "s", 1), (5, words, "en", "s", 1), (9, words + " more", "en", "s", 1), (None, words, "en", "s", 1), (None, words.upper(), "en", "s", 1), (None, "alone and without an id", "en", "s", 1), (None, "alone and without an id", "en", "s", 1), (7, "", "en", "s", 0), (7, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{sf}/documents.parquet").schema)
    got = sorted((str(r["doc_id"]), r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf).collect())
    assert got == sorted([("5", words), ("None", "alone and without an id"), ("7", ""), ("7", "")])


def test_run_leaves_no_folders(spark, sf):
    import os

    before = set(os.listdir(spark.sparkContext.getCheckpointDir().removeprefix("file:")))
    corpus_pipeline.run(spark, sf)
    after = set(os.listdir(spark.sparkContext.getCheckpointDir().removeprefix("file:")))
    assert not [x for x in after - before if x.startswith(("pipeline-", "lines-"))]
