"""Label search and merged graphs against plain Python."""

import random

import pytest

from loomgraph.operators import search


@pytest.mark.parametrize("few", [100_000, 0])
def test_search_against_a_scan(spark, monkeypatch, few):
    monkeypatch.setattr(search, "FEW_QUERIES", few)
    rng = random.Random(1)
    say = lambda n: "".join(rng.choices("abcÄé _", k=n))
    labels = [(f"n{i}", say(rng.choice([0, 1, 2, 3, 6, 12]))) for i in range(150)] + [("null", None), ("same", "abc"), ("same2", "ABC")]
    queries = [*{say(rng.choice([1, 2, 3, 4])) for _ in range(40)}, "ABC", "zzz", "", None]
    nodes = spark.createDataFrame(labels, "node string, label string")
    got = [tuple(r) for r in search.find_labels(spark.createDataFrame([(q,) for q in queries], "query string"), search.label_index(nodes), nodes).collect()]
    want = {(q, n) for q in queries if q for n, text in labels if text is not None and q.lower() in text.lower()}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_merged_edges(spark):
    schema = "src string, dst string, kind string, confidence string"
    one = spark.createDataFrame([("a", "b", "calls", "unknown"), ("a", "c", "calls", "heuristic"), ("a", "d", "calls", None), ("a", "b", "calls", "unknown")], schema)
    two = spark.createDataFrame([("a", "b", "calls", "resolved"), ("a", "b", "contains", "resolved"), ("a", "c", "calls", "odd")], schema)
    rows = {tuple(r) for r in search.merged_edges(one, two).collect()}
    assert rows == {("a", "b", "calls", "resolved", "both"), ("a", "c", "calls", "heuristic", "both"), ("a", "d", "calls", "unknown", "first"), ("a", "b", "contains", "resolved", "second")}
