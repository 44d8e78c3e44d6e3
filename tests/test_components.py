"""Components, condensed closures and bucketed edges against plain Python."""

import random

import pytest

from loomgraph.functions.frames import cut
from loomgraph.operators import components, graph

SCHEMA = "src string, dst string, kind string, confidence string"


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, "calls", "resolved") for a, b in pairs], SCHEMA)


def nodes(spark, names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def reach(pairs, names):
    out = {}
    for n in names:
        seen, todo = {n}, [n]
        while todo:
            x = todo.pop()
            for a, b in pairs:
                if a == x and b not in seen:
                    seen.add(b)
                    todo.append(b)
        out[n] = seen
    return out


@pytest.mark.parametrize("small", [100_000, 0])
def test_components_of_many_shapes(spark, monkeypatch, small):
    monkeypatch.setattr(components.Steps, "SMALL", small)
    random.seed(8)
    pairs = [("z", "z"), ("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("c3", "t"), ("s", "c1"), ("t", "u")]
    for g in range(12):  # parts of their own, some dense, some chains
        names = [f"{g}.{i}" for i in range(random.choice([3, 6, 9]))]
        pairs += [(random.choice(names), random.choice(names)) for _ in range(random.choice([1, 2]) * len(names))]
    names = sorted({x for p in pairs for x in p} | {"lone"})
    far = reach(pairs, names)
    parts = components.strong_components(nodes(spark, ["lone"]), edges(spark, pairs))
    want = {n: min(m for m in far[n] if n in far[m]) for n in names}
    assert {r["node"]: r["part"] for r in parts.collect()} == want
    seeds = ["c2", "s", "lone", "0.0", "3.1", "none"]
    got = [tuple(r) for r in components.closure_of_components(nodes(spark, [*seeds, None, "s"]), edges(spark, pairs)).collect()]
    assert len(got) == len(set(got)) and set(got) == {(s, n) for s in seeds for n in far.get(s, {s})}
    small_graph = components.condensed(edges(spark, pairs), parts)
    assert {tuple(r) for r in small_graph.collect()} == {(want[a], want[b]) for a, b in pairs if want[a] != want[b]}


@pytest.mark.parametrize(("lot", "starts"), [(10, 3), (1 << 19, 2)])
def test_lots_of_any_size_find_the_same(spark, monkeypatch, lot, starts):
    """Several lots send values to each other, one lot ends in a task; walks go by lots of starts, or by joins beyond a lot of links."""
    monkeypatch.setattr(components, "LOT", lot)
    monkeypatch.setattr(components, "STARTS", starts)
    monkeypatch.setattr(components, "HANDED", 4)
    random.seed(5)
    names = [f"n{i}" for i in range(30)]
    pairs = [(random.choice(names), random.choice(names[:20])) for _ in range(45)]
    names = sorted({x for p in pairs for x in p})
    far = reach(pairs, names)
    parts = components.strong_components(nodes(spark, []), edges(spark, pairs))
    assert sorted((r["node"], r["part"]) for r in parts.collect()) == [(n, min(m for m in far[n] if n in far[m])) for n in names]
    counts = components.reach_counts(nodes(spark, [*names, "lone", None]), edges(spark, pairs)).collect()
    assert sorted((r["seed"], r["n"]) for r in counts) == sorted([(n, len(far[n])) for n in names] + [("lone", 1)])


def test_a_long_walk_takes_few_jobs(spark):
    """A chain with a circle at its end takes no round for each step."""
    pairs = [(f"n{i:03}", f"n{i + 1:03}") for i in range(120)] + [("n120", "n110")]
    group = "few-jobs"
    spark.sparkContext.setJobGroup(group, "")
    counts = {r["seed"]: r["n"] for r in components.reach_counts(nodes(spark, ["n000", "n115"]), edges(spark, pairs)).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext._jsc.clearJobGroup()
    assert counts == {"n000": 121, "n115": 11}
    assert 0 < jobs < 120


def test_rounds_leave_the_edges_where_they_are(spark):
    steps = components.Steps(edges(spark, [(f"n{i}", f"n{i // 2}") for i in range(200)]))
    frontier = cut(nodes(spark, ["n100", "n101"]))
    for n, exchanges in ((2, "BroadcastExchange"), (10**9, "Exchange hashpartitioning(node")):
        plan = steps.follow(frontier, n)
        said = plan._jdf.queryExecution().executedPlan().toString()
        assert exchanges in said and said.count("Exchange") == 1
        assert {r["dst"] for r in plan.collect()} == {"n50"}
    steps.close()
    assert not [t for t in spark.catalog.listTables() if t.name == steps.name]


def test_frontiers_of_many_rows_stay_out_of_the_driver(spark):
    steps = components.Steps(edges(spark, [("n1", "n0")]))
    plan = steps.follow(cut(nodes(spark, [f"n{i}" for i in range(20)])), 20_000)
    assert "BroadcastExchange" not in plan._jdf.queryExecution().executedPlan().toString()
    steps.close()


def test_empty_graphs(spark):
    none = edges(spark, [])
    assert components.strong_components(nodes(spark, []), none).count() == 0
    assert [tuple(r) for r in components.strong_components(nodes(spark, ["a"]), none).collect()] == [("a", "a")]
    assert components.closure_of_components(nodes(spark, []), none).count() == 0
    assert graph.closure(nodes(spark, []), none).count() == 0


def test_edges_are_shuffled_once(spark):
    """What is written in buckets is made distinct by the shuffle that deals it out; edges from other sources are left out."""
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), (None, "c"), ("x", "c")], "src string, dst string")
    steps = components.Steps(edges, spark.createDataFrame([("a",), ("b",)], "src string"))
    assert sorted(map(tuple, steps.edges.collect())) == [("a", "b"), ("b", "c")]
    steps.close()
    held = components.Steps(edges)
    reached = graph.closure_from_set(spark.createDataFrame([("a",)], "node string"), edges, held)
    assert {r["node"] for r in reached.collect()} == {"a", "b", "c"}
    assert held.edges.count() == 3
    held.close()
