import random

import pytest

from pyspark.sql import functions as F

from loomgraph.operators import graph
from loomgraph.plans import registry, tables


def edges(spark, pairs, kind="calls", confidence="resolved"):
    return spark.createDataFrame([(a, b, kind, confidence) for a, b in pairs], "src string, dst string, kind string, confidence string")


def nodes(spark, names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def closure(seeds, pairs):
    seen, todo = set(seeds), list(seeds)
    while todo:
        n = todo.pop()
        for a, b in pairs:
            if a == n and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


@pytest.mark.parametrize("seed", range(3))
def test_closures_on_random_graphs(spark, seed):
    random.seed(seed)
    names = [f"n{i}" for i in range(12)]
    pairs = {(random.choice(names), random.choice(names)) for _ in range(18)}
    e = edges(spark, pairs)
    assert {r[0] for r in graph.reachable(nodes(spark, ["n0", "zz"]), e).collect()} == closure({"n0", "zz"}, pairs)
    got = {tuple(r) for r in graph.closure(nodes(spark, ["n0", "n1"]), e).collect()}
    assert got == {(s, n) for s in ("n0", "n1") for n in closure({s}, pairs)}
    first = {b for a, b in pairs if a == "n2"}
    assert {r[0] for r in graph.descendants(nodes(spark, ["n2"]), e).collect()} == (closure(first, pairs) if first else set())
    assert {r[0] for r in graph.cone(nodes(spark, ["n2"]), e).collect()} == closure({"n2"}, pairs) - {"n2"}
    weak = graph.weak_components(nodes(spark, names), e).collect()
    both = pairs | {(b, a) for a, b in pairs}
    assert {r["node"]: r["part"] for r in weak} == {n: min(closure({n}, both)) for n in names}


def test_kinds_and_uncertain(spark):
    e = edges(spark, [("a", "b")]).unionByName(edges(spark, [("b", "c")], "contains")).unionByName(edges(spark, [("a", "d")], "calls", None))
    assert {r[0] for r in graph.reachable(nodes(spark, ["a"]), e, ("calls",)).collect()} == {"a", "b", "d"}
    assert [(r["src"], r["dst"]) for r in graph.uncertain(e).collect()] == [("a", "d")]


def walk(start, children, most, deepest):
    out = []

    def go(n, path, depth):
        out.append(("enter", n, depth))
        if depth < deepest:
            for c in sorted(set(children.get(n, [])))[:most]:
                if c not in path:
                    go(c, [*path, c], depth + 1)
        out.append(("exit", n, depth))

    go(start, [start], 0)
    return out


def test_visit_order_of_a_diamond_with_a_cycle(spark):
    pairs = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("d", "e"), ("a", "z")]
    children = {}
    for a, b in pairs:
        children.setdefault(a, []).append(b)
    got = graph.visit_order(spark.createDataFrame([("a", 0)], "node string, ord int"), edges(spark, pairs), max_depth=3, most_children=2).orderBy("seq").collect()
    assert [(r["action"], r["node"], r["depth"]) for r in got] == walk("a", children, 2, 3)
    with pytest.raises(ValueError):
        graph.visit_order(spark.createDataFrame([("a", 0)], "node string, ord int"), edges(spark, pairs), most_rows=3)


def test_depths(spark):
    pairs = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "c"), ("x", "y"), ("y", "x")]
    got = {r["node"]: r["depth"] for r in graph.depths(nodes(spark, "abcxyz"), edges(spark, pairs)).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "x": 0, "y": 0, "z": 0}
    ring = [("s", "p"), ("p", "q"), ("q", "p")]
    got = {r["node"]: r["depth"] for r in graph.depths(nodes(spark, "spq"), edges(spark, ring)).collect()}
    assert got["s"] == 0 and got["p"] == got["q"] == 2


def test_primary_tree(spark):
    pairs = [("a", "c"), ("b", "c"), ("c", "d"), ("a", "d"), ("b", "e"), ("e", "d")]
    got = {r["node"]: (r["parent"], r["level"]) for r in graph.primary_tree(nodes(spark, "abcdef"), edges(spark, pairs)).collect()}
    assert got == {"a": (None, 0), "b": (None, 0), "c": ("a", 1), "d": ("a", 1), "e": ("b", 1)}


def plain_tree(pairs):
    callees, callers = {}, {}
    for a, b in pairs:
        if a != b:
            callees.setdefault(a, set()).add(b)
            callers.setdefault(b, set()).add(a)
    queue = sorted(n for n in callees if n not in callers)
    placed = dict.fromkeys(queue, (None, 0))
    for n in queue:
        for child in sorted(callees.get(n, ())):
            if child not in placed and n == min(c for c in callers[child] if c in placed):
                placed[child] = (n, placed[n][1] + 1)
                queue.append(child)
    return placed


def test_primary_tree_against_the_walk(spark):
    random.seed(4)
    pairs = []
    for g in range(60):  # parts that share no node
        n = random.choice([4, 8, 14])
        names = [f"{g}.{x}" for x in random.sample("abcdefghijklmn", n)]
        edge = lambda names=names: (names[random.randrange(len(names))], names[random.randrange(1, len(names))])
        pairs += [edge() for _ in range(random.choice([n, 2 * n, 3 * n]))]
    pairs += [("z.f", "z.c"), ("z.f", "z.b"), ("z.b", "z.c"), ("z.f", "z.a"), ("z.a", "z.b")]  # b falls to a, so c to f
    known = {x for p in pairs for x in p}
    got = {r["node"]: (r["parent"], r["level"]) for r in graph.primary_tree(nodes(spark, known), edges(spark, pairs)).collect()}
    assert got == plain_tree(pairs)


def test_primary_tree_query_covers_the_graph(spark, sf):
    e = {(r["src"], r["dst"]) for r in tables.edges(spark, sf).select("src", "dst").collect()}
    rows = registry.QUERIES["primary_tree"](spark, sf).collect()
    assert {r["node"]: (r["parent"], r["level"]) for r in rows} == plain_tree(e) and {r["node"][0] for r in rows} == set("RNCSOP")


def test_walks_and_texts(spark):
    e = edges(spark, [("a", "b"), ("b", "a"), ("b", "c"), ("x", "y")])
    assert {tuple(r) for r in graph.walked_edges(nodes(spark, ["a"]), e).collect()} == {("a", "b"), ("b", "a"), ("b", "c")}
    scored = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.5), ("a", "d", 0.4), ("b", "e", 0.6), ("e", "a", 0.9)], "src string, dst string, score double")
    assert {(r["src"], r["dst"], r["depth"]) for r in graph.predicted_walk(nodes(spark, ["a"]), scored).collect()} == {("a", "b", 0), ("b", "e", 1), ("e", "a", 2)}
    texts = graph.tier_texts(nodes(spark, ["a"]), e, spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "node string, source string"))
    assert texts.collect()[0]["text"] == "A\n\nB\n\nC"
    named = spark.createDataFrame([("m.main", 0), ("main.x", 1), ("k.main", 2)], "node string, ord int")
    assert graph.entry_node(named, "main").collect()[0][0] == "m.main"


def test_empty_graph(spark):
    none = edges(spark, [])
    assert graph.reachable(nodes(spark, []), none).count() == 0
    assert graph.peaks_and_orphans(nodes(spark, ["a"]), none).collect()[0]["is_orphan"]
    assert graph.depths(nodes(spark, []), none).count() == 0


def test_graph_without_sources_has_a_tree(spark):
    """Where everything is called, the first node is the peak; where no peak calls, peaks are no orphans."""
    got = {r["node"]: (r["parent"], r["level"]) for r in graph.primary_tree(nodes(spark, "ab"), edges(spark, [("a", "b"), ("b", "a")])).collect()}
    assert got == {"a": (None, 0), "b": ("a", 1)}
    lone = graph.primary_tree(nodes(spark, "ab"), edges(spark, [])).collect()
    assert {r["node"]: r["parent"] for r in lone} == {"a": None, "b": None}
    flags = lambda n, e: {r["node"]: (r["is_peak"], r["is_orphan"]) for r in graph.peaks_and_orphans(nodes(spark, n), edges(spark, e), fallback=True).collect()}
    assert flags("ab", [("a", "b"), ("b", "a")]) == {"a": (True, False), "b": (False, False)}
    assert flags("ab", []) == {"a": (True, False), "b": (True, False)}
    assert flags("abc", [("a", "b")]) == {"a": (True, False), "b": (False, False), "c": (True, True)}


def test_many_seeds_and_few_agree(spark, monkeypatch):
    pairs = [(chr(97 + i), chr(97 + j)) for i, j in [(0, 1), (1, 2), (2, 0), (3, 2), (4, 5), (6, 6), (5, 7)]]
    seeds = nodes(spark, "adegz")
    want = {(r["seed"], r["node"]) for r in graph.closure(seeds, edges(spark, pairs)).collect()}
    monkeypatch.setattr(graph, "BITS", 1)
    assert {(r["seed"], r["node"]) for r in graph.closure(seeds, edges(spark, pairs)).collect()} == want
    assert ("a", "c") in want and ("e", "h") in want and ("z", "z") in want and len(want) == 3 + 4 + 3 + 1 + 1


def test_subtree_sizes_of_a_long_chain(spark):
    tree = spark.createDataFrame([(f"n{i:02}", f"n{i - 1:02}" if i else None) for i in range(12)] + [("x", "n03")], "node string, parent string")
    got = {r["node"]: r["size"] for r in graph.subtree_sizes(tree).collect()}
    assert got["n00"] == 13 and got["n03"] == 10 and got["n04"] == 8 and got["x"] == 1 and len(got) == 13


def test_numbers_in_order(spark):
    from loomgraph.functions.frames import in_order

    df = spark.range(500).withColumn("k", (F.col("id") * 37) % 500).repartition(7)
    assert all(r["nth"] == r["k"] for r in in_order(df, "k").collect())
    assert in_order(df.limit(0), "k").count() == 0
