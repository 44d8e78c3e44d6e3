"""Preorder intervals, range minima and tree distances against plain Python."""

import random

import numpy as np
import pytest

from loomgraph.operators import analytics, graph
from loomgraph.operators.tree_order import RangeMinimum, intervals


def random_forest(rng, n):
    parent = {f"n{i:03}": (f"n{rng.randrange(max(0, i - 50), i):03}" if i and rng.random() < 0.95 else None) for i in range(n)}
    return parent


def plain_intervals(parent):
    kids = {}
    for n, p in parent.items():
        kids.setdefault(p, []).append(n)
    out, count = {}, 0

    def go(n, depth):
        nonlocal count
        first = count
        count += 1
        for k in sorted(kids.get(n, [])):
            go(k, depth + 1)
        out[n] = (depth, first, count - 1)

    for root in sorted(kids.get(None, [])):
        go(root, 0)
    return out


def test_intervals_of_a_forest(spark):
    parent = random_forest(random.Random(2), 120)
    rows = intervals(spark.createDataFrame(list(parent.items()), "node string, parent string")).collect()
    assert {r["node"]: (r["depth"], r["first"], r["last"]) for r in rows} == plain_intervals(parent) and len(rows) == 120
    assert intervals(spark.createDataFrame([], "node string, parent string")).count() == 0
    with pytest.raises(ValueError):
        intervals(spark.createDataFrame([("a", "b"), ("a", "c")], "node string, parent string"))


def test_range_minima():
    rng = random.Random(1)
    x = [rng.randrange(50) for _ in range(37)]
    r = RangeMinimum(x)
    assert all(r.of(i, j) == min(x[i:j], default=RangeMinimum.NONE) for i in range(38) for j in range(i, 38))
    assert RangeMinimum([]).of(0, 0) == RangeMinimum.NONE


@pytest.mark.parametrize("block", [1024, 7])
def test_distances_along_trees(spark, monkeypatch, block):
    monkeypatch.setattr(analytics, "BLOCK", block)
    rng = random.Random(3)
    parent = random_forest(rng, 60)
    v = {n: np.array([rng.gauss(0, 1) for _ in range(4)]) for n in parent if rng.random() < 0.8}
    up = {}
    for n, p in parent.items():
        up[n] = [n, *(up[p] if p else [])]
    want = []
    for a in v:
        for b in v:
            if a < b and up[a][-1] == up[b][-1]:
                s = v[a] @ v[b] / np.linalg.norm(v[a]) / np.linalg.norm(v[b])
                want.append((round(1 - s, 9), len(up[a]) + len(up[b]) - 2.0 * len(set(up[a]) & set(up[b]))))
    tree = spark.createDataFrame(list(parent.items()), "node string, parent string")
    vectors = spark.createDataFrame([(n, x.tolist()) for n, x in v.items()] + [("elsewhere", [1.0, 0.0, 0.0, 0.0])], "node string, vector array<double>")
    got = sorted((round(r["far"], 9), r["steps"]) for r in analytics.tree_distances(tree, vectors).collect())
    assert len(got) > 100 and got == sorted(want)


def test_visit_order_of_random_graphs(spark):
    rng = random.Random(9)
    names = [f"n{i}" for i in range(9)]
    pairs = sorted({(rng.choice(names), rng.choice(names)) for _ in range(20)})
    out = []

    def go(n, path, depth):
        out.append(("enter", n, depth))
        for c in sorted({b for a, b in pairs if a == n})[:3] if depth < 4 else ():
            if c not in path:
                go(c, [*path, c], depth + 1)
        out.append(("exit", n, depth))

    for start in ("n3", "n0", "n3"):
        go(start, [start], 0)
    edges = spark.createDataFrame([(a, b, "calls", "resolved") for a, b in pairs], "src string, dst string, kind string, confidence string")
    got = graph.visit_order(spark.createDataFrame([("n3", 0), ("n0", 1), ("n3", 2)], "node string, ord int"), edges, max_depth=4, most_children=3).orderBy("seq").collect()
    assert [r["seq"] for r in got] == list(range(1, len(out) + 1)) and [(r["action"], r["node"], r["depth"]) for r in got] == out
