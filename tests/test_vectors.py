"""Trees with vectors against plain Python, over all places and in several blocks."""

import numpy as np
import pytest

from loomgraph.functions.frames import cut
from loomgraph.operators import analytics
from loomgraph.plans import registry


@pytest.fixture(scope="module")
def places(spark, sf):
    tree, vectors = registry.place_vectors(spark, sf)
    parent = {r["node"]: r["parent"] for r in tree.collect()}
    v = {r["node"]: np.array(r["vector"], float) for r in vectors.collect()}
    names = sorted(v)
    m = np.array([v[n] / np.linalg.norm(v[n]) for n in names])
    at = {n: i for i, n in enumerate(names)}
    up = {}
    for n in names:
        up[n], p = [], parent.get(n)
        while p:
            up[n].append(p)
            p = parent[p]
    return parent, names, at, m @ m.T, up


@pytest.mark.parametrize("block", [1024, 7])
def test_containment_over_all_places(spark, sf, places, monkeypatch, block):
    monkeypatch.setattr(analytics, "BLOCK", block)
    _, names, at, s, up = places
    pairs = [(a, n) for n in names for a in up[n]]
    bound = {a: max(s[at[a], at[b]] for b in names if b != a and a not in up[b] and b not in up[a]) for a in {a for a, _ in pairs}}
    passed = sum(s[at[a], at[b]] > bound[a] for a, b in pairs)
    got = registry.QUERIES["containment_rate"](spark, sf).collect()
    assert [tuple(r) for r in got] == [(len(pairs), passed, round(passed / len(pairs), 6))] and len(pairs) > 300


@pytest.mark.parametrize("block", [1024, 3])
def test_splits_over_all_places(spark, sf, places, monkeypatch, block):
    monkeypatch.setattr(analytics, "BLOCK", block)
    parent, names, at, s, up = places
    c = lambda a, b: s[at[a], at[b]]
    want = {(parent[a], a, b, bool(c(a, b) < c(parent[a], a) and c(a, b) < c(parent[a], b))) for a in names if up[a] for b in names if a < b and parent.get(b) == parent[a]}
    rows = [tuple(r) for r in registry.QUERIES["split_distinctness"](spark, sf).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and any(r[1].startswith("C:") for r in rows)


def ranks(values):
    _, inverse, n = np.unique(values, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2)[inverse]


def test_correlation_over_all_places(spark, sf, places):
    _, names, at, s, up = places
    far, steps = [], []
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            x, y = [a, *up[a]], [b, *up[b]]
            if x[-1] == y[-1]:
                common = len(set(x) & set(y))
                far.append(round(1 - s[at[a], at[b]], 12))
                steps.append(len(x) + len(y) - 2 * common)
    got = registry.QUERIES["distance_correlation"](spark, sf).collect()[0]
    assert got["n"] == len(far) > 1000 and abs(got["rho"] - np.corrcoef(ranks(far), ranks(steps))[0, 1]) < 1e-5


def test_blocks_meet_in_many_partitions(spark, sf, places, monkeypatch):
    """Blocks find each other where adaptive execution doesn't pack them into one partition."""
    monkeypatch.setattr(analytics, "BLOCK", 60)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        _, names, at, s, up = places
        got = registry.QUERIES["containment_rate"](spark, sf).collect()[0]
        assert got["pairs"] == sum(len(up[n]) for n in names)
        vectors = spark.createDataFrame([(i, np.cos(np.arange(6) * (i + 1)).tolist()) for i in range(200)], "id int, vector array<double>")
        assert analytics.top_neighbours(vectors, 3).count() == 600
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("clusters", [True, False])
def test_neighbours_in_balls(spark, monkeypatch, clusters):
    """Many blocks give what one gives; balls that can't hold a nearer neighbour don't meet."""
    monkeypatch.setattr(analytics, "BLOCK", 40)
    seen = []
    may_hold = analytics.may_hold
    monkeypatch.setattr(analytics, "may_hold", lambda *a: seen.append(may_hold(*a)) or seen[-1])
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(20, 16))
    v = np.array([middle[i % 20] + 0.02 * rng.normal(size=16) for i in range(400)]) if clusters else rng.normal(size=(400, 16))
    v[7] = v[27]  # a tie
    v[399] = 0
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(900, None)], "id long, vector array<double>")
    got = {}
    for r in analytics.top_neighbours(rows, 4).collect():
        got.setdefault(r["id"], []).append((-round(r["similarity"], 12), r["other"]))
    size = np.linalg.norm(v, axis=1, keepdims=True)
    u = v / np.where(size == 0, 1, size)
    s = u @ u.T
    assert len(got) == 400 and seen
    for i in range(400):
        want = sorted((-round(s[i, j], 12), j) for j in range(400) if j != i)[:4]
        assert [j for _, j in sorted(got[i])] == [j for _, j in want] or np.allclose([x for x, _ in sorted(got[i])], [x for x, _ in want], atol=1e-9)
    skipped = 1 - seen[0].mean()
    assert skipped > 0.5 if clusters else skipped < 0.5


def test_neighbours_in_lots_have_few_copies(spark, monkeypatch):
    """Rows go to lots, whose number doesn't grow with that of the blocks; copies, ties and repeated ids are as in one block."""
    rng = np.random.default_rng(9)
    v = rng.normal(size=(600, 8))
    v[100:300] = v[100]  # more copies than neighbours are asked for
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(5, v[7].tolist())], "id long, vector array<double>")
    want = sorted((r["id"], r["other"], round(r["similarity"], 9)) for r in analytics.top_neighbours(rows, 5).collect())
    monkeypatch.setattr(analytics, "BLOCK", 20)
    met = analytics.nearest_across
    count = spark.sparkContext.accumulator(0)

    def counted(*a):
        meet = met(*a)

        def of(f):
            count.add(len(f))
            return meet(f)

        return of

    monkeypatch.setattr(analytics, "nearest_across", counted)
    assert sorted((r["id"], r["other"], round(r["similarity"], 9)) for r in analytics.top_neighbours(rows, 5).collect()) == want
    assert 0 < count.value <= (analytics.LOTS - 1) * 601


@pytest.mark.parametrize("block", [1024, 7])
def test_correlation_makes_no_pair_a_row(spark, sf, places, monkeypatch, block):
    """Ranges of distances are packed: rows written are few, and ranks with ties in many ranges are as over all pairs."""
    monkeypatch.setattr(analytics, "BLOCK", block)
    monkeypatch.setattr(analytics, "RANGE", 500, raising=False)
    kept = []
    monkeypatch.setattr(analytics, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    parent, names, at, _, up = places
    v = {n: np.round(np.cos(np.arange(4) * (i % 40 + 1)), 3) for i, n in enumerate(names)}  # a vector for each dozen of places
    m = np.array([v[n] / np.linalg.norm(v[n]) for n in names])
    s = m @ m.T
    far, steps = [], []
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            x, y = [a, *up[a]], [b, *up[b]]
            if x[-1] == y[-1]:
                far.append(round(1 - s[at[a], at[b]], 12))
                steps.append(len(x) + len(y) - 2 * len(set(x) & set(y)))
    tree = spark.createDataFrame([(n, p) for n, p in parent.items()], "node string, parent string")
    vectors = spark.createDataFrame([(n, x.tolist()) for n, x in v.items()], "node string, vector array<double>")
    got = analytics.distance_correlation(tree, vectors).collect()[0]
    assert got["n"] == len(far) > 1000 and abs(got["rho"] - np.corrcoef(ranks(far), ranks(steps))[0, 1]) < 1e-9
    assert max(df.count() for df in kept) < len(far) / 2
    none = analytics.distance_correlation(tree, vectors.limit(0)).collect()[0]
    assert tuple(none) == (0.0, 0)


def test_correlation_by_bins_is_bounded(spark, sf, places, monkeypatch):
    """Bins keep no distance; what they say holds rho, is taken only if it decides the digits asked for, and is refined or ranked else."""
    tree, vectors = registry.place_vectors(spark, sf)
    want = analytics.ranked_correlation(tree, vectors).collect()[0]
    monkeypatch.setattr(analytics, "PAIRS", 0)
    monkeypatch.setattr(analytics, "COUNTED", 1 << 12)
    monkeypatch.setattr(analytics, "CELLS", 512)
    monkeypatch.setattr(analytics, "SPAN", 1 << 8)
    monkeypatch.setattr(analytics, "BLOCK", 70)
    monkeypatch.setattr(analytics, "FAR_STRETCH", 100)
    wide = []
    for parts in (1, 3):
        low, high, n = analytics.bounded_correlation(tree, vectors, parts)
        assert n == want["n"] and low <= want["rho"] <= high
        wide.append(high - low)
    assert wide[1] < wide[0]
    ranked = analytics.ranked_correlation
    called = []
    monkeypatch.setattr(analytics, "ranked_correlation", lambda *a: called.append(1) or ranked(*a))
    got = analytics.distance_correlation(tree, vectors, digits=2).collect()[0]
    assert got["n"] == want["n"] and round(got["rho"], 2) == round(want["rho"], 2) and not called
    got = analytics.distance_correlation(tree, vectors, digits=11).collect()[0]
    assert abs(got["rho"] - want["rho"]) < 1e-11 and called
