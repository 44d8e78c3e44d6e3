"""Line dedup, MinHash near-duplicates, nearest neighbours."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import ann, cluster, common, line_dedup, minhash
from loomgraph.llm.registry import QUERIES


def within(a, b, k):
    if abs(len(a) - len(b)) > k:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1] <= k


class Union(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def link(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def edited(text, n):
    out = list(text)
    for _ in range(n):
        i, kind = random.randrange(len(out) + 1), random.random()
        if kind < 0.33:
            out.insert(i, random.choice("abcé 🙂"))
        elif i < len(out) and kind < 0.66:
            del out[i]
        elif i < len(out):
            out[i] = random.choice("abcdeé")
    return "".join(out)


@pytest.mark.parametrize("edits", [1, 2])
def test_bit_parallel_edit_distance(spark, edits):
    random.seed(edits)
    pairs = []
    for _ in range(300):
        a = "".join(random.choices("abcé", k=random.choice([0, 1, 5, 16, 33, 70, 130])))
        pairs.append((a, edited(a, random.randrange(edits + 3))))
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", line_dedup.within_edits(F.col("a"), F.col("b"), edits).alias("near")).collect():
        assert r["near"] == within(r["a"], r["b"], edits), r


def brute_lines(docs, edits=line_dedup.EDITS, edit_chars=line_dedup.EDIT_CHARS, least_chars=line_dedup.LEAST_CHARS):
    texts = sorted({d for d in docs if None not in d})
    lines = sorted({x for _, t in texts for x in t.split("\n") if len(x.strip(" ")) >= least_chars}, key=lambda x: (len(x), x))
    known, groups = set(lines), Union()
    for i, a in enumerate(lines):
        for b in lines[i + 1 :]:
            if len(b) - len(a) > edits:
                break
            if len(a) >= edit_chars and groups.find(a) != groups.find(b) and within(a, b, edits):
                groups.link(a, b)
    seen, out = set(), {}
    for d, t in texts:
        kept = []
        for x in t.split("\n"):
            if x in known:
                if groups.find(x) in seen:
                    continue
                seen.add(groups.find(x))
            kept.append(x)
        out[d, t] = ("\n".join(kept), t.count("\n") + 1 - len(kept))
    return collections.Counter((d, *out[d, t]) if (d, t) in out else (d, t, 0) for d, t in docs)


@pytest.mark.parametrize("seed", range(2))
def test_lines_against_brute_force(spark, seed):
    random.seed(seed)
    pool = ["".join(random.choices("abcdefé ", k=random.choice([5, 9, 12, 23, 24, 25, 26, 40, 70, 130]))) for _ in range(30)]
    docs = []
    for k in range(80):
        own = [edited(x, random.randrange(4)) if random.random() < 0.6 else x for x in random.choices(pool, k=random.randrange(7))]
        docs.append((k, "\n".join(random.choice([x, x, "", "short"]) for x in own)))
    docs += [docs[3], (None, pool[-1] + "\n" + pool[-1]), (500, None), (501, ""), (502, "\n\n\n"), (503, "word " * 15_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumn("n_lines", F.lit("x")).withColumn("line", F.lit(1)).withColumn("root", F.lit(2))
    out = line_dedup.dedup_lines(df)
    assert {"line", "root"} <= set(out.columns)
    assert collections.Counter((r["doc_id"], r["text"], r["n_dropped"]) for r in out.collect()) == brute_lines(docs)


@pytest.mark.parametrize("edits", [0, 1, 3])
def test_lines_of_any_length(spark, monkeypatch, edits):
    """With bounds of 0 every line is compared, the shortest and empty ones too; large numbers of lines and classes are joined by shuffles."""
    monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(common, "FEW", 0)
    monkeypatch.setattr(common, "HOT", 4)
    random.seed(edits)
    pool = ["".join(random.choices("abcé ", k=random.choice([1, 2, 6, 9, 14, 40]))) for _ in range(14)]
    docs = [(k, "\n".join(edited(x, random.randrange(edits + 2)) for x in random.choices(pool, k=random.randrange(5)))) for k in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = line_dedup.dedup_lines(df, edits=edits, edit_chars=0, least_chars=0).collect()
    assert collections.Counter((r["doc_id"], r["text"], r["n_dropped"]) for r in got) == brute_lines(docs, edits, 0, 0)
    assert all(r["n_lines"] == t.count("\n") + 1 for (_, t), r in zip(docs, sorted(got, key=lambda r: r["doc_id"]), strict=True))


def test_line_columns_that_clash(spark):
    df = spark.createDataFrame([(1, "a line of some length\nb", 7, 8, "x", 9)], "doc_id long, text string, __hash long, doc int, `N_Lines` string, gone int")
    rows = line_dedup.dedup_lines(df)
    assert rows.columns == ["doc_id", "text", "__hash", "doc", "gone", "n_lines", "n_dropped"]
    assert [tuple(r) for r in rows.collect()] == [(1, "a line of some length\nb", 7, 8, 9, 2, 0)]


def test_no_lines(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.dedup_lines(none).count() == 0


def test_line_query(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = QUERIES["op2_line_dedup"](spark, sf).collect()
    assert len(rows) == len(docs) and sum(r["n_dropped"] for r in rows) > 0
    kept = [x for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect() for x in r["text"].split("\n") if len(x.strip(" ")) >= line_dedup.LEAST_CHARS]
    assert len(kept) == len(set(kept))


def test_classes_of_one_large_group(spark, monkeypatch):
    monkeypatch.setattr(cluster, "BLOCK", 4)
    links = {(a, b) for a in range(60) for b in range(a + 1, 60) if (b - a) in (7, 14)}
    members = spark.createDataFrame([("k", n) for n in range(60)] + [("lone", 99)], "key string, node long")
    values = members.select("node", F.col("node").alias("value"))
    got = cluster.classes(members, values, lambda a, b: F.abs(a - b) % 7 == 0, lambda a, b: F.abs(a - b).isin(7, 14))
    groups = Union()
    for a, b in links:
        groups.link(a, b)
    assert {r["node"]: r["root"] for r in got.collect()} == {n: groups.find(n) for n in range(60)}


@pytest.mark.parametrize("same", [False, True])
def test_blocks_give_a_spanning_forest(spark, same):
    """Neither a pair that isn't a link nor a link between nodes that are joined already is in what two blocks give."""
    rng = random.Random(3)
    xs = list(range(24))
    ys = xs if same else list(range(24, 48))
    root = {n: n if n % 5 else 0 for n in {*xs, *ys}}
    for share in (1, 0.06, 0):
        links = {(a, b) for a in xs for b in ys if a < b and rng.random() < share}
        side = lambda nodes: [(n, root[n]) for n in nodes]
        df = spark.createDataFrame([(side(xs), side(ys), [a * 100 + b for a, b in links])], "xs array<struct<node: long, root: long>>, ys array<struct<node: long, root: long>>, links array<long>")
        linked = lambda x, y: (x["node"] < y["node"]) & F.array_contains("links", x["node"] * 100 + y["node"])
        got = [(r["a"], r["b"]) for r in df.select(F.inline(cluster.spanning(F.col("xs"), F.col("ys"), linked))).collect()]
        want, found = Union(), Union()
        for groups, pairs in ((want, links), (found, got)):
            for n in root:
                groups.link(n, root[n])
            for a, b in pairs:
                groups.link(a, b)
        assert set(got) <= links and len(got) < len({root[n] for n in {*xs, *ys}})
        assert [found.find(n) for n in root] == [want.find(n) for n in root]


def test_components_of_a_long_chain(spark):
    order = random.Random(1).sample(range(200), 200)
    links = spark.createDataFrame([(min(a, b), max(a, b)) for a, b in zip(order, order[1:], strict=False)], "a long, b long")
    assert {r["root"] for r in cluster.components(links).collect()} == {0}


def sets_of(text, words):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()


def brute_duplicates(docs, words, percent):
    sets, groups = {d: sets_of(t, words) for d, t in docs if d is not None}, Union()
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                groups.link(a, b)
    return {d: (len(sets[d]), groups.find(d)) for d in ids}


def test_near_duplicates_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", 3)
    monkeypatch.setattr(minhash, "BLOCK", 5)
    random.seed(7)
    vocabulary = [f"w{i}" for i in range(300)]
    docs = []
    for g in range(12):
        base = random.choices(vocabulary, k=random.choice([3, 8, 60, 150]))
        for _ in range(random.choice([1, 2, 5, 25])):
            w = list(base)
            for _ in range(random.choice([0, 0, 1, 2, 4])):
                w[random.randrange(len(w))] = random.choice(vocabulary)
            docs.append((len(docs) * 3 + g, " ".join(w).upper() if random.random() < 0.1 else "  ".join(w)))
    docs += [(9001, ""), (9002, None), (9003, " \n"), (9004, "x " * 30_000), (9005, "X\t" * 29_999)]
    df = spark.createDataFrame([*docs, docs[0], (None, docs[0][1])], "doc_id long, text string").withColumn("node", F.lit(1)).repartition(3)
    rows = minhash.near_duplicates(df, words=4).collect()
    want = brute_duplicates(docs, 4, 80)
    assert len(rows) == len(docs) + 2
    for r in rows:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["component_id"] == r["doc_id"])
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_duplicate_query(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op10_minhash_dedup"](spark, sf).collect()}
    assert got == brute_duplicates(docs, 4, 80)


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(1)
    for n in (1, 3, 50, 2000):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate([a[: math.ceil(0.8 * n)], rng.integers(0, 2**63, n - math.ceil(0.8 * n)).astype(np.uint64)])
        flat = np.concatenate([np.sort(a), np.sort(b)])
        s = minhash.sketch(flat, np.array([0, n, 2 * n]))
        assert (s != np.uint64(2**64 - 1)).all()
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((s[0] == s[1]).mean() - true) < 0.2


def brute_nearest(rows, n=5):
    ids = np.array([i for i, _ in rows])
    m = np.array([v for _, v in rows], float)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    out = {}
    for q in sorted(set(ids[ids % 50 == 0])):
        s = np.round(unit @ unit[np.flatnonzero(ids == q)[0]], 12)
        order = [k for k in np.lexsort((ids, -s)) if ids[k] != q][:n]
        out[int(q)] = [int(ids[k]) for k in order]
    return out


def test_neighbours_with_ties_and_unusable_rows(spark):
    random.seed(3)
    rows = [(i, [float(random.randrange(-3, 4)) for _ in range(6)]) for i in range(300)]
    rows = [(i, v if any(v) else [1.0] * 6) for i, v in rows] + [(1000 + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(0, 200, 10)]
    bad = [(50_000, None), (50_050, [0.0] * 6), (50_100, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (50_150, [float("nan")] * 6), (50_200, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0]), (50_250, [1.0]), (50_300, []), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("cell", F.lit(1))
    got = {}
    for r in ann.search(df, F.col("vec_id") % 50 == 0, candidates=10**6).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == brute_nearest(rows)
    few = ann.search(df.where("vec_id IN (50, 1, 2)"), F.col("vec_id") % 50 == 0).collect()
    assert len(few) == 2
    assert ann.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_neighbour_query_reaches_its_recall(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    found = {}
    for r in QUERIES["op8_ann_search"](spark, sf).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = brute_nearest(rows)
    assert sum(len(found[q] & set(v)) for q, v in want.items()) >= 0.9 * sum(map(len, want.values()))


def test_large_cells_are_split(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 16)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)]
    got = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, candidates=10**6).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == brute_nearest(rows)


def test_neighbours_behind_a_repeated_id(spark):
    rows = [(0, [1.0, 2.0])] * 9 + [(i, [1.0, 2.0]) for i in (3, 4)] + [(7, [2.0, 1.0])] * 4
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["rank"], r["vec_id"]) for r in ann.search(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(1, 3), (2, 4), (3, 7), (4, 7), (5, 7)]
    got = [r["vec_id"] for r in ann.search(df, F.col("vec_id") == 3).orderBy("rank").collect()]
    assert got == [0] * 5


def clustered(n, dim, centres, seed, spread=0.25):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim))
    return [(i, (middle[rng.integers(centres)] + spread * rng.normal(size=dim)).tolist()) for i in range(n)]


def test_clustered_vectors_are_found_in_a_few_cells(spark):
    """A real index: most vectors are never read, and recall holds on queries that tuning hasn't seen."""
    rows = clustered(6000, 16, 60, 5)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = F.col("vec_id") % 50 == 0
    got = ann.quality(df, asked)
    assert got["share_read"] < 1 / 3 and got["recall"] >= 0.9
    found = {}
    for r in ann.search(df, asked).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = brute_nearest(rows)
    hit = sum(len(found[q] & set(v)) for q, v in want.items()) / sum(map(len, want.values()))
    assert set(found) == set(want) and 0.9 <= hit
    few = {}
    for r in ann.search(df, asked, candidates=1).collect():
        few.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert sum(len(few.get(q, set()) & set(v)) for q, v in want.items()) < sum(map(len, want.values()))  # the walk is what finds them


def test_scores_of_very_large_and_small_components(spark):
    base = [(i, [float(1 + (i * 7 + j * 3) % 11) for j in range(4)]) for i in range(60)]
    scale = {i: random.Random(i).choice([1e200, 1e-200, 1.0, 2.0**-1060]) for i, _ in base}
    rows = [(i, [x * scale[i] for x in v]) for i, v in base]
    search = lambda r: {(x["query_id"], x["rank"]): x for x in ann.search(spark.createDataFrame(r, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, candidates=10**6).collect()}
    got, want = search(rows), search(base)
    assert got.keys() == want.keys() and len(got) == 10
    for k in got:
        assert got[k]["score"] == pytest.approx(want[k]["score"], rel=1e-3)


@pytest.mark.parametrize("small", [False, True])
def test_rows_of_a_search_are_bounded_by_lots(spark, monkeypatch, small):
    """A query makes a row for each lot and neighbour, not for each of its many cells; small lots are met in several goes."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(ann, "PER_CELL", 4)
    monkeypatch.setattr(ann, "LOTS", 3)
    if small:
        monkeypatch.setattr(ann, "LOT_BYTES", 8 * 8 * 20)
        monkeypatch.setattr(ann, "SCORES", 100)
    index, asked = ann.Index(df), F.col("vec_id") % 50 == 0
    assert (index.counts > 0).sum() > 300
    rows = ann.nearest_by_lot(index, asked, 10**6).collect()
    assert small or len(rows) == 60 * 3 * 5
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 3000, 50):
        near = unit @ unit[q]
        near[q] = -2
        got = sorted((r for r in rows if r["query_id"] == q), key=lambda r: (-r["score"], r["vec_id"]))[:5]
        assert [r["vec_id"] for r in got] == np.argsort(-near, kind="stable")[:5].tolist()
