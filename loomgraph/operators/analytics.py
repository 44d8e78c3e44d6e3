"""Analytics over embeddings, traces and layouts."""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import cut, lack, one_per, running
from ..functions.text import cosine
from .tree_order import RangeMinimum, intervals

#: Vectors that a similarity block holds at most on either side.
BLOCK = 1024


def unit(x: pd.Series) -> np.ndarray:
    """Rows of length 1; those without length stay 0."""
    m = np.array(x.tolist(), float)
    n = np.sqrt((m * m).sum(1, keepdims=True))
    return m / np.where(n == 0, 1, n)


def in_arrow(meet, schema: pa.Schema):
    """``meet`` of two pandas blocks for ``applyInArrow``: results without rows keep their types."""
    return lambda a, b: pa.Table.from_pandas(meet(a.to_pandas(), b.to_pandas()), schema=schema, preserve_index=False)


#: Blocks up to which all meet, balls that vectors are dealt into at most, and what angles may be off by.
FEW_BLOCKS, BALLS, SLACK = 8, 1024, 1e-6


def nearest_in(k: int):
    """``meet`` of two blocks (lid, lv) and (rid, rv): the k most similar others of each left row."""

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "other": [], "similarity": []})
        b = b.sort_values("rid")
        aid, bid = a["lid"].to_numpy(), b["rid"].to_numpy()
        s = unit(a["lv"]) @ unit(b["rv"]).T
        rank = np.round(s, 12)
        rank[aid[:, None] == bid[None, :]] = -np.inf
        if len(bid) > k:  # all that reach the k-th value, ties included, then the smallest ids of these
            rank[rank < -np.partition(-rank, k - 1, axis=1)[:, k - 1 : k]] = -np.inf
        row, column = np.nonzero(rank > -np.inf)
        order = np.lexsort((column, -rank[row, column], row))
        row, column = row[order], column[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        row, column = row[nth < k], column[nth < k]
        return pd.DataFrame({"id": aid[row], "other": bid[column], "similarity": s[row, column]})

    return meet


def blocks_meet(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """(id, other, similarity) of blocks (i, li, lj, lid, lv) and (j, ri, rj, rid, rv) with the same numbers."""
    kind = left.schema["lid"].dataType.simpleString()
    return left.groupBy("li", "lj").cogroup(right.groupBy("ri", "rj")).applyInPandas(nearest_in(k), f"id {kind}, other {kind}, similarity double")


def best_of(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("id").orderBy(F.round("similarity", 12).desc(), "other")
    return found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k).drop("nth")


def balls_of(rows: DataFrame, n_balls: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """``rows`` (id, v) with ``ball``, the most similar of ``n_balls`` rows picked by hash; the angles between the balls' middles, and
    each ball's largest angle to its middle."""
    middles = unit(pd.Series([r["v"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(n_balls).collect()]))  # n_balls rows at most
    schema = f"id {rows.schema['id'].dataType.simpleString()}, v array<double>, ball int, near double"

    def deal(frames):
        for frame in frames:
            s = unit(frame["v"]) @ middles.T
            ball = s.argmax(1)
            yield frame.assign(ball=ball, near=s[np.arange(len(s)), ball])

    dealt = cut(rows.mapInPandas(deal, schema))
    wide = np.zeros(len(middles))
    for r in dealt.groupBy("ball").agg(F.min("near").alias("near")).collect():
        wide[r["ball"]] = np.arccos(np.clip(r["near"], -1, 1))
    return dealt, np.arccos(np.clip(middles @ middles.T, -1, 1)), wide


def may_hold(apart: np.ndarray, wide: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Whether a row of ball i may have one of ball j among its nearest: the smallest angle that the balls allow, against the ball's
    least similarity of a k-th neighbour."""
    return np.cos(np.maximum(0, apart - wide[:, None] - wide[None] - SLACK)) + SLACK >= least[:, None]


class Best:
    """The ``k`` most similar others of rows, by block after block; rows are sorted by ``ids``, so of equal ones the first count. Those
    below ``kth``, what a row is known to have, don't matter."""

    MOST = 1 << 20

    def __init__(self, ids: np.ndarray, k: int, kth: np.ndarray) -> None:
        self.ids, self.k, self.kth, self.last = ids, k, kth.astype(float), np.full(len(ids), len(ids))
        self.found, self.waiting = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))], 0

    def add(self, rows: np.ndarray, others: np.ndarray, s: np.ndarray) -> None:
        hit = s >= self.kth[rows][:, None] - 1e-12
        if np.count_nonzero(hit) > 4 * self.k * len(rows) and len(others) > self.k:
            s = np.where(self.ids[rows][:, None] == self.ids[others], -np.inf, s)
            hit &= s >= -np.partition(-s, self.k - 1, axis=1)[:, self.k - 1 : self.k] - 1e-12
        i, j = np.divmod(np.flatnonzero(hit), len(others))
        s, row, other = s[i, j], rows[i], others[j]
        rank = np.round(s, 12)
        good = ((rank > self.kth[row]) | (rank == self.kth[row]) & (other < self.last[row])) & (self.ids[row] != self.ids[other])
        self.found.append((row[good], other[good], s[good]))
        self.waiting += int(good.sum())
        if self.waiting > self.MOST:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, other, s = (np.concatenate(x) for x in zip(*self.found, strict=True))
        rank = np.round(s, 12)
        order = np.lexsort((other, -rank, row))
        order = order[np.arange(len(row)) - np.searchsorted(row[order], row[order]) < self.k]
        row, other, s, rank = row[order], other[order], s[order], rank[order]
        full = np.flatnonzero(np.arange(len(row)) - np.searchsorted(row, row) == self.k - 1)
        self.kth[row[full]], self.last[row[full]] = rank[full], other[full]
        self.found, self.waiting = [(row, other, s)], 0
        return self.found[0]

    def frame(self) -> pd.DataFrame:
        row, other, s = self.settle()
        return pd.DataFrame({"id": self.ids[row], "other": self.ids[other], "similarity": s})


def tiles(at: np.ndarray, size: int) -> list[np.ndarray]:
    return [at[i : i + size] for i in range(0, len(at), size)]


def nearest_of_lot(k: int, apart: np.ndarray, wide: np.ndarray, block: int):
    """The k most similar others of each row (id, v, ball) inside its lot: first inside its ball, then in balls that may hold one."""

    def meet(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("id")
        u, ball = unit(f["v"]), f["ball"].to_numpy()
        best, held = Best(f["id"].to_numpy(), k, np.full(len(f), -np.inf)), {int(i): tiles(np.flatnonzero(ball == i), block) for i in np.unique(ball)}
        for own in held.values():
            for x in own:
                for y in own:
                    best.add(x, y, u[x] @ u[y].T)
        best.settle()
        for i, left in held.items():
            for j, right in held.items():
                bound = np.cos(max(0, apart[i, j] - wide[i] - wide[j] - SLACK)) + SLACK
                for x, y in ((x, y) for x in left for y in right if i < j):
                    there, back = bound >= best.kth[x].min(), bound >= best.kth[y].min()
                    if there or back:
                        s = u[x] @ u[y].T
                        if there:
                            best.add(x, y, s)
                        if back:
                            best.add(y, x, s.T)
        return best.frame()

    return meet


def nearest_across(k: int, need: np.ndarray, block: int):
    """What rows (id, v, ball, lot, kth) of two lots find in the other one, where their balls ``need`` to meet, of at least their kth."""

    def meet(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("id")
        u, ball, lot = unit(f["v"]), f["ball"].to_numpy(), f["lot"].to_numpy()
        best = Best(f["id"].to_numpy(), k, f["kth"].to_numpy())
        left, right = ({int(i): tiles(np.flatnonzero((ball == i) & (lot == side)), block) for i in np.unique(ball[lot == side])} for side in (lot.min(), lot.max()))
        for i, xs in left.items() if lot.min() < lot.max() else ():
            for j, ys in right.items():
                for x, y in ((x, y) for x in xs for y in ys if need[i, j] or need[j, i]):
                    s = u[x] @ u[y].T
                    if need[i, j]:
                        best.add(x, y, s)
                    if need[j, i]:
                        best.add(y, x, s.T)
        return best.frame()

    return meet


#: Bytes of vectors that a lot has at most, and lots at least.
HELD, LOTS = 32 << 20, 8


def top_neighbours(vectors: DataFrame, k: int, id: str = "id", vector: str = "vector") -> DataFrame:
    """(id, other, similarity): the k most similar other rows by cosine in double precision; ties to the smaller id.

    Exact, and no pair becomes a row. More than ``FEW_BLOCKS`` blocks of rows are dealt into balls around some of them, and balls
    into lots of ``HELD`` bytes, so that a row has as many copies as there are lots and not as there are blocks. A lot's rows first meet each other,
    which bounds what a k-th neighbour has; then two lots meet in the balls that by their distance and size may hold something as near.
    Vectors without any clusters meet all, as they must, in tiles of ``BLOCK``.
    """
    rows = cut(vectors.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL"))
    n = rows.count()
    parts = max(1, -(-n // BLOCK))
    if parts <= FEW_BLOCKS:
        # both sides' numbers have one type, as they are hashed
        lot, every = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
        left = rows.select(F.col("id").alias("lid"), F.col("v").alias("lv"), lot.alias("li"), every.alias("lj"))
        return best_of(blocks_meet(left, rows.select(F.col("id").alias("rid"), F.col("v").alias("rv"), lot.alias("rj"), every.alias("ri")), k), k)
    rows, apart, wide = balls_of(rows, min(BALLS, max(2, 2 * n // BLOCK)))
    sizes = np.zeros(len(wide), int)
    for r in rows.groupBy("ball").count().collect():
        sizes[r["ball"]] = r["count"]
    # balls lie one after the other, like ones together; each has the lots that its stretch touches
    n_lots = max(LOTS, -(-n * 8 * rows.select(F.max(F.size("v"))).first()[0] // HELD))
    order = np.lexsort((apart[0], apart[int(apart[0].argmax())]))
    begin = np.zeros(len(sizes), int)
    begin[order] = np.cumsum(sizes[order]) - sizes[order]
    first, last = begin * n_lots // n, (begin + np.maximum(sizes, 1) - 1) * n_lots // n
    spark, kind = vectors.sparkSession, rows.schema["id"].dataType.simpleString()
    where = spark.createDataFrame([(i, int(a), int(b - a + 1)) for i, (a, b) in enumerate(zip(first, last, strict=True))], "ball int, first int, lots int")
    rows = rows.join(F.broadcast(where), "ball").select("id", "v", "ball", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("lots"))).cast("int").alias("lot"))
    found = f"id {kind}, other {kind}, similarity double"
    # as many partitions as lots: they are few and take long, so they aren't packed together
    same = cut(rows.repartition(n_lots, "lot").groupBy("lot").applyInPandas(nearest_of_lot(k, apart, wide, BLOCK), found))
    kth = same.groupBy("id").agg(F.when(F.count("*") >= k, F.min(F.round("similarity", 12))).alias("kth"))
    rows = cut(rows.join(kth, "id", "left").withColumn("kth", F.coalesce("kth", F.lit(-2.0))))
    least = np.full(len(wide), -2.0)
    for r in rows.groupBy("ball").agg(F.min("kth").alias("least")).collect():
        least[r["ball"]] = r["least"]
    held = (sizes > 0)[:, None] & (sizes > 0)[None]
    need = (may_hold(apart, wide, least) | np.eye(len(wide), dtype=bool)) & held
    sits = np.zeros((len(wide), n_lots), int)
    for i, (a, b) in enumerate(zip(first, last, strict=True)):
        sits[i, a : b + 1] = sizes[i] > 0
    meets = sits.T @ (need | need.T).astype(int) @ sits > 0
    to = spark.createDataFrame([(a, [[min(a, int(b)), max(a, int(b))] for b in np.flatnonzero(row) if b != a]) for a, row in enumerate(meets)], "lot int, pairs array<array<int>>")
    both = rows.join(F.broadcast(to), "lot").select("id", "v", "ball", "lot", "kth", F.explode("pairs").alias("pair"))
    across = both.repartition(max(1, int(np.triu(meets, 1).sum())), "pair").groupBy("pair").applyInPandas(nearest_across(k, need, BLOCK), found)
    return best_of(same.unionByName(across), k)


def minmax(column: str, constant: float) -> object:
    """(value - min) / (max - min) over all rows as an expression over the columns __lo and __hi."""
    return F.when(F.col("__hi") > F.col("__lo"), (F.col(column) - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).otherwise(F.lit(constant))


def with_range(df: DataFrame, column: str) -> DataFrame:
    """Adds __lo and __hi, a one-row aggregate that is broadcast."""
    return df.crossJoin(F.broadcast(df.agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"))))


def semantic_density(vectors: DataFrame, k: int = 10, id: str = "id", vector: str = "vector") -> DataFrame:
    """(id, density): mean cosine of the k nearest others, scaled to 0..1; 0.5 for a single row or if all are equal."""
    mean = top_neighbours(vectors, k, id, vector).groupBy("id").agg(F.avg("similarity").alias("mean"))
    every = vectors.select(F.col(id).alias("id")).join(mean, "id", "left")
    return with_range(every, "mean").select("id", F.coalesce(F.when(F.col("mean").isNotNull(), minmax("mean", 0.5)), F.lit(0.5)).alias("density"))


def importance(nodes: DataFrame) -> DataFrame:
    """(id, importance) from (id, density, source_lines): novelty times substance, over the largest product."""
    loc = with_range(nodes.withColumn("loc", F.log(F.col("source_lines") + 1)), "loc")
    span = F.when(F.col("__hi") > F.col("__lo"), F.col("__hi") - F.col("__lo")).otherwise(F.lit(1.0))
    raw = loc.select("id", (F.greatest(F.lit(0.0), 1 - F.col("density")) * (0.15 + 0.85 * (F.col("loc") - F.col("__lo")) / span)).alias("raw"))
    top = raw.agg(F.max("raw").alias("top"))
    return raw.crossJoin(F.broadcast(top)).select("id", (F.col("raw") / F.when(F.col("top") > 0, F.col("top")).otherwise(F.lit(1.0))).alias("importance"))


def relative_heights(tree: DataFrame) -> DataFrame:
    """(node, height) of a forest (node, parent, x, y, importance, is_orphan).

    Each step down falls by tan(60 - 50 * importance degrees) times its length in the plane; roots fall from the origin. All
    is shifted so that the lowest is 0; orphans lie 0.1 above.
    """
    real = cut(tree.where("NOT is_orphan"))
    near = real.where("parent IS NULL").select("node", "x", "y", (-F.tan(F.radians(60 - 50 * F.col("importance"))) * F.hypot("x", "y")).alias("h"))
    near = known = cut(near)
    while True:
        up = near.select(F.col("node").alias("parent"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("h").alias("ph"))
        fall = F.tan(F.radians(60 - 50 * F.col("importance"))) * F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py"))
        near = cut(real.join(up, "parent").select("node", "x", "y", (F.col("ph") - fall).alias("h")))
        if near.isEmpty():
            break
        known = cut(known.unionByName(near))
    low = F.broadcast(known.agg(F.min("h").alias("low")))
    out = known.crossJoin(low).select("node", (F.col("h") - F.col("low")).alias("height"))
    return out.unionByName(tree.where("is_orphan").select("node", F.lit(0.1).alias("height")))


def spearman(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(rho, n) with average ranks for ties; 0 without variance. Ranks come from counts per value, so one value may be any
    share of the rows; only distinct values are put in one order."""
    def ranked(c: str, name: str) -> DataFrame:
        counts = pairs.groupBy(F.col(c).alias(name)).agg(F.count("*").alias("n"))
        below = running(counts, name, "n")
        counts, below = below, F.col("below")
        return counts.select(name, (below + (F.col("n") + 1) / 2.0).alias(f"r_{name}"))

    rows = pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).join(ranked(a, "a"), "a").join(ranked(b, "b"), "b")
    # sums of centred ranks, since the built-in correlation fails on columns without variance
    middle = F.broadcast(rows.agg(F.avg("r_a").alias("ma"), F.avg("r_b").alias("mb")))
    c = rows.crossJoin(middle).select((F.col("r_a") - F.col("ma")).alias("x"), (F.col("r_b") - F.col("mb")).alias("y"))
    sums = c.agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") ** 2).alias("xx"), F.sum(F.col("y") ** 2).alias("yy"), F.count("*").alias("n"))
    return sums.select(F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))).otherwise(F.lit(0.0)).alias("rho"), "n")


def containment(tree: DataFrame, vectors: DataFrame) -> DataFrame:
    """(pairs, passed, rate) of a forest: a pair of ancestor and descendant passes if it is more similar than the ancestor and any
    unrelated node; ancestors without unrelated nodes are left out.

    Nodes carry their intervals of a preorder, so who is whose ancestor is two comparisons inside a block; no pair and no set of
    ancestors is ever a row. Every ancestor meets every vector once, for the nearest unrelated one, and those in its own
    interval a second time.
    """
    places = intervals(tree.select("node", "parent"))
    rows = vectors.select("node", F.col("vector").cast("array<double>").alias("v")).where("v IS NOT NULL").join(places.select("node", "first", "last"), "node", "left")
    rows = cut(rows.select("node", "v", F.coalesce("first", F.lit(-1)).alias("first"), F.coalesce("last", F.lit(-2)).alias("last")))
    tops = cut(rows.where("last > first"))
    n_left, n_right = (max(1, -(-x.count() // BLOCK)) for x in (tops, rows))
    lot = lambda n: F.pmod(F.xxhash64("node"), F.lit(n)).cast("int")  # noqa: E731  of the type of the sequences, as both are hashed
    left = tops.select("node", "v", "first", "last", lot(n_left).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(n_right - 1))).alias("j"))
    right = rows.select("node", "v", "first", "last", lot(n_right).alias("j"), F.explode(F.sequence(F.lit(0), F.lit(n_left - 1))).alias("i"))

    def below(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
        at = b["first"].to_numpy()[None]
        return (at > a["first"].to_numpy()[:, None]) & (at <= a["last"].to_numpy()[:, None])

    def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"a": [], "bound": []})
        s = np.round(unit(a["v"]) @ unit(b["v"]).T, 12)
        s[below(a, b) | below(b, a).T | (a["node"].to_numpy()[:, None] == b["node"].to_numpy()[None])] = -np.inf
        best = s.max(1)
        return pd.DataFrame({"a": a["node"].astype(object), "bound": best})[best > -np.inf]

    bound = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(in_arrow(nearest, pa.schema([("a", pa.string()), ("bound", pa.float64())])), "a string, bound double").groupBy(F.col("a").alias("node")).agg(F.max("bound").alias("bound"))
    # now by stretches of the preorder: an ancestor goes to those that its interval meets
    stretch = lambda c: F.floor(F.col(c) / BLOCK)
    above = tops.join(bound, "node").select("node", "v", "first", "last", "bound", F.explode(F.sequence(stretch("first"), stretch("last"))).alias("j")).withColumn("i", lot(n_left))
    own = [F.col(c).alias(c) for c in ("node", "v", "first", "last")]  # columns of its own, as both sides come from the same rows
    inside = rows.where("first >= 0").select(*own, stretch("first").alias("j"), F.explode(F.sequence(F.lit(0), F.lit(n_left - 1))).alias("i"))

    def count(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"pairs": [], "passed": []})
        under = below(a, b)
        s = np.round(unit(a["v"]) @ unit(b["v"]).T, 12)
        return pd.DataFrame({"pairs": [int(under.sum())], "passed": [int((under & (s > a["bound"].to_numpy()[:, None])).sum())]})

    counted = above.groupBy("i", "j").cogroup(inside.groupBy("i", "j")).applyInArrow(in_arrow(count, pa.schema([("pairs", pa.int64()), ("passed", pa.int64())])), "pairs bigint, passed bigint")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("bigint")).alias(c)
    return counted.agg(total("pairs"), total("passed")).withColumn("rate", F.when(F.col("pairs") > 0, F.col("passed") / F.col("pairs")))


def split_distinctness(tree: DataFrame, vectors: DataFrame) -> DataFrame:
    """(parent, a, b, ok): siblings are less similar to each other than each is to the parent.

    A parent's children meet in blocks, so its pairs are rows only as results.
    """
    own = vectors.select("node", F.col("vector").cast("array<double>").alias("v")).where("v IS NOT NULL")
    rows = tree.where("parent IS NOT NULL").select("parent", "node").join(own, "node").join(own.select(F.col("node").alias("parent"), F.col("v").alias("p")), "parent")
    rows = cut(rows)
    parts = rows.groupBy("parent").agg(F.ceil(F.count("*") / BLOCK).alias("n"))
    rows = rows.join(parts, "parent").withColumn("lot", F.pmod(F.xxhash64("node"), F.col("n")))
    left = rows.select("parent", "node", "v", "p", F.col("lot").alias("i"), F.explode(F.sequence("lot", F.col("n") - 1)).alias("j"))
    right = rows.select(F.col("parent").alias("r_parent"), F.col("node").alias("r_node"), F.col("v").alias("r_v"), F.col("lot").alias("r_j"), F.explode(F.sequence(F.lit(0).cast("bigint"), "lot")).alias("r_i"))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"parent": [], "a": [], "b": [], "ok": []})
        ua, ub = unit(a["v"]), unit(b["r_v"])
        p = unit(a["p"].iloc[:1])[0]
        s = np.round(ua @ ub.T, 12)
        ok = (s < np.round(ua @ p, 12)[:, None]) & (s < np.round(ub @ p, 12)[None, :])
        na, nb = a["node"].to_numpy(object), b["r_node"].to_numpy(object)
        # within one block a pair is met from both sides
        x, y = np.nonzero(na[:, None] < nb[None, :] if a["i"].iloc[0] == a["j"].iloc[0] else np.ones_like(ok))
        first = na[x] < nb[y]
        names = {"parent": [a["parent"].iloc[0]] * len(x), "a": np.where(first, na[x], nb[y]), "b": np.where(first, nb[y], na[x])}
        return pd.DataFrame({c: pd.Series(n, dtype=object) for c, n in names.items()} | {"ok": ok[x, y]})

    return left.groupBy("parent", "i", "j").cogroup(right.groupBy("r_parent", "r_i", "r_j")).applyInArrow(in_arrow(meet, pa.schema([("parent", pa.string()), ("a", pa.string()), ("b", pa.string()), ("ok", pa.bool_())])), "parent string, a string, b string, ok boolean")


#: Nodes of a stretch at most, and pairs that are packed at once.
STRETCH, PACKED = 8192, 1 << 22


def in_floats(vectors: DataFrame) -> Column:
    """``vector`` in floats if that is how it comes, else in doubles."""
    kind = vectors.schema["vector"].dataType.simpleString()
    return F.col("vector").cast("array<float>" if kind == "array<float>" else "array<double>")


def tree_blocks(tree: DataFrame, vectors: DataFrame, stretch: int = STRETCH):
    """(left, right, meet): blocks (i, j) of nodes with vectors in preorder, and ``meet`` of two of them: (far, steps) of their pairs in one
    tree, 1 - cosine, rounded, and steps along the tree, tile by tile. Stretches with a border of trees between them don't meet.

    The lowest common ancestor of two nodes is as deep as the least parent between them in the preorder; a node carries the least parent
    ``since`` the node with a vector before it. Stretches meet as blocks: inside, minima run from either node to the border of its tile or
    stretch, and a sparse table has those of the stretches between. It holds a number for each stretch and level and goes to all tasks.
    """
    places = intervals(tree.select("node", "parent")).join(vectors.select("node", in_floats(vectors).alias("v")), "node", "left")
    places = running(places.select("first", "depth", "v", F.col("v").isNotNull().cast("bigint").alias("known")), "first", "known")
    places = cut(places.select(F.col("below").alias("k"), "depth", "v"))
    since = places.groupBy("k").agg(F.min(F.col("depth") - 1).alias("since"))
    rows = cut(places.where("v IS NOT NULL").join(since, "k"))
    n, wide = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    size = max(BLOCK, min(stretch, -(-n // LOTS), HELD // (8 * max(1, wide or 1))))
    rows = rows.withColumn("i", F.floor(F.col("k") / size))
    least = {r["i"]: r["m"] for r in rows.groupBy("i").agg(F.min("since").alias("m")).collect()}
    count = len(least)
    between = RangeMinimum([least[i] for i in range(count)])
    last = [0] * count  # the last stretch that a tree of stretch i can reach, and the first one whose trees can reach it
    for i in reversed(range(count)):
        last[i] = i if i + 1 == count else i + 1 if least[i + 1] < 0 else max(i + 1, last[i + 1])
    meets = F.broadcast(tree.sparkSession.createDataFrame([(i, next(x for x in range(i + 1) if last[x] >= i), j) for i, j in enumerate(last)], "i bigint, lo bigint, hi bigint"))
    rows = rows.join(meets, "i")
    left = rows.select("k", "depth", "since", "v", "i", F.explode(F.sequence("i", "hi")).alias("j"))
    right = rows.select(*(F.col(c).alias(c) for c in ("k", "depth", "since", "v")), F.col("i").alias("j"), F.explode(F.sequence("lo", "i")).alias("i"))
    block = BLOCK

    def meet(a: pd.DataFrame, b: pd.DataFrame):
        if not len(a) or not len(b):
            return
        i, j = int(a["i"].iloc[0]), int(a["j"].iloc[0])
        a, b = a.sort_values("k"), b.sort_values("k")
        (ua, da, sa), (ub, db, sb) = ((unit(f["v"]), f["depth"].to_numpy(), f["since"].to_numpy(np.int64)) for f in (a, b))
        none = np.array([np.iinfo(np.int64).max])
        after_all = lambda s: np.append(np.minimum.accumulate(s[::-1])[::-1][1:], none)  # noqa: E731  least beyond each, up to the last
        for x in range(0, len(a), block):
            p = slice(x, min(len(a), x + block))
            after, middle = (after_all(sa)[p], between.of(i + 1, j)) if i < j else (after_all(sa[p]), none[0])
            down = np.minimum.accumulate(sb if i < j else sb[p.stop :])
            for y in range(0 if i < j else x, len(b), block):
                q = slice(y, min(len(b), y + block))
                pairs = np.ones((p.stop - p.start, q.stop - q.start), bool)
                if i == j and x == y:
                    top = np.full(pairs.shape, none[0])
                    for t in range(len(top) - 1):
                        top[t, t + 1 :] = np.minimum.accumulate(sb[q][t + 1 :])
                    pairs = np.triu(pairs, 1)
                else:
                    top = np.minimum(np.minimum(after[:, None], (down[q] if i < j else down[q.start - p.stop : q.stop - p.stop])[None]), middle)
                pairs &= top >= 0
                yield np.round(1 - (ua[p] @ ub[q].T)[pairs], 12), (da[p][:, None] + db[q][None] - 2 * top)[pairs]

    return left, right, meet


def tree_distances(tree: DataFrame, vectors: DataFrame) -> DataFrame:
    """(far, steps) of every pair of nodes with vectors in one tree of a forest: a row for each pair, see ``tree_blocks``."""
    left, right, met = tree_blocks(tree, vectors)

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = list(met(a, b)) or [(np.zeros(0), np.zeros(0))]
        return pd.DataFrame({c: np.concatenate(x).astype(float) for c, x in zip(("far", "steps"), zip(*found, strict=True), strict=True)})

    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(in_arrow(meet, pa.schema([("far", pa.float64()), ("steps", pa.float64())])), "far double, steps double")


#: Pairs that a range of distances should have, ranges at most, vectors whose pairs say where ranges end, and the unit of distances.
RANGE, RANGES, SAID, UNIT = 1 << 21, 8192, 1024, 1e-12


def packed_ranges(found: list[tuple[np.ndarray, np.ndarray]], ends: np.ndarray) -> list[tuple]:
    """(range, steps, first value, bytes of a gap, gaps between values, their counts if one isn't 1) of distances and steps."""
    far, steps = (np.concatenate([np.zeros(0), *(f[c] for f in found)]) for c in (0, 1))
    out = []
    for step in np.unique(steps):
        value, times = np.unique(np.rint(far[steps == step] / UNIT).astype(np.int64), return_counts=True)
        at = np.searchsorted(ends, value, "right")
        for lot in np.unique(at):
            low, high = np.searchsorted(at, lot), np.searchsorted(at, lot, "right")
            gaps, t = np.diff(value[low:high]), times[low:high]
            kind = np.uint32 if not len(gaps) or gaps.max() < 1 << 32 else np.int64
            out.append((int(lot), float(step), int(value[low]), np.dtype(kind).itemsize, gaps.astype(kind).tobytes(), t.astype(np.int64).tobytes() if (t > 1).any() else b""))
    return out


#: Pairs beyond which distances are counted by bins first where digits say how exact rho must be; nodes of a stretch then, bins, bins of a packed
#: row, equal cells of distances that bins are dealt to, and into how many parts bins are finer if they don't decide. What sums of doubles may be off by.
PAIRS, FAR_STRETCH, COUNTED, SPAN, CELLS, FINER, SUMS = 1 << 33, 1 << 15, 1 << 24, 1 << 14, 1 << 14, 4, 1e-11


def distance_correlation(tree: DataFrame, vectors: DataFrame, digits: int | None = None) -> DataFrame:
    """(rho, n) of 1 - cosine and steps in the tree over all connected pairs, ranked; average ranks for ties, 0 without variance.

    With ``digits`` only rho rounded to so many is asked for. Over ``PAIRS`` pairs are then counted by narrow bins of distances, which bounds
    rho from both sides; if both bounds round to the same, that is the result. If not, bins become narrower, and at last all distances are ranked.
    """
    n = vectors.where("vector IS NOT NULL").count() if digits is not None else 0
    if n * (n - 1) // 2 > PAIRS:
        for parts in (1, FINER):
            low, high, total = bounded_correlation(tree, vectors, parts)
            if low is not None and round(low, digits) == round(high, digits):
                return tree.sparkSession.createDataFrame([((low + high) / 2, total)], "rho double, n bigint")
    return ranked_correlation(tree, vectors)


def sampled(vectors: DataFrame) -> np.ndarray:
    """``SAID`` unit vectors by the hash of their nodes."""
    known = vectors.select("node", F.col("vector").cast("array<double>").alias("v")).where("v IS NOT NULL")
    return unit(pd.Series([r["v"] for r in known.orderBy(F.xxhash64("node")).limit(SAID).collect()]).astype(object)) if not known.isEmpty() else np.zeros((1, 1))


class Bins:
    """Bins of distances, narrow where many are: whole numbers of ``UNIT`` go to equal cells, each divided by its share of a sample.

    Where bins end only says how near the bounds come; equal distances always share a bin."""

    def __init__(self, said: np.ndarray, n: int) -> None:
        far = 1 - (said @ said.T)[np.triu_indices(len(said), 1)]
        self.scale = CELLS / 2.0 * UNIT
        share = np.bincount(np.clip((far * (CELLS / 2.0)).astype(np.int64), 0, CELLS - 1), minlength=CELLS) / max(1, len(far))
        self.slots = np.floor(1 + max(0, n - CELLS) * share)
        self.start = np.concatenate([[0], np.cumsum(self.slots)])[:-1]
        self.n = int(self.slots.sum())

    def of(self, far: np.ndarray) -> np.ndarray:
        x = np.rint(far / UNIT) * self.scale
        cell = np.clip(x.astype(np.int64), 0, CELLS - 1)
        inside = np.clip(x - cell, 0, 1 - 1e-9)
        return (self.start[cell] + np.floor(inside * self.slots[cell])).astype(np.int64)


def counted_bins(found: Iterable[tuple[np.ndarray, np.ndarray]], bins: Bins, part: int, parts: int) -> pd.DataFrame:
    """(lot, steps, counts): how many distances of a number of steps each bin has, packed by ``SPAN`` bins, of one of ``parts`` parts of all bins."""
    low, high = (bins.n * x // parts for x in (part, part + 1))
    counts: dict[int, np.ndarray] = {}
    for far, steps in found:
        at = bins.of(far)
        if parts > 1:
            inner = (at >= low) & (at < high)
            at, steps = at[inner], steps[inner]
        kinds = np.flatnonzero(np.bincount(steps))
        for step in kinds.tolist():
            own = at[steps == step] if len(kinds) > 1 else at
            np.add.at(counts.setdefault(step, np.zeros(high - low, np.int32)), own - low, np.ones(len(own), np.int32))
    out = []
    for step, count in counts.items():
        begin = low
        while begin < high:
            end = min(high, (begin // SPAN + 1) * SPAN)
            some = count[begin - low : end - low]
            if some.any():
                row = np.zeros(SPAN, np.int32)
                row[begin % SPAN : begin % SPAN + len(some)] = some
                out.append((begin // SPAN, step, zlib.compress(row.tobytes(), 1)))
            begin = end
    return pd.DataFrame(out, columns=["lot", "steps", "counts"])


def bounded_correlation(tree: DataFrame, vectors: DataFrame, parts: int) -> tuple[float | None, float | None, int]:
    """(low, high, n): bounds of rho from counts by bins. Ranks inside a bin are as unsure as its pairs of different steps are many.

    A task adds up a block's counts; a pair is neither a row nor kept. Several parts meet every block as often, each with bins of its own.
    """
    left, right, met = tree_blocks(tree, vectors, FAR_STRETCH)
    bins = Bins(sampled(vectors), COUNTED * parts)

    def count(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return counted_bins(met(a, b), bins, int(a["part"].iloc[0]), parts) if len(a) and len(b) else pd.DataFrame({"lot": [], "steps": [], "counts": []})

    of = lambda df: df.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    keys, kinds = ("i", "j", "part"), pa.schema([("lot", pa.int32()), ("steps", pa.int32()), ("counts", pa.binary())])
    packed = of(left).groupBy(*keys).cogroup(of(right).groupBy(*keys)).applyInArrow(in_arrow(count, kinds), "lot int, steps int, counts binary")

    def add(f: pd.DataFrame) -> pd.DataFrame:
        """For each number of steps its pairs and their ranks inside the lot; for each two how many pairs of pairs share a bin; at (0, 0) what ties can be at most."""
        sums: dict[int, np.ndarray] = {}
        for step, packed in zip(f["steps"].tolist(), f["counts"], strict=True):
            sums[step] = sums.get(step, 0) + np.frombuffer(zlib.decompress(packed), np.int32).astype(np.int64)
        every = sum(sums.values())
        middle, many = np.cumsum(every) - (every - 1) / 2, every.astype(float)
        steps = sorted(sums)
        rows = [(s, s, int(sums[s].sum()), float((sums[s] * middle).sum())) for s in steps]
        rows += [(s, t, 0, float((sums[s].astype(float) * sums[t]).sum())) for x, s in enumerate(steps) for t in steps[x + 1 :]]
        rows.append((0, 0, 0, float((many**3 - many).sum())))
        return pd.DataFrame(rows, columns=["one", "two", "n", "sum"]).assign(lot=int(f["lot"].iloc[0]))

    ranges = cut(packed.groupBy("lot").applyInPandas(add, "lot int, one int, two int, n bigint, sum double"))
    below = running(ranges.groupBy("lot").agg(F.sum("n").alias("m")), "lot", "m").select("lot", "below")
    found = ranges.join(below, "lot").groupBy("one", "two").agg(F.sum("n").alias("n"), F.sum(F.col("sum") + F.col("n") * F.col("below")).alias("sum")).collect()
    of_steps = sorted((r["one"], r["n"], r["sum"]) for r in found if r["one"] == r["two"] > 0)
    total, ties = sum(n for _, n, _ in of_steps), sum(r["sum"] for r in found if r["two"] == 0)
    middle, place, y = (total + 1) / 2, 0, {}
    for step, n, _ in of_steps:
        y[step], place = place + (n + 1) / 2 - middle, place + n
    xy = sum(y[s] * (ranks - n * middle) for s, n, ranks in of_steps)
    unsure = sum(abs(y[r["one"]] - y[r["two"]]) * r["sum"] / 2 for r in found if r["one"] < r["two"])
    yy, most = sum(n * y[s] ** 2 for s, n, _ in of_steps), (float(total) ** 3 - total) / 12
    least = most - ties / 12
    if yy <= 0 or least <= 0:
        return None, None, total
    ends = [x / (yy * v) ** 0.5 for x in (xy - unsure, xy + unsure) for v in (least, most)]
    return min(ends) - SUMS, max(ends) + SUMS, total


def ranked_correlation(tree: DataFrame, vectors: DataFrame) -> DataFrame:
    """(rho, n) of ``distance_correlation`` from the ranks of all pairs.

    No pair is a row. A task sorts the distances of its pairs by ranges and steps, and sends a range's distances as one packed row: whole
    numbers of ``UNIT`` from the range's begin, each once with its count. A range's ranks follow from those of the ranges before and its own.
    """
    left, right, met = tree_blocks(tree, vectors)
    said, total = sampled(vectors), vectors.where("vector IS NOT NULL").count()
    parts = int(min(RANGES, max(16, total * total // 2 // RANGE)))
    # 1 - cosine lies in 0..2 up to rounding; where ranges end only says how many values a task has
    ends = np.unique(np.round(np.quantile(1 - said @ said.T, np.arange(1, parts) / parts) / UNIT).astype(np.int64))

    def pack(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out, found, held = [], [], 0
        for one in met(a, b):
            found.append(one)
            held += len(one[0])
            if held > PACKED:
                out += packed_ranges(found, ends)
                found, held = [], 0
        return pd.DataFrame(out + packed_ranges(found, ends), columns=["lot", "steps", "first", "wide", "gaps", "times"])

    kinds = pa.schema([("lot", pa.int32()), ("steps", pa.float64()), ("first", pa.int64()), ("wide", pa.int32()), ("gaps", pa.binary()), ("times", pa.binary())])
    packed = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(in_arrow(pack, kinds), "lot int, steps double, first bigint, wide int, gaps binary, times binary")

    def rank(f: pd.DataFrame) -> pd.DataFrame:
        values, times, steps = [], [], []
        for r in f.itertuples():
            v = np.concatenate([[0], np.frombuffer(r.gaps, np.uint32 if r.wide == 4 else np.int64).astype(np.int64)]).cumsum() + r.first
            values.append(v)
            times.append(np.frombuffer(r.times, np.int64) if r.times else np.ones(len(v), np.int64))
            steps.append(np.full(len(v), r.steps))
        value, times, steps = np.concatenate(values), np.concatenate(times), np.concatenate(steps)
        _, at = np.unique(value, return_inverse=True)
        tied = np.bincount(at, times)
        middle = np.cumsum(tied) - (tied - 1) / 2
        kinds, which = np.unique(steps, return_inverse=True)
        ties = np.zeros(len(kinds))
        ties[0] = (tied**3 - tied).sum()  # of the whole range
        return pd.DataFrame({"lot": int(f["lot"].iloc[0]), "steps": kinds, "n": np.bincount(which, times).astype(np.int64), "ranks": np.bincount(which, times * middle[at]), "ties": ties})

    # a row for each range and number of steps from here on
    ranges = cut(packed.groupBy("lot").applyInPandas(rank, "lot int, steps double, n bigint, ranks double, ties double"))
    before = lambda key: running(ranges.groupBy(key).agg(F.sum("n").alias("m")), key, "m")
    lots, steps = before("lot").select("lot", "below"), before("steps").select("steps", (F.col("below") + (F.col("m") + 1) / 2.0).alias("r"))
    sums = ranges.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum("ties"), F.lit(0.0)).alias("tied"))
    rows = ranges.join(lots, "lot").join(steps, "steps").crossJoin(F.broadcast(sums))
    middle = (F.col("total") + 1) / 2.0
    y = F.col("r") - middle
    xy, yy = F.sum(y * (F.col("ranks") + F.col("n") * (F.col("below") - middle))), F.sum(F.col("n") * y * y)
    total = F.col("total").cast("double")
    found = rows.agg(xy.alias("xy"), yy.alias("yy")).crossJoin(F.broadcast(sums)).withColumn("xx", (total * total * total - total - F.col("tied")) / 12)
    return found.select(F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))).otherwise(F.lit(0.0)).alias("rho"), F.col("total").alias("n"))


#: Kernel values below this are left out: beyond NEGLIGIBLE a point is too far from a cell to count.
NEGLIGIBLE = 1e-12


def weighted_grid(points: DataFrame, size: int, bandwidth: float, weight: str | None = None, padding: float = 0.1, bins: int | None = None) -> DataFrame:
    """(gx, gy, density): a Gaussian kernel sum over a size * size grid around points (x, y), optionally weighted by
    log1p of a count; 0 without points. Points without a place are left out.

    The kernel is a product of one along x and one along y, so sums go along one axis at a time: a place counts for the columns
    within reach, a column's places count for the cells within reach. Points of one place are added up first. With
    ``bins`` a place is the middle of one of ``bins`` parts of a cell's width and height, so that what follows is of bounded size however
    many points there are, and every place moves by half a part at most; without it, results are exact.
    """
    w = F.log1p(F.col(weight).cast("double")) if weight else F.lit(1.0)
    own = points.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), w.alias("w")).where("x IS NOT NULL AND y IS NOT NULL")
    box = own.agg(*(f(c).alias(f"{n}{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))), F.sum("w").alias("total"))
    span = lambda c: (1 + 2 * padding) * (F.col(f"hi{c}") - F.col(f"lo{c}"))
    # a row: the first cell's place and the step of either axis
    box = F.broadcast(cut(box.select("total", *(x for c in "xy" for x in ((F.col(f"lo{c}") - padding * (F.col(f"hi{c}") - F.col(f"lo{c}"))).alias(f"from_{c}"), (span(c) / max(1, size - 1)).alias(f"step_{c}"))))))
    rows = own.crossJoin(box)
    if bins:
        middle = lambda c: F.when(F.col(f"step_{c}") > 0, (F.floor((F.col(c) - F.col(f"from_{c}")) / F.col(f"step_{c}") * bins) + 0.5) * F.col(f"step_{c}") / bins + F.col(f"from_{c}")).otherwise(F.col(c))
        rows = rows.select(middle("x").alias("x"), middle("y").alias("y"), "w")
    places = rows.groupBy("x", "y").agg(F.sum("w").alias("w")).crossJoin(box)
    reach = bandwidth * float(np.sqrt(-2 * np.log(NEGLIGIBLE)))

    def within(df: DataFrame, c: str) -> DataFrame:
        """A row for each cell along axis ``c`` within reach, its weight multiplied by the kernel."""
        from_, step, last = F.col(f"from_{c}"), F.col(f"step_{c}"), F.lit(size - 1)
        low = F.when(step > 0, F.greatest(F.lit(0), F.ceil((F.col(c) - reach - from_) / step))).otherwise(F.lit(0)).cast("int")
        high = F.when(step > 0, F.least(last, F.floor((F.col(c) + reach - from_) / step))).otherwise(last).cast("int")
        cells = df.where(low <= high).withColumn(f"g{c}", F.explode(F.sequence(low, high)))
        return cells.withColumn("w", F.col("w") * F.exp(-((F.col(c) - from_ - F.col(f"g{c}") * step) ** 2) / (2 * bandwidth**2)))

    columns = within(places, "x").groupBy("gx", "y").agg(F.sum("w").alias("w")).crossJoin(box)
    cells = within(columns, "y").groupBy("gx", "gy").agg(F.sum("w").alias("w"), F.max("total").alias("total"))
    k = F.col("id")
    grid = points.sparkSession.range(size * size).select(F.floor(k / size).cast("int").alias("gx"), (k % size).cast("int").alias("gy"))
    return grid.join(cells, ["gx", "gy"], "left").select("gx", "gy", F.coalesce(F.when(F.col("total") > 0, F.col("w") / F.col("total")), F.lit(0.0)).alias("density"))


#: Segments that begin in a cell of the quadtree before it is split, how often cells are split at most, how often a split cell's segments may be
#: copied, rows of a group, and rows and columns of a tile.
CROWD, DEEPEST, COPIES, LOT, TILE, WIDE = 4096, 14, 4, 131_072, 128, 512


def crossing_pairs(f: pd.DataFrame, apart: bool = False) -> int:
    """Crossing pairs among rows (id, a, b, ax, ay, bx, by, lot, own_x, own_y): own tells if a box begins in the cell along that axis, as
    the corner of what two boxes share must. With ``apart`` only of different lots.

    Rows are swept by the left ends of their boxes, in tiles. On which side of lines the ends lie comes from products of matrices in short floats;
    where that is nearer to 0 than their rounding allows, pairs are decided one by one by the definition's own arithmetic.
    """
    f = f.iloc[np.argsort(np.minimum(f["ax"].to_numpy(), f["bx"].to_numpy()), kind="stable")]
    ax, ay, bx, by = (f[c].to_numpy(float) for c in ("ax", "ay", "bx", "by"))
    lo_x, hi_x, lo_y, hi_y = np.minimum(ax, bx), np.maximum(ax, bx), np.minimum(ay, by), np.maximum(ay, by)
    own_x, own_y, lot = f["own_x"].to_numpy(bool), f["own_y"].to_numpy(bool), f["lot"].to_numpy()
    n, ids = len(f), pd.factorize(f["id"])[0]
    ends = pd.factorize(pd.concat([f["a"], f["b"]]))[0].reshape(2, n)
    seen_end, seen_id = np.zeros(2 * n, bool), np.zeros(n, bool)
    mid_x, mid_y, far = (lo_x[0] + hi_x.max()) / 2, (lo_y.min() + hi_y.max()) / 2, max(hi_x.max() - lo_x[0], hi_y.max() - lo_y.min()) / 2 or 1.0
    sx, sy, tx, ty = (ax - mid_x) / far, (ay - mid_y) / far, (bx - mid_x) / far, (by - mid_y) / far  # in -1..1
    short = lambda *c: np.stack(c, 1).astype(np.float32)
    begin, end = short(sx, sy, np.ones(n)), short(tx, ty, np.ones(n))
    line = short(sy - ty, tx - sx, sx * ty - tx * sy)  # times an end: twice the area of the triangle
    # a line's numbers are at most L, L and 2 L, so an area is at most 4 L and off by less than 20 * 2^-24 L: a product above this has no factor that rounding could turn
    doubt = np.float32(2.0**-16 * max(np.abs(tx - sx).max(), np.abs(ty - sy).max()) ** 2)

    def defined(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whether pairs cross and their boxes meet; the same either way round, rounding included."""

        def parted(p: np.ndarray, q: np.ndarray) -> np.ndarray:
            run, rise = bx[p] - ax[p], by[p] - ay[p]
            return ((ay[q] - ay[p]) * run > rise * (ax[q] - ax[p])) != ((by[q] - ay[p]) * run > rise * (bx[q] - ax[p]))

        ok = (lo_x[q] <= hi_x[p]) & (lo_x[p] <= hi_x[q]) & (lo_y[q] <= hi_y[p]) & (lo_y[p] <= hi_y[q])
        return ok & parted(p, q) & parted(q, p)

    def crossing(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        sides = (begin[p] @ line[q].T) * (end[p] @ line[q].T)
        np.maximum(sides, (line[p] @ begin[q].T) * (line[p] @ end[q].T), out=sides)
        ok = sides <= doubt
        unsure = ok & (sides >= -doubt)
        if unsure.any():
            i, j = np.divmod(np.flatnonzero(unsure), len(q))
            ok[i, j] = defined(p[i], q[j])
        return ok & (lot[p][:, None] != lot[q]) if apart else ok

    def strangers(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        row = p[:, None]
        return (ids[row] != ids[q]) & (ends[0][row] != ends[0][q]) & (ends[0][row] != ends[1][q]) & (ends[1][row] != ends[0][q]) & (ends[1][row] != ends[1][q])

    total = 0
    for begins in (True, False):  # boxes that begin in the cell along y meet all; those from below only the former
        later = np.flatnonzero(own_x & (own_y == begins))  # the corner begins where the later box does
        for i in range(0, n, TILE):
            p = np.arange(i, min(n, i + TILE))
            inner, after = np.searchsorted(later, i), np.searchsorted(later, p[-1], "right")
            rest = later[after : np.searchsorted(later, np.searchsorted(lo_x, hi_x[p].max(), "right"))]
            inner = later[inner:after]
            p = p if begins else p[own_y[p]]
            total += int((crossing(p, inner) & strangers(p, inner) & (p[:, None] < inner)).sum())
            for j in range(0, len(rest), WIDE):
                q = rest[j : j + WIDE]
                near = p[hi_x[p] >= lo_x[q[0]]]
                ok = crossing(near, q)
                seen_end[ends[:, q]], seen_id[ids[q]] = True, True
                known = seen_end[ends[0][near]] | seen_end[ends[1][near]] | seen_id[ids[near]]
                seen_end[ends[:, q]], seen_id[ids[q]] = False, False
                if known.any():
                    ok[known] &= strangers(near[known], q)
                total += int(np.count_nonzero(ok))
    return total


def crossings(segments: DataFrame) -> DataFrame:
    """(crossings) among segments (id, a, b, ax, ay, bx, by): pairs with four different ends that cross.

    Only segments whose boxes share a cell of a quadtree can cross. Cells in which over ``CROWD`` boxes begin are split into four, down to
    ``DEEPEST``, as long as boxes are not much larger than the parts; so a segment has few copies. A cell's pairs are tested in tiles and
    counted, none becomes a row; a cell of over ``LOT`` segments is met in lots. A pair counts in the cell that has the lower left corner of
    what its boxes share, which is in both.
    """
    names, places = ["id", "a", "b"], ["ax", "ay", "bx", "by"]
    rows = cut(segments.select(*names, *(F.col(c).cast("double").alias(c) for c in places)).dropna())
    low, high = (lambda c: F.least(f"a{c}", f"b{c}")), (lambda c: F.greatest(f"a{c}", f"b{c}"))
    box = rows.agg(F.min(low("x")), F.min(low("y")), F.max(high("x")), F.max(high("y"))).first()
    if box[0] is None:
        return rows.agg(F.count("*").alias("crossings"))
    x0, y0, size, top = box[0], box[1], max(box[2] - box[0], box[3] - box[1]) or 1.0, 1 - 2.0**-40
    # places in 0..1, and cells as integers: a cell of depth d has (cx, cy) below 2^d
    first = lambda c, o: F.floor(F.least(F.lit(top), (low(c) - o) / size) * 2.0**DEEPEST).cast("bigint")
    w, h = (high("x") - low("x")) / size, (high("y") - low("y")) / size
    begun = rows.groupBy(first("x", x0).alias("cx"), first("y", y0).alias("cy")).agg(F.count("*").alias("n"), F.sum(w + h).alias("s"), F.sum(w * h).alias("r"))
    begun = cut(begun)
    split: list[np.ndarray] = []
    for d in range(DEEPEST):  # crowded cells alone come here
        wide = F.lit(2.0 ** (d + 1))
        full = begun.groupBy(F.shiftright("cx", DEEPEST - d).alias("cx"), F.shiftright("cy", DEEPEST - d).alias("cy")).agg(*(F.sum(c).alias(c) for c in "nsr"))
        full = full.where((F.col("n") > CROWD) & (F.col("n") + F.col("s") * wide + F.col("r") * wide * wide <= COPIES * F.col("n"))).collect()
        parents = set(split[-1].tolist()) if split else None
        keys = [r["cx"] << 32 | r["cy"] for r in full if parents is None or (r["cx"] >> 1) << 32 | r["cy"] >> 1 in parents]
        if not keys:
            break
        split.append(np.array(sorted(keys), np.int64))

    def dealt(frames):
        for f in frames:
            lows = [np.minimum(top, (np.minimum(f[f"a{c}"], f[f"b{c}"]).to_numpy() - o) / size) for c, o in (("x", x0), ("y", y0))]
            highs = [np.minimum(top, (np.maximum(f[f"a{c}"], f[f"b{c}"]).to_numpy() - o) / size) for c, o in (("x", x0), ("y", y0))]
            at, cell = np.arange(len(f)), [np.zeros(len(f), np.int64)] * 2
            for d in range(len(split) + 1):
                more = np.isin(cell[0] << 32 | cell[1], split[d]) if d < len(split) else np.zeros(len(at), bool)
                out, here = f.iloc[at[~more]], [c[~more] for c in cell]
                own = [np.floor(lo[at[~more]] * 2.0**d).astype(np.int64) == c for lo, c in zip(lows, here, strict=True)]
                yield out.assign(depth=d, cx=here[0], cy=here[1], own_x=own[0], own_y=own[1])
                at, cell = at[more], [c[more] for c in cell]
                for axis in (0, 1):
                    half = np.repeat(cell[axis] * 2, 2) + np.tile([0, 1], len(at))
                    at, cell = np.repeat(at, 2), [np.repeat(c, 2) for c in cell]
                    cell[axis] = half
                    touched = (half >= np.floor(lows[axis][at] * 2.0 ** (d + 1))) & (half <= np.floor(highs[axis][at] * 2.0 ** (d + 1)))
                    at, cell = at[touched], [c[touched] for c in cell]

    schema = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in rows.schema) + ", depth int, cx bigint, cy bigint, own_x boolean, own_y boolean"
    leaves, leaf = rows.mapInPandas(dealt, schema), ["depth", "cx", "cy"]
    over = cut(leaves.groupBy(*leaf).agg(F.ceil(F.count("*") / LOT).cast("int").alias("lots")).where("lots > 1"))
    lots = F.coalesce("lots", F.lit(1))
    met = leaves.join(F.broadcast(over), leaf, "left").withColumn("lot", F.pmod(F.xxhash64("id"), lots).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), lots - 1)))
    met = met.select("*", F.least("lot", "other").alias("i"), F.greatest("lot", "other").alias("j")).drop("lots", "other")
    parts = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = met.repartition(parts, *leaf, "i", "j").groupBy(*leaf, "i", "j").applyInPandas(lambda f: pd.DataFrame({"n": [crossing_pairs(f, f["i"].iloc[0] != f["j"].iloc[0])]}), "n bigint")
    return counted.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("crossings"))


# traces


def visit_counts(events: DataFrame) -> DataFrame:
    """A1."""
    return events.groupBy("qname").agg(F.count("*").alias("visits"))


def divergence(real: DataFrame, predicted: DataFrame, every: DataFrame) -> DataFrame:
    """(qname, class): matched, surprise (real only), missed (predicted only), untouched; counts must be above 0."""
    r = real.where("visits > 0").select("qname", F.lit(True).alias("r"))
    p = predicted.where("visits > 0").select("qname", F.lit(True).alias("p"))
    out = every.select("qname").distinct().join(r, "qname", "full").join(p, "qname", "full")
    return out.select("qname", F.when(F.col("r") & F.col("p"), "matched").when(F.col("r"), "surprise").when(F.col("p"), "missed").otherwise("untouched").alias("class"))


def agreement(one: DataFrame, two: DataFrame) -> DataFrame:
    """A10: (shared, only_first, only_second, rate) over distinct edges (src, dst)."""
    a, b = one.select("src", "dst").distinct().withColumn("x", F.lit(1)), two.select("src", "dst").distinct().withColumn("y", F.lit(1))
    both = a.join(b, ["src", "dst"], "full")
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("bigint")
    out = both.agg(count(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("shared"), count(F.col("y").isNull()).alias("only_first"), count(F.col("x").isNull()).alias("only_second"))
    return out.withColumn("rate", F.when(F.col("shared") + F.col("only_first") + F.col("only_second") > 0, F.col("shared") / (F.col("shared") + F.col("only_first") + F.col("only_second"))))


def call_depths(events: DataFrame, key: str = "thread") -> DataFrame:
    """``events`` (key, seq, step) with ``depth`` after each event; step is 1 for a call and -1 for a return.

    The count never falls below 0: a return too many is forgotten, which the running minimum of the plain sum corrects.
    """
    w = Window.partitionBy(key).orderBy("seq")
    total = events.withColumn("__s", F.sum("step").over(w))
    return total.withColumn("depth", (F.col("__s") - F.least(F.lit(0), F.min("__s").over(w))).cast("int")).drop("__s")


def execution_score(events: DataFrame, levels: DataFrame, jump: float = 0.8) -> DataFrame:
    """(key, seq, qname, y, jumped) of events (key, seq, qname) whose name has a level; a jump is a step of more than
    ``jump`` from the event kept before, the first is none."""
    w = Window.partitionBy("key").orderBy("seq")
    kept = events.join(levels, "qname").withColumn("__before", F.lag("y").over(w))
    return kept.select("key", "seq", "qname", "y", F.coalesce(F.abs(F.col("y") - F.col("__before")) > jump, F.lit(False)).alias("jumped"))


def duet(predicted: DataFrame) -> DataFrame:
    """(qname, i, x): each predicted name repeated by its calls in order, x its place in 0..1 over the whole sequence."""
    ends = Window.orderBy("ord")  # predictions are one short document
    runs = predicted.where("approx_calls > 0").withColumn("end", F.sum("approx_calls").over(ends))
    total = F.broadcast(runs.agg(F.sum("approx_calls").alias("n")))
    steps = runs.select("qname", F.explode(F.sequence(F.col("end") - F.col("approx_calls"), F.col("end") - 1)).alias("i"))
    return steps.crossJoin(total).select("qname", F.col("i").cast("bigint").alias("i"), (F.col("i") / F.greatest(F.lit(1), F.col("n") - 1)).alias("x"))


def bands(points: DataFrame) -> DataFrame:
    """(file, low, high) of y."""
    return points.groupBy("file").agg(F.min("y").alias("low"), F.max("y").alias("high"))


def fallback_heights(depths: DataFrame) -> DataFrame:
    """(node, height): 10 at the top, 0 at the largest depth."""
    top = F.broadcast(depths.agg(F.max("depth").alias("top")))
    return depths.crossJoin(top).select("node", ((F.col("top") - F.col("depth")) / F.greatest(F.lit(1), F.col("top")) * 10).alias("height"))


def spread_xy(points: DataFrame, half: float = 25.0) -> DataFrame:
    """Points (id, x, y) moved to the middle and scaled by the larger span to +-half."""
    box = F.broadcast(points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")))
    rows = points.crossJoin(box)
    span = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    span = F.when(span > 0, span).otherwise(F.lit(1.0))
    return rows.select("id", *(((F.col(c) - (F.col(f"{c}0") + F.col(f"{c}1")) / 2) / span * 2 * half).alias(c) for c in "xy"))


def split_predictions(predicted: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Predictions of known names with calls above 0 (the last of a name counts), and the names that were dropped."""
    good = predicted.join(known.select("qname").distinct(), "qname", "left_semi").where("approx_calls > 0")
    return one_per(good, ["qname"], F.desc("ord")), lack(predicted, good, ["qname"]).select("qname").distinct()


def diagnostics_by_path(rows: DataFrame) -> DataFrame:
    """(path, n, items): diagnostics (path, line0, severity, message, rule) with lines from 1, severity ``information`` if
    missing, sorted by line and message."""
    item = F.struct((F.col("line0") + 1).cast("int").alias("line"), F.col("message").alias("message"), F.coalesce("severity", F.lit("information")).alias("severity"), F.col("rule").alias("rule"))
    return rows.groupBy("path").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(item)).alias("items"))


def pulled(points: DataFrame, edges: DataFrame, rounds: int = 4, strength: float = 0.35) -> DataFrame:
    """Points (node, x, y) moved towards the mean of their parents' places of the round before."""
    now = points.select("node", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    for _ in range(rounds):
        up = edges.select("src", F.col("dst").alias("node")).distinct().join(now.select(F.col("node").alias("src"), F.col("x").alias("px"), F.col("y").alias("py")), "src").groupBy("node").agg(F.avg("px").alias("px"), F.avg("py").alias("py"))
        now = cut(now.join(up, "node", "left").select("node", *((F.col(c) + strength * (F.coalesce(f"p{c}", c) - F.col(c))).alias(c) for c in "xy")))
    return now
