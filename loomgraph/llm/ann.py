"""Approximate nearest neighbours by cosine with an inverted multi-index.

Vectors are scaled to length 1 and cut into two halves; each half is quantised by its own ``k`` centroids
(k-means on at most ``SAMPLE`` rows, those with the smallest hash of their id), so a vector lies in one of k * k
cells. Every vector is indexed. A query walks the pairs of centroids in order of summed squared distance with a
heap, until the cells it passed hold ``candidates`` vectors or all cells are passed, and meets the vectors of these
cells. How many candidates that are is measured, not guessed: for at most ``PROBES`` vectors that are no queries (queries, if
all are) the true neighbours are found by brute force over all rows (one pass), and ``candidates`` is what the share
``RECALL`` of these neighbours needs. Clustered vectors need a few cells; vectors without structure need a large share of
all. ``quality`` measures recall and the share of vectors read on the queries themselves, which tuning hasn't seen. Cosines
are computed in double precision on the original vectors, scaled by powers of two, which is exact, so that no square
overflows; ties go to the smaller id.

Of vectors that are equal in all components only the ``n + 1`` smallest ids, with up to n rows each, can be among the n
nearest of any query, so only these are indexed. Cells lie in lots, as many as ``LOTS`` or as ``LOT_BYTES`` ask for, and a query meets its
cells of a lot at once, so it makes a row for each lot, whatever the number of cells. Cells of more vectors than a lot are split by a
hash of the id and searched in all lots that have a part, so a cell of any size is searched whole, by many tasks.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows with a null id or a
number of components other than the most frequent (the smaller, if two are). Rows that repeat an id are candidates
of their own; as a query, an id has the smallest of its vectors and none of its own rows as a candidate.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, cut, table

SAMPLE, MOST_CENTROIDS, ROUNDS = 16_384, 256, 12
#: Lots of cells at least; vectors of a lot, its bytes and those of the queries that meet it at once, and scores of one step, at most.
LOTS, BLOCK, LOT_BYTES, SCORES = 32, 65_536, 32 << 20, 1 << 21
#: Vectors a cell holds on average, and vectors a query meets at least.
PER_CELL, CANDIDATES = 32, 64
#: Vectors whose true neighbours are found, and the share of these that the walk must reach.
PROBES, RECALL = 192, 0.95


def usable(df: DataFrame, id: str, vector: str) -> DataFrame:
    """(vec_id, vec array<double>) of the rows that take part."""
    rows = df.select(col(id).cast("bigint").alias("vec_id"), col(vector).cast("array<double>").alias("vec")).where("vec_id IS NOT NULL AND size(vec) > 0")
    rows = rows.where(F.forall("vec", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists("vec", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("vec") == (sizes[0]["d"] if sizes else 0))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that the largest component lies between 0.5 and 1."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1."""
    x = scaled(x)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def kmeans(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        near = nearest(x, centres)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=k)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
        if (n == 0).any():  # an empty one moves to a random point
            centres[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([np.empty(0, np.int64), *(distances(x[i : i + 8192], centres).argmin(1) for i in range(0, len(x), 8192))]).astype(np.int64)


def matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def walk(one: np.ndarray, two: np.ndarray, counts: np.ndarray, wanted: int) -> list[int]:
    """Cells with vectors, by summed distance to the query's halves, until they hold ``wanted`` vectors."""
    a, b = one.argsort(), two.argsort()
    k, found, held = len(a), [], 0
    heap, seen = [(one[a[0]] + two[b[0]], 0, 0)], {(0, 0)}
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * k + int(b[j])
        if counts[cell]:
            found.append(cell)
            held += counts[cell]
        for m, n in ((i + 1, j), (i, j + 1)):
            if m < k and n < k and (m, n) not in seen:
                seen.add((m, n))
                heapq.heappush(heap, (one[a[m]] + two[b[n]], m, n))
    return found


def needed(one: np.ndarray, two: np.ndarray, counts: np.ndarray, cells: list[int]) -> list[int]:
    """How many vectors the walk must be asked for to reach each of these cells."""
    order = walk(one, two, counts, int(counts.sum()))
    before = dict(zip(order, np.cumsum(counts[order]) - counts[order], strict=True))
    return [int(before[c]) + 1 for c in cells]


def rerank(queries: np.ndarray, ids: np.ndarray, cells: list[np.ndarray], entries: np.ndarray, own: np.ndarray, cell: np.ndarray, n: int) -> tuple[list, list, list]:
    """For each query row, the n nearest entries of its cells: (query rows, entry ids, cosines)."""
    out: tuple[list, list, list] = ([], [], [])
    order = cell.argsort(kind="stable")
    entries, own, cell = entries[order], own[order], cell[order]
    held, begin = np.unique(cell, return_index=True)
    end = np.append(begin[1:], len(cell))
    e_unit = unit(entries)
    entries, queries = scaled(entries), scaled(queries)
    norm = np.sqrt((entries * entries).sum(1))
    step = max(1, SCORES // len(entries))
    for at in range(0, len(queries), step):
        q_unit, asked = unit(queries[at : at + step]), cells[at : at + step]
        # who asks for each cell: only what a query's cells hold is compared with it
        who, what = np.repeat(np.arange(len(asked)), [len(c) for c in asked]), np.concatenate(asked)
        by = what.argsort(kind="stable")
        who, low, high = who[by], np.searchsorted(what[by], held), np.searchsorted(what[by], held, "right")
        scores = np.full((len(asked), len(entries)), -2.0)
        for c in np.flatnonzero(high > low):
            rows = who[low[c] : high[c]]
            scores[rows, begin[c] : end[c]] = q_unit[rows] @ e_unit[begin[c] : end[c]].T
        for r, near in enumerate(scores, at):
            near[own == ids[r]] = -2
            take = np.arange(len(near))
            if len(near) > n:
                take = np.flatnonzero(near >= np.partition(near, -n)[-n] - 1e-9)
            take = take[near[take] > -1.5]
            score = (entries[take] * queries[r]).sum(1) / (norm[take] * np.sqrt((queries[r] * queries[r]).sum()))
            best = np.lexsort((own[take], -score))[:n]
            out[0].extend([ids[r]] * len(best))
            out[1].extend(own[take][best].tolist())
            out[2].extend(score[best].tolist())
    return out


class Index:
    """All usable rows by cell: ``rows`` (vec_id, cell, vec), how many vectors each cell has, and the centroids."""

    def __init__(self, df: DataFrame, n: int = 5, id: str = "vec_id", vector: str = "embedding") -> None:
        self.all, self.n = usable(df, id, vector), n
        same = Window.partitionBy(F.xxhash64("vec"), "vec").orderBy("vec_id")
        once = self.all.groupBy("vec_id", "vec").agg(F.least(F.count("*"), F.lit(n)).cast("int").alias("times"))
        once = once.withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= n + 1)
        rows = cut(once.select("vec_id", "vec", F.explode(F.sequence(F.lit(1), "times")).alias("time")).drop("time"))
        self.total = rows.count()
        if not self.total:
            return
        sample = unit(matrix(rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec").toArrow()["vec"]))
        half = self.half = max(1, sample.shape[1] // 2)
        k = self.k = int(max(1, min(MOST_CENTROIDS, round((self.total / PER_CELL) ** 0.5), len(sample) // 16)))
        one = kmeans(sample[:, :half], k, 1)
        two = kmeans(sample[:, half:], k, 2) if sample.shape[1] > half else np.zeros((k, 0))
        self.centres = one, two

        def assign(batches):
            for batch in batches:
                if batch.num_rows:
                    x = unit(matrix(batch.column("vec")))
                    yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(nearest(x[:, :half], one) * k + nearest(x[:, half:], two)), batch.column("vec")], names=["vec_id", "cell", "vec"])

        self.rows = cut(rows.mapInArrow(assign, "vec_id bigint, cell bigint, vec array<double>"))
        self.counts = np.zeros(k * k, np.int64)
        for cell, count in self.rows.groupBy("cell").count().collect():  # at most k * k numbers
            self.counts[cell] = count

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return distances(x[:, : self.half], self.centres[0]), distances(x[:, self.half :], self.centres[1])

    def asked(self, queries) -> DataFrame:
        """(vec_id, vec) of the ids that the condition picks."""
        return self.all.where(queries).groupBy("vec_id").agg(F.min("vec").alias("vec"))

    def true_cells(self, drawn: pa.Table) -> list[list[int]]:
        """The cells of the true neighbours of some rows, by brute force over all rows."""
        ids, x = drawn["vec_id"].to_numpy(), unit(matrix(drawn["vec"]))
        n = self.n

        def scan(batches):
            for batch in batches:
                if batch.num_rows:
                    own, cell = batch.column("vec_id").to_numpy(), batch.column("cell").to_numpy()
                    near = x @ unit(matrix(batch.column("vec"))).T
                    near[ids[:, None] == own[None, :]] = -2
                    take = np.argsort(-near, axis=1)[:, :n]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(ids)), take.shape[1])), pa.array(np.take_along_axis(near, take, 1).ravel()), pa.array(cell[take].ravel())], names=["query", "score", "cell"])

        best = Window.partitionBy("query").orderBy(F.desc("score"))
        found = self.rows.mapInArrow(scan, "query bigint, score double, cell bigint").where("score > -1.5").withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= n)
        cells: list[list[int]] = [[] for _ in ids]
        for r in found.select("query", "cell").collect():  # at most PROBES * n rows
            cells[r["query"]].append(r["cell"])
        return cells

    def wanted(self, queries, recall: float = RECALL) -> int:
        """The candidates that reach ``recall`` of the true neighbours of a sample of the rows that are no queries."""
        lot = (F.xxhash64(F.lit("probe"), "vec_id"), "vec_id")
        drawn = self.rows.where(~F.coalesce(queries, F.lit(False))).orderBy(*lot).limit(PROBES).select("vec_id", "vec").toArrow()
        if not drawn.num_rows:
            drawn = self.asked(queries).orderBy(*lot).limit(PROBES).toArrow()
        if not drawn.num_rows:
            return CANDIDATES
        to1, to2 = self.distances(unit(matrix(drawn["vec"])))
        wanted = [w for i, cells in enumerate(self.true_cells(drawn)) for w in needed(to1[i], to2[i], self.counts, cells)]
        return max(CANDIDATES, int(np.quantile(wanted, recall, method="higher"))) if wanted else CANDIDATES


def quality(df: DataFrame, queries, n: int = 5, recall: float = RECALL, id: str = "vec_id", vector: str = "embedding") -> dict[str, float]:
    """Recall against brute force and the mean share of vectors read, over at most PROBES of the queries; no query takes
    part in tuning unless all rows are queries."""
    index = Index(df, n, id, vector)
    drawn = index.asked(queries).orderBy(F.xxhash64("vec_id"), "vec_id").limit(PROBES).toArrow() if index.total else None
    if drawn is None or not drawn.num_rows:
        return {"recall": 1.0, "share_read": 0.0, "candidates": 0}
    candidates = index.wanted(queries, recall)
    to1, to2 = index.distances(unit(matrix(drawn["vec"])))
    hit = every = read = 0
    for i, cells in enumerate(index.true_cells(drawn)):
        walked = set(walk(to1[i], to2[i], index.counts, candidates))
        hit, every = hit + sum(c in walked for c in cells), every + len(cells)
        read += int(index.counts[list(walked)].sum())
    return {"recall": hit / max(1, every), "share_read": read / index.total / drawn.num_rows, "candidates": candidates}


def nearest_by_lot(index: Index, queries, candidates: int) -> DataFrame:
    """(query_id, vec_id, score): of each lot, the nearest rows found for each query that has cells there."""
    n, result = index.n, "query_id bigint, vec_id bigint, score double"
    counts, size = index.counts, sum(c.shape[1] for c in index.centres)
    per = max(1, min(-(-index.total // LOTS), BLOCK, LOT_BYTES // (8 * size)))  # vectors of a lot
    parts = np.maximum(1, -(-counts // per))
    before = np.cumsum(counts) - counts
    asked = cut(index.asked(queries))
    times = -(-asked.count() * 8 * size // LOT_BYTES)  # beyond LOT_BYTES of queries, each lot meets them in several goes
    sent = index.rows.sparkSession.sparkContext.broadcast((index.half, index.centres, counts, parts, before))  # MOST_CENTROIDS ** 2 numbers, 2 * MOST_CENTROIDS halves

    def spot(vec_id: np.ndarray) -> np.ndarray:
        return vec_id.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)

    def number(batches):
        _, _, counts, parts, before = sent.value
        for batch in batches:
            if batch.num_rows:
                cell = batch.column("cell").to_numpy()
                part = (spot(batch.column("vec_id").to_numpy()) % parts[cell].astype(np.uint64)).astype(np.int64)
                lot = (before[cell] + part * counts[cell] // parts[cell]) // per
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("cell"), pa.array(lot), batch.column("vec")], names=["vec_id", "cell", "lot", "vec"])

    dealt = index.rows.mapInArrow(number, "vec_id bigint, cell bigint, lot bigint, vec array<double>")
    dealt = dealt.withColumn("go", F.lit(0).cast("bigint") if times <= 1 else F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(times - 1).cast("bigint"))))

    def probe(batches):
        half, (one, two), counts, parts, before = sent.value
        for batch in batches:
            if batch.num_rows:
                ids, raw = batch.column("vec_id").to_numpy(), matrix(batch.column("vec"))
                x, go = unit(raw), (spot(ids) % np.uint64(max(1, times))).astype(np.int64)
                to1, to2 = distances(x[:, :half], one), distances(x[:, half:], two)
                for i in range(len(ids)):
                    cells = np.array(walk(to1[i], to2[i], counts, candidates), np.int64)
                    if not len(cells):
                        continue
                    n_parts = parts[cells]
                    cells = np.repeat(cells, n_parts)
                    part = np.arange(len(cells)) - np.repeat(np.cumsum(n_parts) - n_parts, n_parts)
                    lots = (before[cells] + part * counts[cells] // parts[cells]) // per
                    by = np.lexsort((cells, lots))
                    lot, begin = np.unique(lots[by], return_index=True)
                    lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(by)).astype(np.int32)), pa.array(cells[by]))
                    vec = pa.ListArray.from_arrays(pa.array(np.arange(len(lot) + 1, dtype=np.int32) * raw.shape[1]), pa.array(np.tile(raw[i], len(lot))))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(lot), ids[i])), pa.array(lot), pa.array(np.full(len(lot), go[i])), lists, vec], names=["query_id", "lot", "go", "cells", "vec"])

    probes = asked.mapInArrow(probe, "query_id bigint, lot bigint, go bigint, cells array<bigint>, vec array<double>")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        q, v, s = [], [], []
        if left.num_rows and right.num_rows:
            lists = left["cells"].combine_chunks()
            cells = np.split(lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())[:-1])
            q, v, s = rerank(matrix(left["vec"]), left["query_id"].to_numpy(), cells, matrix(right["vec"]), right["vec_id"].to_numpy(), right["cell"].to_numpy(), n)
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.float64())})

    return probes.groupBy("lot", "go").cogroup(dealt.groupBy("lot", "go")).applyInArrow(meet, result)

def search(df: DataFrame, queries, n: int = 5, candidates: int | None = None, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the n nearest rows found for each row that the condition ``queries`` (on vec_id) picks."""
    index = Index(df, n, id, vector)
    if not index.total:
        return df.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    met = nearest_by_lot(index, queries, index.wanted(queries) if candidates is None else candidates)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("query_id", "rank", "vec_id", "score")


def op8_ann_search(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
