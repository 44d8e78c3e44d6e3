"""MinHash near-duplicates by fast similarity sketching, banding and exact verification.

A document's set holds its distinct w-word shingles (words: runs of anything but ASCII white space, A-Z
lower-cased); a text of fewer words has its whole sequence as one shingle; one without words has none and is
linked with nothing. Documents are linked if 100 * |A n B| >= percent * |A u B|.

Sketch (``BINS`` coordinates): in round i < BINS every element falls into a bin that its hash picks, in round
BINS + i all fall into bin i; a bin keeps the smallest (round, hash). A document stops after the first round
with all bins full, which 2 * BINS rounds guarantee. Bands of ``ROWS`` coordinates give candidate groups: a
pair at similarity 0.8 is missed with probability (1 - 0.8**ROWS) ** (BINS / ROWS), below 4e-6 with 5 and 160.
Candidates are confirmed on the full sets of 64-bit shingle hashes.

Documents with equal sets are one node (128-bit sum of their hashes), so copies never meet in pairs. In a group of
nodes that share a band, the first meets all others; if the group is then one class, it is done. Otherwise every pair
of different classes is verified, pair by pair in small groups; in large ones block by block inside tasks, where
only nodes outside the largest class meet all, so no row for each pair is made. Sizes and 2-bit sketches drop pairs
that are far from the threshold (6 standard deviations) before their sets are read. Rows with a null id take no part: their component is null and they are
kept. Rows that repeat an id are documents of their own that carry the same id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .byte_bpe import _sizes, _steps
from .cluster import components
from .common import col, cut, hot_join, spread, table

BINS, ROWS = 160, 5
#: 64-bit words of two sketch bits a coordinate, and how far below its mean the agreement of a linked pair may lie.
WORDS, SIGMAS = BINS // 32, 6
#: Groups of up to SMALL nodes are searched pair by pair; larger ones in blocks of BLOCK nodes.
SMALL, BLOCK = 16, 256
_FULL = np.uint64(2**64 - 1)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes(dict):
    """Word to 64-bit hash. The words met first are remembered, which are the frequent ones; all over again after many others."""

    MOST, PATIENCE = 200_000, 3_000_000

    def __init__(self) -> None:
        self.missed = 0

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.MOST:
            self[word] = h
        else:
            self.missed += 1
            if self.missed > self.PATIENCE:
                self.missed = 0
                self.clear()
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class Shingler:
    def __init__(self, words: int) -> None:
        self.words, self.known = words, Hashes()

    def sets(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The distinct shingle hashes of all texts, each text's sorted, and the offsets of texts."""
        w, parts = self.words, []
        for text in texts:
            words = text.encode("utf-8", "replace").lower().split() if text else []
            if not words:
                parts.append(np.empty(0, np.uint64))
                continue
            h = self.known.of(words)
            k = min(w, len(h))
            s = np.full(len(h) - k + 1, k, np.uint64)
            for i in range(k):
                s = mix(s * _GOLD + h[i : len(h) - k + 1 + i])
            parts.append(np.unique(s))
        return np.concatenate([np.empty(0, np.uint64), *parts]), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def sums(flat: np.ndarray, offsets: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit fingerprint of each set."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(flat ^ np.uint64(salt)), dtype=np.uint64)])
    return mix(total[offsets[1:]] - total[offsets[:-1]] + np.diff(offsets).astype(np.uint64) * _GOLD).view(np.int64)


def sketch(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """[texts, BINS]; empty sets keep the value of an empty bin."""
    n = len(offsets) - 1
    bins = np.full(n * BINS, _FULL, np.uint64)
    row, item = np.repeat(np.arange(n), np.diff(offsets)), flat
    for i in range(2 * BINS):
        if not len(item):
            break
        h = mix(item + np.uint64((i + 1) * int(_GOLD) & 2**64 - 1))
        at = (h >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32) if i < BINS else np.full(len(h), i - BINS, np.uint64)
        np.minimum.at(bins, row * BINS + at.astype(np.int64), np.uint64(i) << np.uint64(40) | h & np.uint64(2**32 - 1))
        live = np.unique(row)
        open_ = np.zeros(n, bool)
        open_[live] = (bins.reshape(n, BINS)[live] == _FULL).any(1)
        keep = open_[row]
        if not keep.all():
            row, item = row[keep], item[keep]
    return bins.reshape(n, BINS)


def bands(sketches: np.ndarray) -> np.ndarray:
    """[texts, BINS / ROWS] keys."""
    parts = sketches.reshape(len(sketches), BINS // ROWS, ROWS)
    key = np.broadcast_to(np.arange(1, BINS // ROWS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(ROWS):
        key = mix(key * _GOLD + parts[:, :, i])
    return key.view(np.int64)


def _list(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat, pa.int64()))


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, text_hash, n, fp1, fp2, bands, sketch words) of rows (doc_id, text, text_hash); fingerprints are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in _steps(batches, _sizes("text")):
            flat, offsets = shingler.sets(batch.column("text").to_pylist())
            n = np.diff(offsets)
            none = n == 0
            drawn = sketch(flat, offsets)
            keys = bands(drawn)
            ends = np.concatenate([[0], np.cumsum(np.where(none, 0, keys.shape[1]))])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(n), *(pa.array(sums(flat, offsets, s), mask=none) for s in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179)), _list(keys[~none].ravel(), ends), *map(pa.array, attributes(drawn))],
                names=["doc_id", "text_hash", "n", "fp1", "fp2", "bands", *(f"s{i}" for i in range(WORDS))],
            )

    return spread(docs.select("doc_id", "text", "text_hash")).mapInArrow(run, "doc_id bigint, text_hash bigint, n bigint, fp1 bigint, fp2 bigint, bands array<bigint>, " + ", ".join(f"s{i} bigint" for i in range(WORDS)))


def full_sets(rows: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of rows (doc_id, text, fp1, fp2) whose text has those fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in _steps(batches, _sizes("text")):
            flat, offsets = shingler.sets(batch.column("text").to_pylist())
            same = np.ones(batch.num_rows, bool)
            for name, salt in (("fp1", 0x1F83D9ABFB41BD6B), ("fp2", 0x5BE0CD19137E2179)):
                same &= sums(flat, offsets, salt) == batch.column(name).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _list(flat.view(np.int64), offsets)], names=["node", "shingles"]).filter(pa.array(same))

    return rows.select("doc_id", "text", "fp1", "fp2").mapInArrow(run, "node bigint, shingles array<bigint>")


def attributes(sketches: np.ndarray) -> list[np.ndarray]:
    """``WORDS`` 64-bit words for each set with 2 bits of each coordinate."""
    bits = (mix(sketches) >> np.uint64(7) & np.uint64(3)).reshape(len(sketches), WORDS, 32)
    return [(bits[:, i] << (2 * np.arange(32, dtype=np.uint64))).sum(1, dtype=np.uint64).view(np.int64) for i in range(WORDS)]


def alike(a: str, b: str, percent: int) -> Column:
    """Whether sizes and sketches of two nodes (structs) allow a similarity of ``percent``.

    Two equal coordinates agree in their 2 bits, two others in one of 4 cases, so of BINS coordinates at similarity s
    BINS * (1 + 3s) / 4 agree on average. A pair passes with ``SIGMAS`` standard deviations less.
    """
    s = (1 + 3 * percent / 100) / 4
    least = int(BINS * s - SIGMAS * (BINS * s * (1 - s)) ** 0.5)
    differ = F.lit(0)
    for i in range(WORDS):
        x = F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))
        differ = differ + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (differ <= BINS - least)


def links_in(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """[left, right]: which pairs of sets are linked, by products of incidence matrices over the shared shingles."""
    one, two = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(one, two)
    both = np.zeros((len(left), len(right)), np.float64)
    rows = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right)]
    cols = [np.minimum(np.searchsorted(shared, x), max(0, len(shared) - 1)) for x in (one, two)]
    for at in range(0, len(shared), 4096):
        parts = []
        for k, (x, sets) in enumerate(((one, left), (two, right))):
            ok = (shared[cols[k]] == x) & (cols[k] >= at) & (cols[k] < at + 4096)
            m = np.zeros((len(sets), min(4096, len(shared) - at)), np.float32)
            m[rows[k][ok], cols[k][ok] - at] = 1
            parts.append(m)
        both += parts[0] @ parts[1].T
    n, m = (np.array([len(s) for s in x], np.float64) for x in (left, right))
    return 100 * both >= percent * (n[:, None] + m[None, :] - both)


def blockwise(large: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between nodes of different roots in large groups (key, node, root), without a row for each pair.

    Nodes outside their group's largest class meet all nodes of the group, in blocks of about ``BLOCK`` on either side;
    a task has two blocks' sets.
    """
    sizes = large.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "root")).alias("top"), F.sum("c").alias("m"))
    sizes = cut(sizes.select("key", F.col("top.root").alias("main"), F.ceil((F.col("m") - F.col("top.c")) / BLOCK).alias("lefts"), F.ceil(F.col("m") / BLOCK).alias("rights")))
    rows = large.join(sizes, "key")
    lot = lambda n: F.pmod(F.xxhash64(F.lit("block"), "node"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    left = rows.where("root <> main").select("key", lot("lefts").alias("i"), every("rights").alias("j"), "node", "root")
    right = rows.where("lefts > 0").select("key", lot("rights").alias("j"), every("lefts").alias("i"), "node", "root").select("key", "i", "j", "node", "root")

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        found: tuple[list, list] = ([], [])
        if a.num_rows and b.num_rows:
            sa, sb = (np.split(x.combine_chunks().flatten().to_numpy(), np.cumsum(x.combine_chunks().value_lengths().to_numpy())[:-1]) for x in (a["a_shingles"], b["b_shingles"]))
            na, nb, ra, rb = (t[c].to_numpy() for t, c in ((a, "a_node"), (b, "b_node"), (a, "a_root"), (b, "b_root")))
            for x, y in zip(*np.nonzero(links_in(sa, sb, percent) & (ra[:, None] != rb[None, :])), strict=True):
                found[0].append(min(na[x], nb[y]))
                found[1].append(max(na[x], nb[y]))
        return pa.table({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64())})

    sides = [x.join(sets, "node").select(*(F.col(c).alias(f"{side}_{c}") for c in ("key", "i", "j", "node", "root", "shingles"))) for side, x in (("a", left), ("b", right))]
    left, right = (x.groupBy(*(f"{side}_{c}" for c in ("key", "i", "j"))) for side, x in zip("ab", sides, strict=True))
    return left.cogroup(right).applyInArrow(meet, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash), a row for each row of ``docs``; ids are whole numbers."""
    docs = docs.select(col(id).cast("bigint").alias("doc_id"), col(text).alias("text"), F.xxhash64(col(text)).alias("text_hash"))
    signed = cut(signatures(docs, words))
    owned = signed.where("fp1 IS NOT NULL AND doc_id IS NOT NULL")
    nodes = cut(owned.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")))
    own = owned.join(nodes.select("fp1", "fp2", F.col("node").alias("doc_id")), ["fp1", "fp2", "doc_id"], "left_semi").dropDuplicates(["doc_id", "fp1", "fp2"])
    traits = F.struct("n", *(f"s{i}" for i in range(WORDS))).alias("t")
    own = cut(own.select(F.col("doc_id").alias("node"), "fp1", "fp2", "bands", traits))
    members = own.select(F.explode("bands").alias("key"), "node")
    shared = members.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    members = cut(members.join(shared, "key").join(own.select("node", "t"), "node"))
    wanted = members.select("node").distinct().join(own.select("node", "fp1", "fp2"), "node")
    sets = cut(full_sets(docs.join(wanted.withColumnRenamed("node", "doc_id"), "doc_id"), words))

    def verify(pairs: DataFrame) -> DataFrame:
        a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
        b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
        both = F.size(F.array_intersect("sa", "sb"))
        return cut(pairs.join(a, "a").join(b, "b").where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b").distinct())

    def pairs(met: DataFrame, condition: Column) -> DataFrame:
        met = met.where(condition & alike("l.t", "r.t", percent))
        return met.select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b")).distinct()

    # every group's first node meets the others; most groups are then one class
    hubs = cut(members.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("node", "t")).alias("l")))
    met = hot_join(members.select("key", F.struct("node", "t").alias("r")), hubs, "key", "l")
    tried = cut(pairs(met, F.col("l.node") < F.col("r.node")))
    links = verify(tried)
    labels = components(links)
    # what is left in groups of several classes: pair by pair in small groups, block by block in large ones
    labelled = members.join(labels, "node", "left").select("key", "node", "t", F.coalesce("root", "node").alias("root"))
    opened = labelled.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("m")).where("least <> most AND m > 2").select("key", "m")
    labelled = cut(labelled.join(opened, "key"))
    small, large = labelled.where(F.col("m") <= SMALL), labelled.where(F.col("m") > SMALL)
    both = small.alias("l").join(small.alias("r"), F.col("l.key") == F.col("r.key"))
    rest = pairs(both, (F.col("l.node") < F.col("r.node")) & (F.col("l.root") != F.col("r.root"))).join(tried, ["a", "b"], "left_anti")
    more = cut(verify(rest).unionByName(blockwise(large.select("key", "node", "root"), sets, percent)))
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    rooted = cut(nodes.join(labels, "node", "left").select(F.struct("fp1", "fp2").alias("fp"), "n", F.coalesce("root", "node").alias("root")))
    signed = signed.select("doc_id", "text_hash", "n", F.when(F.col("fp1").isNotNull() & F.col("doc_id").isNotNull(), F.struct("fp1", "fp2")).alias("fp"))
    out = hot_join(signed, rooted, "fp", "root")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "text_hash")


def op10_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4).drop("text_hash")
