"""Benchmark decontamination with a distributed positional inverted index.

Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased. A window is ``width``
consecutive words of a test item; an item of fewer words, but not none, is one window.

Windows and their owners are a table, of any size. Index: one pass over the training texts, for all windows together,
writes the postings (term, row, places) of the texts' terms, a term being a 64-bit hash of its word. For exact phrases a
place is stored only if it lies in a run of words whose neighbours are neighbours in some window too, and which is as long
as a window; no phrase is lost by that, and a text that shares only common words stores next to nothing. Which neighbours
these are the pass reads from bitmaps of hashes, of at most ``2 ** MOST_BITS`` bits whatever the windows are; a full
bitmap stores more, but loses nothing.

Search: each window looks up the postings of its rarest term (by places in the index) and shifts them by the term's
offset to starts of the phrase. The postings of its other terms in the same row join it, and starts at which all the
offset-adjusted lists agree remain, intersected rarest first by hashed sets. With ``slack`` > 0 the index is thinned by terms alone and
each word may lie up to ``slack`` places from where the phrase puts it (proximity).

A row is known by its id and its text, so rows that repeat both are searched alike. Null texts have no words; test items
with a null id take no part; rows that repeat an item id are parts of one item. Rows of documents are kept one for one, with
repeated and null ids; ids may be of any type that can be cast to a string.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_bpe import _sizes, _steps
from .common import col, cut, spread, table
from .minhash import Hashes, mix

WIDTH = 10
#: Bits of a bitmap: 2 ** MOST_BITS at most, and BITS_A_HASH for each hash in it if that is less.
MOST_BITS, BITS_A_HASH = 27, 64
#: Windows, and rows with hits, that are joined by broadcast; more are joined by shuffles.
BROADCAST_WINDOWS, BROADCAST_ROWS = 100_000, 100_000
_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Kinds of bitmaps: neighbours in windows of full width, neighbours in shorter ones, terms that are stored wherever they are.
LONG, SHORT, TERM = 0, 1, 2


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_KEEP).split() if text else []


def neighbours(h: np.ndarray) -> np.ndarray:
    """A hash of each term and the next one."""
    return mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])


def windows_of(benchmark: DataFrame, width: int) -> DataFrame:
    """(item, window, length, terms) of the windows of each item, a row for each place; window is a 128-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for batch in _steps(batches, _sizes("text")):
            items, ids, lengths, terms = [], [], [], []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                w = words_of(text)
                h = known.of(w).view(np.int64).tolist()
                for i in range(max(1, len(w) - width + 1) if w else 0):
                    items.append(item)
                    ids.append(xxhash.xxh3_128_hexdigest(b" ".join(w[i : i + width])))
                    lengths.append(len(w[i : i + width]))
                    terms.append(h[i : i + width])
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(ids, pa.string()), pa.array(lengths, pa.int32()), pa.array(terms, pa.list_(pa.int64()))], names=["item", "window", "length", "terms"])

    known = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("string").alias("item"), "text")
    return cut(known.mapInArrow(run, "item string, window string, length int, terms array<bigint>"))


def bitmaps(windows: DataFrame, width: int, slack: int) -> dict[int, np.ndarray]:
    """For each kind the bits of its hashes, as bytes; a kind without hashes is left out. The driver gets the bitmaps, no hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, found = [np.empty(0, np.int32)], [np.empty(0, np.uint64)]
            for terms in batch.column("terms").to_pylist():
                h = np.array(terms, np.int64).view(np.uint64)
                own = mix(h) if slack or len(h) == 1 else neighbours(h)
                kinds.append(np.full(len(own), TERM if slack or len(h) == 1 else LONG if len(h) == width else SHORT, np.int32))
                found.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(kinds)), pa.array(np.concatenate(found).view(np.int64))], names=["kind", "hash"])

    hashes = cut(windows.select("window", "terms").dropDuplicates(["window"]).select("terms").mapInArrow(run, "kind int, hash bigint").distinct())
    out = {}
    for kind, n in sorted(hashes.groupBy("kind").count().collect()):
        bits = min(MOST_BITS, max(15, int(np.ceil(np.log2(n * BITS_A_HASH)))))
        at = F.shiftrightunsigned(F.col("hash"), 64 - bits)
        parts = hashes.where(F.col("kind") == kind).groupBy(F.shiftright(at, 15).alias("part")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit((1 << 15) - 1))).alias("bits"))
        whole = np.zeros(1 << bits - 3, np.uint8)
        for r in parts.toLocalIterator():  # at most 2 ** (MOST_BITS - 15) rows of 4 KB
            whole[r["part"] << 12 : (r["part"] << 12) + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
        out[kind] = whole
    return out


def holds(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> np.uint64(64 - (len(bits).bit_length() + 2))
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def stored(h: np.ndarray, ends: np.ndarray, maps: dict[int, np.ndarray], width: int) -> np.ndarray:
    """The places to store of texts given as term hashes, one after the other up to ``ends``."""
    keep = holds(maps[TERM], mix(h)) if TERM in maps else np.zeros(len(h), bool)
    if len(h) > 1 and (LONG in maps or SHORT in maps):
        key, last = neighbours(h), ends[(ends > 0) & (ends < len(h))] - 1
        for kind in (SHORT, LONG):
            if kind in maps:
                hit = holds(maps[kind], key)
                hit[last] = False  # the last word of a text and the first of the next
                near = np.flatnonzero(hit)
                if kind == LONG and len(near):
                    begin = np.flatnonzero(np.diff(near, prepend=-2) != 1)
                    length = np.diff(np.append(begin, len(near)))
                    near = near[np.repeat(length >= width - 1, length)]
                keep[near] = True
                keep[near + 1] = True
    return np.flatnonzero(keep)


def index_of(docs: DataFrame, maps: dict[int, np.ndarray], width: int) -> DataFrame:
    """Rows (row, doc_id, text_hash, n_words) of every text (doc_id, text, text_hash), and its postings (row, term, places); written."""
    sent = docs.sparkSession.sparkContext.broadcast(maps)  # three bitmaps of at most 2 ** MOST_BITS bits
    kinds = [T.StructField("row", T.StringType()), docs.schema["doc_id"], T.StructField("text_hash", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("term", T.LongType()), T.StructField("places", T.ArrayType(T.IntegerType(), False))]
    row = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text_hash").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for batch in _steps(batches, _sizes("text")):
            words: list[bytes] = []
            n_words = []
            for text in batch.column("text").to_pylist():
                own = words_of(text)
                words += own
                n_words.append(len(own))
            h, ends = known.of(words), np.cumsum(n_words)
            at = stored(h, ends, sent.value, width)
            doc = np.searchsorted(ends, at, "right")
            order = np.lexsort((at, h[at], doc))
            at, doc = at[order], doc[order]
            begin = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(h[at], prepend=h[at][:1]) != 0))
            owner, terms = doc[begin], h[at][begin].view(np.int64)
            n, m = batch.num_rows, len(begin)
            every = pa.array(np.concatenate([np.arange(n), owner]), pa.int64())
            sizes = np.diff(np.append(begin, len(at)))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([np.zeros(n + 1, np.int64), np.cumsum(sizes)]).astype(np.int32)), pa.array((at - (ends - n_words)[doc]).astype(np.int32)))
            only = lambda c: pa.concat_arrays([batch.column(c), pa.nulls(m, batch.column(c).type)])
            yield pa.RecordBatch.from_arrays([batch.column("row").take(every), only("doc_id"), only("text_hash"), pa.array(n_words + [None] * m, pa.int64()), pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(terms)]), lists], names=["row", "doc_id", "text_hash", "n_words", "term", "places"])

    return cut(docs.select(row.alias("row"), "doc_id", "text_hash", "text").mapInArrow(run, T.StructType(kinds)))


def search(postings: DataFrame, windows: DataFrame, slack: int = 0) -> DataFrame:
    """(row, window, length, starts): the starts of every window (window, length, terms) in every indexed text."""
    counts = postings.groupBy("term").agg(F.sum(F.size("places")).alias("n"))
    parts = windows.select("window", "length", F.posexplode("terms").alias("offset", "term"))
    known = parts.join(counts, "term").groupBy("window", "length").agg(F.array_sort(F.collect_list(F.struct("n", "offset", "term"))).alias("terms"))
    # rarest first; a window with a term that no text has can't occur
    wanted = cut(known.where(F.size("terms") == F.col("length")).select("window", "length", "terms", F.col("terms")[0]["term"].alias("term"), F.col("terms")[0]["offset"].alias("offset")))
    few = wanted.count() <= BROADCAST_WINDOWS
    one = F.broadcast(wanted) if few else wanted
    starts = F.array_distinct(F.filter(F.transform("places", lambda p: p - F.col("offset")), lambda s: s + F.col("length") > 0))
    starts = starts if slack else F.filter(starts, lambda s: s >= 0)
    first = cut(postings.join(one, "term").select("row", "window", "length", F.col("terms").alias("rest"), starts.alias("starts")).where(F.size("starts") > 0).distinct())
    others = first.where("length > 1").select("row", "window", F.posexplode(F.slice("rest", 2, 1 << 30)).alias("nth", "other")).select("row", "window", "nth", F.col("other.term").alias("term"), F.col("other.offset").alias("offset"))
    # the other terms' postings in rows that have the rarest one
    put = F.flatten(F.transform("places", lambda p: F.sequence(p - F.col("offset") - slack, p - F.col("offset") + slack))) if slack else F.transform("places", lambda p: p - F.col("offset"))
    lists = others.join(postings, ["row", "term"]).select("row", "window", F.struct("nth", put.alias("starts")).alias("list"))
    lists = lists.groupBy("row", "window").agg(F.array_sort(F.collect_set("list")).alias("lists"))
    met = first.where("length > 1").join(lists, ["row", "window"]).where(F.size("lists") == F.col("length") - 1)
    agreed = F.aggregate("lists", F.col("starts"), lambda left, x: F.when(F.size(left) == 0, left).otherwise(F.array_intersect(left, x["starts"])))
    met = met.select("row", "window", "length", agreed.alias("starts")).where(F.size("starts") > 0)
    return met.unionByName(first.where("length = 1").select("row", "window", "length", "starts"))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, slack: int = 0, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, text_hash), a row for each row of ``docs``.

    items_sha256 is of the ids of the items found, sorted as strings and joined by commas; of the empty string if none.
    With ``slack``, the words from the phrase's start to its length count as hit.
    """
    docs = spread(docs.select(col(id).alias("doc_id"), col(text).alias("text"), F.xxhash64(col(text)).alias("text_hash")))
    windows = windows_of(benchmark, width)
    index = index_of(docs, bitmaps(windows, width, slack), width)
    total = index.where("term IS NULL").select("row", "doc_id", "text_hash", "n_words")
    postings = index.where("term IS NOT NULL").select("row", "term", "places")  # repeated rows have the same ones, again
    found = cut(search(postings, windows.select("window", "length", "terms").dropDuplicates(["window"]), slack))
    spans = found.select("row", F.explode(F.transform("starts", lambda s: F.struct(F.greatest(s, F.lit(0)).alias("start"), (s + F.col("length")).alias("end")))).alias("span"))
    spans = spans.groupBy("row").agg(F.array_sort(F.collect_set("span")).alias("spans"))
    items = found.select("row", "window").join(windows.select("item", "window").distinct(), "window").select("row", "item").distinct().groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    # spans in order of start: each adds what lies beyond the end reached so far
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n")), lambda a, s: F.struct(F.greatest(a["end"], s["end"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["end"], s["start"]))).alias("n")), lambda a: a["n"])
    own = cut(spans.select("row", covered.alias("n_hit")).join(items, "row"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return total.join(F.broadcast(own) if own.count() <= BROADCAST_ROWS else own, "row", "left").select(
        "doc_id",
        "n_words",
        F.least("n_words", F.coalesce("n_hit", F.lit(0))).alias("n_hit"),
        F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        "text_hash",
    )


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
g AS (SELECT DISTINCT item_id, least(10, len(words)) AS n, array_to_string(words[i:i + 9], ' ') AS gram
      FROM (SELECT *, unnest(range(1, greatest(1, len(words) - 9) + 1)) AS i FROM b WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT n FROM g),
d AS (SELECT doc_id, n, i, array_to_string(words[i:i + n - 1], ' ') AS gram
      FROM (SELECT w.*, n, unnest(range(1, len(words) - n + 2)) AS i FROM w, sizes WHERE len(words) >= n)),
h AS (SELECT d.doc_id, d.i, d.n, g.item_id FROM d JOIN g USING (n, gram)),
p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)"""
