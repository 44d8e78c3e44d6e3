"""Line deduplication by a segment-partition edit join (DataFrame operations only).

Texts are cut at line feeds. Two lines are the same if they are equal, or if both have at least ``edit_chars``
characters and ``edits`` or fewer insertions, deletions and substitutions lead from one to the other; classes are the
connected components of that. Of each class the first occurrence stays, by document id, then place; all others
go. Lines of fewer than ``least_chars`` characters (blanks around them not counted) are left alone. Both bounds define what
counts as a line worth comparing and hold at every size of input; 0 compares all lines, empty ones too.

Join: a line of length l is cut into edits + 1 segments of almost equal length, indexed by (l, number, segment). Two
lines within ``edits`` edits share a segment, so a line probes the index of every length from its own down to ``edits`` less,
with the few substrings of itself whose place fits (multi-match-aware). Only keys that two lines share are joined
further. Pairs that can't be links are dropped by two necessary conditions (parities of letter counts; of 2 * edits + 2
segments all but ``edits`` recur within ``edits`` places). All others are decided on the whole lines by a banded bit-parallel
automaton: equal blocks at both ends are stripped, and for every number of errors one word holds, as bits, the diagonals
within ``edits`` of the main one that can be reached. Large groups are searched block by block (``cluster.classes``).

Rows with a null id or text are returned as they are and take no part. Rows that repeat an id and a text are
treated alike; rows that repeat an id with other texts are ordered by a hash of the text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import classes, let
from .common import but, col, cut, delete, hot_join, packed, shared_folder, table

EDITS, EDIT_CHARS, LEAST_CHARS, STRIP, SOON = 2, 24, 10, 16, 32
#: Keys that go to all executors; more are joined by a shuffle.
BROADCAST_KEYS = 2_000_000
#: The places of all lines that go are sent to the documents up to this size; else both are shuffled.
BROADCAST_BYTES = 32 << 20


#: Characters whose numbers are odd or even in a line; one edit changes two of these at most.
COUNTED = "etaonirshdlucmfwypvbgkjqxz ,."


def parities(line: str, size: str) -> Column:
    """A word with a bit for each of COUNTED: whether the line holds an odd number of it."""
    odd = F.lit(0)
    for i, c in enumerate(COUNTED):
        odd = odd + ((F.col(size) - F.char_length(F.replace(F.col(line), F.lit(c), F.lit("")))) % 2) * (1 << i)
    return odd


def recurring(a: Column, b: Column, edits: int) -> Column:
    """How many of 2 * edits + 2 segments of string a occur in string b within ``edits`` places of where a has them."""
    parts, size, n = 2 * edits + 2, F.char_length(a), F.lit(0)
    at = lambda i: F.floor(size * i / parts).cast("int")
    for i in range(parts):
        own, width = F.substring(a, at(i) + 1, at(i + 1) - at(i)), at(i + 1) - at(i)
        hit = F.lit(False)
        for s in sorted(range(-edits, edits + 1), key=abs):
            hit = hit | (F.substring(b, at(i) + 1 + s, width) == own)
        n = n + hit.cast("int")
    return n


def screen(a: Column, b: Column, edits: int) -> Column:
    """Cheap, and true of all pairs (structs line, odd) within ``edits`` edits, though not only of these."""
    return (F.bit_count(a["odd"].bitwiseXOR(b["odd"])) <= 2 * edits) & (recurring(a["line"], b["line"], edits) >= edits + 2)


def keys_of(lines: DataFrame, edits: int) -> DataFrame:
    """(short, key, indexed) of lines (short, line): the keys that a line probes; those of its own segments are indexed."""
    parts, size = edits + 1, F.col("size")
    rows = lines.withColumn("size", F.char_length("line"))
    for i in range(parts):
        # a piece of the line with all places of segment i in lines of up to ``edits`` characters less: short strings are cut fast
        begin = F.greatest(F.lit(0), ((size - edits) / parts).cast("int") * i - edits) if i else F.lit(0)
        rows = rows.withColumn(f"b{i}", begin).withColumn(f"p{i}", F.substring(F.col("line"), begin + 1, ((size / parts).cast("int") + 1) * (i + 1) + 2 * edits - begin))
    keys, indexed = [], []
    for shorter in range(parts):
        length = size - shorter
        base, rest = (length / parts).cast("int"), length % parts
        for i in range(parts):
            long = parts - i  # the last `rest` segments have one character more
            begin = base * i + F.greatest(F.lit(0), rest - long)
            wide = base + F.when(rest >= long, 1).otherwise(0)
            for off in range(max(-i, shorter - (edits - i)), min(i, shorter + edits - i) + 1):
                if shorter == off == 0:
                    indexed.append(len(keys))
                keys.append(F.xxhash64(length, F.lit(i), F.substring(F.col(f"p{i}"), begin + off + 1 - F.col(f"b{i}"), wide)))
    # by number: exploding the array itself would add a filter on its size that computes it once more, without sharing terms
    every = rows.select("short", F.array(*keys).alias("all")).select("short", "all", F.explode(F.sequence(F.lit(0), F.lit(len(keys) - 1))).alias("j"))
    return every.select("short", F.col("all")[F.col("j")].alias("key"), F.col("j").isin(indexed).alias("indexed"))


def equal_blocks(a: Column, b: Column, most: Column, at) -> Column:
    """How many of the first ``most`` blocks of STRIP characters, which begin at at(0), at(1), ..., are equal."""
    same = F.transform(F.sequence(F.lit(0), most - 1), lambda k: F.substring(a, at(k), F.lit(STRIP)) == F.substring(b, at(k), F.lit(STRIP)))
    return F.when(most <= 0, F.lit(0)).otherwise(let(F.array_position(same, False).cast("int"), lambda first: F.when(first == 0, most).otherwise(first - 1)))


def reached(a: Column, b: Column, edits: int) -> Column:
    """Whether ``edits`` edits or fewer lead from a to b, arrays of characters whose sizes differ by no more.

    Bit e of word d, after j characters of b: a's first j + e - edits characters are within d edits of them.
    """
    m, n = F.size(a), F.size(b)
    width = (1 << (2 * edits + 1)) - 1

    def match(c: Column, j: Column) -> Column:
        bits = F.lit(0)
        for e in range(2 * edits + 1):
            at = j + e - edits
            bits = bits.bitwiseOR(F.when((at >= 0) & (at < m) & (F.get(a, at) == c), F.lit(1 << e)).otherwise(F.lit(0)))
        return bits

    start = F.struct(*(F.lit(sum(1 << (edits + i) for i in range(d + 1)) & width).alias(f"w{d}") for d in range(edits + 1)))

    def step(acc: Column, bits: Column) -> Column:
        now = [acc["w0"].bitwiseAND(bits)]
        for d in range(1, edits + 1):
            less = acc[f"w{d - 1}"]
            word = acc[f"w{d}"].bitwiseAND(bits).bitwiseOR(less).bitwiseOR(F.shiftright(less, 1)).bitwiseOR(F.shiftleft(now[-1], 1))
            now.append(word.bitwiseAND(F.lit(width)))
        return F.struct(*(x.alias(f"w{d}") for d, x in enumerate(now)))

    # most pairs that aren't links show it soon: the rest of b is only read if some diagonal is left
    soon = F.aggregate(F.transform(F.slice(b, 1, SOON), match), start, step)
    ends = [F.when(m - n == e - edits, F.lit(1 << e)) for e in range(2 * edits + 1)]

    def rest(acc: Column) -> Column:
        bits = F.transform(F.slice(b, SOON + 1, 1 << 30), lambda c, j: match(c, j + SOON))
        last = F.when(n <= SOON, acc).otherwise(F.aggregate(bits, acc, step))[f"w{edits}"]
        return F.when(acc[f"w{edits}"] == 0, F.lit(False)).otherwise(last.bitwiseAND(F.coalesce(*ends, F.lit(0))) != 0)

    return let(soon, rest)


def within_edits(a: Column, b: Column, edits: int) -> Column:
    """Whether ``edits`` edits or fewer lead from string a to string b: equal blocks at both ends go first."""
    chars = lambda x: F.filter(F.split(x, ""), lambda c: c != "")

    def rest(head: Column, tail: Column) -> Column:
        part = lambda x: chars(F.substring(x, head * STRIP + 1, F.char_length(x) - (head + tail) * STRIP))
        return let(F.struct(part(a).alias("a"), part(b).alias("b")), lambda s: reached(s["a"], s["b"], edits))

    blocks = F.floor(F.least(F.char_length(a), F.char_length(b)) / STRIP).cast("int")
    whole = let(blocks, lambda n: let(equal_blocks(a, b, n, lambda k: k * STRIP + 1), lambda head: let(equal_blocks(a, b, n - head, lambda k: -(k + 1) * STRIP), lambda tail: rest(head, tail))))
    return F.when(F.abs(F.char_length(a) - F.char_length(b)) <= edits, whole).otherwise(F.lit(False))


def near_classes(lines: DataFrame, edits: int, edit_chars: int) -> DataFrame:
    """(id, root) of the lines (line, short) that are near others; id is the line's 128-bit hash, short a 64-bit one."""
    long = lines.where(F.char_length("line") >= edit_chars)
    keyed = keys_of(long, edits)
    often = keyed.groupBy("key").agg(F.count("*").alias("n"), F.max("indexed").alias("indexed")).where("n > 1 AND indexed").select("key")
    often = cut(often)
    members = cut(keyed.join(F.broadcast(often) if often.count() <= BROADCAST_KEYS else often, "key").select("key", "short").distinct())
    few = cut(members.select("short").distinct())
    texts = cut(long.join(F.broadcast(few) if few.count() <= BROADCAST_KEYS else few, "short").select("short", F.md5("line").alias("node"), "line", F.char_length("line").alias("size")).select("short", "node", F.struct("line", parities("line", "size").alias("odd")).alias("value")))
    keyed = members.join(texts.select("short", "node"), "short").select("key", "node")
    found = classes(keyed, texts.select("node", "value"), lambda a, b: screen(a, b, edits), lambda a, b: within_edits(a["line"], b["line"], edits))
    return found.select(F.col("node").alias("id"), "root")


def dedup_lines(docs: DataFrame, edits: int = EDITS, edit_chars: int = EDIT_CHARS, least_chars: int = LEAST_CHARS, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``text`` without its repeated lines, and with ``n_lines`` and ``n_dropped`` (bigint).

    Columns of those names, in any case, are replaced.
    """
    spark = docs.sparkSession
    names = but(docs, "n_lines", "n_dropped")
    part = col(id).isNotNull() & col(text).isNotNull()
    rows = docs.select(packed(docs, names).alias("kept"), F.when(part, col(id)).alias("doc"), F.when(part, F.xxhash64(col(text))).alias("hash"), col(text).alias("text"))
    # outer: else a filter on the array's size is added, which makes the array twice
    cutup = docs.where(part).select(col(id).alias("doc"), F.xxhash64(col(text)).alias("hash"), F.posexplode_outer(F.split(col(text), "\n")).alias("at", "line")).where(F.char_length(F.trim("line")) >= least_chars)
    folder = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    distinct = cutup.groupBy("line").agg(F.count("*").alias("n"))
    distinct.select(F.xxhash64("line").alias("short"), "line", "n").write.option("compression", "zstd").parquet(folder)
    lines = spark.read.schema("short bigint, line string, n bigint").parquet(folder)
    near = near_classes(lines, edits, edit_chars)
    twice = lines.where("n > 1").select(F.md5("line").alias("id"), "n")
    known = cut(twice.join(near, "id", "full").select("id", F.coalesce("root", "id").alias("root"), F.coalesce("n", F.lit(1)).alias("n")))
    delete(spark, folder)
    hashed = cutup.select("doc", "hash", "at", F.md5("line").alias("id"))
    seen = cut(hot_join(hashed, known, "id", "root").where("root IS NOT NULL").select("root", F.struct("doc", "hash", "at").alias("place")))
    first = cut(seen.groupBy("root").agg(F.min("place").alias("first"), F.count("*").alias("n")))
    gone = hot_join(seen, first, "root", "first").where("place <> first").select("place.*")
    gone = cut(gone.groupBy("doc", "hash").agg(F.array_sort(F.collect_set("at")).alias("gone")))
    size = gone.agg(F.sum(F.size("gone") * 4 + 32)).collect()[0][0] or 0
    rows = rows.join(F.broadcast(gone) if size <= BROADCAST_BYTES else gone, ["doc", "hash"], "left")
    count = F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    before, after = F.concat(F.array(F.lit(-1)), F.col("gone")), F.concat(F.col("gone"), F.array(F.col("n_lines").cast("int")))
    left = let(F.split("text", "\n"), lambda ls: F.array_join(F.flatten(F.zip_with(before, after, lambda a, b: F.slice(ls, a + 2, F.greatest(F.lit(0), b - a - 1)))), "\n"))
    rows = rows.withColumn("n_lines", F.when(F.col("doc").isNotNull(), count).otherwise(F.lit(0)).cast("bigint"))
    rows = rows.withColumn("left", F.when(F.col("gone").isNotNull(), left).otherwise(F.col("text")))
    return rows.select(*(F.col("left").alias(c) if c == text else F.col("kept").getField(c).alias(c) for c in names), "n_lines", F.when(F.col("gone").isNotNull(), F.size("gone")).otherwise(0).cast("bigint").alias("n_dropped"))


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.char_length("text").cast("bigint").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))
