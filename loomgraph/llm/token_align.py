"""Alignment of two tokenizers: where both end a token, what they make of the bytes between, and how often which tokens meet.

A is a byte-level BPE of the tokenizers library, B a sentencepiece model that puts a space before a text. Inside ``mapInPandas``
a two-pointer merge of the cumulative token ends cuts both token lists at byte offsets where both end (groups); the last tokens
of a group end together and are its link. Spark counts the links of a pair of ids over the corpus, and joins the counts and
the highest counts of either side back to the texts.

A text is space + text for both; special tokens' strings are plain text. Null and empty texts, and texts whose tokens' bytes
don't join to space + text on both sides (B writes U+2581 as a space), have no tokens. Rows are kept one for one, repeated
ones and those without an id included.

Where both tokenizers allow it, a text is cut before single spaces, and distinct cuts are encoded once and kept in a bounded
cache of the worker: neither has a token that goes on across such a space, so merges on its two sides don't depend on each other.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import gather
from .common import col, cut, delete, hot_join, shared_folder, spread, table

#: Characters that one step holds, and the cache's limits: cut texts, and their characters.
STEP_CHARS, CACHED, CACHED_CHARS = 1 << 20, 250_000, 8 << 20
_ODD = re.compile(r" (?=\s|\Z)")
_CUT = re.compile(r"(?<! )(?= \S)")
#: Letters and end marks that A's pattern surely splits as one run of letters and one of others.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([,.;:!?]*)").fullmatch
#: The space of pieces, and the letters that byte-level tokenizers write bytes as.
BAR = "▁"
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
LETTER_OF = dict(zip(_SHOWN, map(chr, _SHOWN), strict=True)) | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in _SHOWN)}


def groups(a: list[int], b: list[int], size_a: list[int], size_b: list[int]) -> list[tuple[list[int], list[int]]]:
    """The two pointers: token lists of the same bytes, cut at the offsets where both end. Sizes are bytes by id, none 0."""
    out = []
    i = j = begin_i = begin_j = end_a = end_b = 0
    while i < len(a) or end_b < end_a:
        if end_a <= end_b:
            end_a += size_a[a[i]]
            i += 1
        else:
            end_b += size_b[b[j]]
            j += 1
        if end_a == end_b:
            out.append((a[begin_i:i], b[begin_j:j]))
            begin_i, begin_j = i, j
    return out


class Aligner:
    """One worker's tokenizers and cache."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a_piece = self.a.model.tokenize
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte_of = {c: b for b, c in LETTER_OF.items()}
        tokens = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(tokens.values(), default=-1) + 1)
        for token, n in tokens.items():
            self.a_bytes[n] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(BAR, " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = [len(x) for x in self.a_bytes], [len(x) for x in self.b_bytes]
        self.a_said, self.b_said = [str(i) for i in range(len(self.a_size))], [str(i) for i in range(len(self.b_size))]
        how = json.loads(self.a.to_str())
        split = how["pre_tokenizer"] or {}
        self.cuts = how["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not any(BAR in p.lstrip(BAR) for p in pieces)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        self.text: list[str] = []
        self.bad: set[int] = set()
        self.n_a, self.n_b = np.empty(0, np.int64), np.empty(0, np.int64)
        self.flat, self.start, self.length = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def _word(self, word: str) -> list[int]:
        """A's ids of one piece of its pattern."""
        return [t.id for t in self.a_piece(word.encode().decode("latin-1").translate(LETTER_OF))]

    def _a(self, texts: list[str]) -> list[list[int]]:
        """A's ids of space + each text."""
        out: list[list[int]] = []
        odd: list[int] = []
        for i, text in enumerate(texts):
            plain = _PLAIN(text) if self.cuts else None
            if plain is None:
                odd.append(i)
                out.append([])
            else:
                out.append(self._word(" " + plain[1]) + self._word(plain[2]) if plain[2] else self._word(" " + plain[1]))
        for i, got in zip(odd, self.a.encode_batch_fast([" " + texts[i] for i in odd], add_special_tokens=False), strict=True):
            out[i] = got.ids
        return out

    def _join(self, a: list[int], b: list[int]) -> tuple[str, list[int]]:
        """A text's groups as written out, and its links as numbers."""
        said_a, said_b, said, links = self.a_said, self.b_said, [], []
        for x, y in groups(a, b, self.a_size, self.b_size):
            i, j = x[-1], y[-1]
            links.append(i << 32 | j)
            left = said_a[i] if len(x) == 1 else ",".join([said_a[t] for t in x])
            said.append(f"{left}|{said_b[j] if len(y) == 1 else ','.join([said_b[t] for t in y])}")
        return ";".join(said), links

    def _learn(self, new: list[str]) -> None:
        """Align cut texts that are met first."""
        n_a, n_b, length, flat = [], [], [], []
        for text, a, b in zip(new, self._a(new), self.b.encode(new, num_threads=1), strict=True):
            whole = b" " + text.encode()
            if b"".join([self.a_bytes[t] for t in a]) == whole and b"".join([self.b_bytes[t] for t in b]) == whole:
                said, links = self._join(a, b)
            else:
                self.bad.add(len(self.text))
                said, links = "", []
            self.text.append(said)
            n_a.append(len(a))
            n_b.append(len(b))
            length.append(len(links))
            flat += links
        size = np.array(length, np.int64)
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.length, self.flat = np.concatenate([self.length, size]), np.concatenate([self.flat, np.array(flat, np.int64)])
        self.n_a, self.n_b = np.concatenate([self.n_a, np.array(n_a, np.int64)]), np.concatenate([self.n_b, np.array(n_b, np.int64)])

    def _parts(self, text: str) -> list[str]:
        """A text without its spaces where it can be cut: each part stands for space + part."""
        if not self.cuts:
            return [text]
        whole = " " + text
        if _ODD.search(whole):
            return [p[1:] for p in _CUT.split(whole) if p]
        return text.split(" ")

    def align(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, str, np.ndarray, np.ndarray]]:
        """(n_a, n_b, n_groups, groups, pairs, how often each) of every text."""
        if len(self.known) > CACHED or self.chars > CACHED_CHARS:
            self.forget()
        known, new, rows = self.known, [], []
        for text in texts:
            row = []
            for part in self._parts(text) if text else ():
                at = known.get(part)
                if at is None:
                    at = known[part] = len(known)
                    new.append(part)
                    self.chars += len(part)
                row.append(at)
            rows.append(row)
        self._learn(new)
        none = np.empty(0, np.int64)
        for text, row in zip(texts, rows, strict=True):
            if not row or not self.bad.isdisjoint(row):
                yield (0, 0, 0, "", none, none) if not row else self._whole(text)
                continue
            at = np.array(row)
            pairs, times = np.unique(gather(self.flat, self.start[at], self.length[at]), return_counts=True)
            yield int(self.n_a[at].sum()), int(self.n_b[at].sum()), int(times.sum()), ";".join([self.text[i] for i in row]), pairs, times

    def _whole(self, text: str) -> tuple[int, int, int, str, np.ndarray, np.ndarray]:
        """A text with a part whose bytes differ, whole: the parts' bytes might make up for each other."""
        a, b, bytes_ = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text), b" " + text.encode()
        if b"".join([self.a_bytes[t] for t in a]) != bytes_ or b"".join([self.b_bytes[t] for t in b]) != bytes_:
            none = np.empty(0, np.int64)
            return 0, 0, 0, "", none, none
        said, links = self._join(a, b)
        pairs, times = np.unique(np.array(links, np.int64), return_counts=True)
        return len(a), len(b), len(links), said, pairs, times


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def align(df: DataFrame, a_path: str, b_path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, groups, pairs, times) of every row.

    groups: ``a1,a2|b1;a3|b2,b3``, decimal ids in order. pairs: distinct links, A's id times 2^32 plus B's, and how many
    the text has of each. A token has bytes, so each group has one link.
    """
    kind = df.schema[id].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = _ALIGNERS.get((a_path, b_path)) or _ALIGNERS.setdefault((a_path, b_path), Aligner(a_path, b_path))
        for frame in frames:
            texts = frame["text"].tolist()
            ends = np.cumsum([len(t) if t else 0 for t in texts])
            at = 0
            while at < len(texts):
                end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP_CHARS, "right")))
                out = pd.DataFrame(list(aligner.align(texts[at:end])), columns=["n_a", "n_b", "n_groups", "groups", "pairs", "times"])
                yield pd.concat([frame[["id"]].iloc[at:end].reset_index(drop=True), out], axis=1)
                at = end

    rows = df.select(col(id).alias("id"), col(text).alias("text"))
    return spread(rows).mapInPandas(run, f"id {kind}, n_a bigint, n_b bigint, n_groups bigint, groups string, pairs array<bigint>, times array<bigint>")


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, n, of: (count, top_a, top_b)) from links (pair, times): a pair's links over the corpus, and whether no other pair of
    its A id, or of its B id, has more. A side's highest count is joined by its id, which has as many pairs as the other side has
    tokens at most."""
    counts = cut(links.groupBy("pair").agg(F.sum("times").alias("n")))
    counts = counts.withColumn("a", F.shiftright("pair", 32)).withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    most = lambda side: counts.groupBy(side).agg(F.max("n").alias(f"most_{side}"))
    both = counts.join(most("a"), "a").join(most("b"), "b")
    return both.select("pair", "n", F.struct(F.col("n").alias("count"), (F.col("n") == F.col("most_a")).alias("top_a"), (F.col("n") == F.col("most_b")).alias("top_b")).alias("of"))


def link_figures(rows: DataFrame) -> DataFrame:
    """``rows`` (row, pairs, times, ...) without pairs and times, with n_links, n_best (links whose pair is B's most frequent one)
    and count_sum (the links' counts over the corpus, summed). row: a number of its own for each.

    A text has a row for each of its distinct pairs in between. Up to ``FEW`` pairs their counts are broadcast; of more, those with
    over ``HOT`` links, and the others are joined by shuffle.
    """
    links = rows.select("row", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("times"))))
    counted = hot_join(links, cut(pair_counts(links)), "pair", "of")
    sums = counted.groupBy("row").agg(F.sum("times").alias("n_links"), F.sum(F.when(F.col("of.top_b"), F.col("times"))).alias("n_best"), F.sum(F.col("times") * F.col("of.count")).alias("count_sum"))
    kept = [c for c in rows.columns if c not in ("pairs", "times")]
    none = F.lit(0).cast("bigint")
    return rows.select(*kept).join(sums, "row", "left").select(*kept, *(F.coalesce(c, none).alias(c) for c in ("n_links", "n_best", "count_sum")))


def align_documents(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document."""
    import public_tokenizers

    spark = docs.sparkSession
    found = align(docs, a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    found = found.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", digest.alias("groups_sha256"), "pairs", "times", F.monotonically_increasing_id().alias("row"))
    # as a table: columns of pairs are small in Parquet, and the last join doesn't read them
    folder = f"{shared_folder(spark)}/links-{uuid.uuid4().hex}"
    found.write.parquet(folder)
    out = cut(link_figures(spark.read.parquet(folder)).drop("row"))
    delete(spark, folder)
    return out


def op13_token_align(spark, sf_dir: str) -> DataFrame:
    return align_documents(table(spark, sf_dir, "documents"))
