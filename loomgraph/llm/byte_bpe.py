"""Byte-level BPE encoding and decoding with length-bucketed numpy matrices.

Texts are cut at spaces that start a word; each distinct unit is split by the tokenizer's pattern once and
kept in a bounded cache, so a batch only encodes pieces it has not met. Distinct pieces go into padded
matrices of about equal length. In each round every row merges its leftmost pair of minimum rank; pair ranks
come from an open-addressing hash table; rows without a pair leave and the rest is compacted. Rows longer than
``LONG`` bytes would need as many rounds as bytes, so they merge with a heap over a linked list, in the same
order. A piece that is itself a token is that token, as in the tiktoken library. Special tokens are text.

A null text is the empty text and has no ids. Rows are kept one for one, in any number of partitions, with the
other columns as they are; a column that has the name of an output column is replaced.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import but, col, packed, spread, table, unpacked

NONE = np.int32(2**31 - 1)
LONG = 2048
#: Bytes of text that one step holds, cells of a matrix, and units that the cache holds before it starts anew.
STEP_BYTES, CELLS, CACHED = 4 << 20, 1 << 18, 250_000
#: The same for encoding and decoding, whose arrays take some 30 bytes for each byte of text.
CODE_BYTES = 1 << 20
#: Unicode's White_Space.
SPACE = "\t-\r \x85\xa0  -     　"
_ODD = re.compile(f" (?=[{SPACE}]|\\Z)")
_CUT = re.compile(f"(?= [^{SPACE}])")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PairTable:
    """Rank of the token that two adjacent tokens make, by open addressing."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        pairs, tokens = array("q"), array("i")  # a list of tuples would be the most that a worker ever holds
        for t, n in ranks.items():
            for i in range(1, len(t)):
                if (left := ranks.get(t[:i])) is not None and (right := ranks.get(t[i:])) is not None:
                    pairs.append(left << 32 | right)
                    tokens.append(n)
        keys, made = np.array(pairs, np.int64), np.array(tokens, np.int32)
        self.bits = max(4, int(2 * len(pairs)).bit_length())
        self.keys, self.made = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        slot = self._slot(keys)
        while len(keys):
            first = np.unique(slot, return_index=True)[1]
            take = first[self.keys[slot[first]] == -1]
            self.keys[slot[take]], self.made[slot[take]] = keys[take], made[take]
            rest = np.ones(len(keys), bool)
            rest[take] = False
            keys, made, slot = keys[rest], made[rest], (slot[rest] + 1) & (1 << self.bits) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks; NONE where the two make no token or one is padding (-1)."""
        keys = left.astype(np.int64) << 32 | np.maximum(right, 0)
        slot, out = self._slot(keys), np.full(len(keys), NONE, np.int32)
        at = np.flatnonzero((left >= 0) & (right >= 0))
        while len(at):
            there = self.keys[slot[at]]
            same = there == keys[at]
            out[at[same]] = self.made[slot[at[same]]]
            at = at[~same & (there != -1)]
            slot[at] = (slot[at] + 1) & (1 << self.bits) - 1
        return out


class Bpe:
    """One worker's encoder and decoder."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        self.ranks = load_ranks(path)
        self.split = regex.compile(pattern.replace(r"\S", f"[^{SPACE}]").replace(r"[^\s\p{L}\p{N}]", f"[^{SPACE}\\p{{L}}\\p{{N}}]").replace(r"\s", f"[{SPACE}]")).findall
        self.pairs = PairTable(self.ranks)
        self.byte = np.array([self.ranks.get(bytes([i]), -1) for i in range(256)], np.int32)
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for t, n in self.ranks.items():
            tokens[n] = t
        self.token_len = np.array([len(t) for t in tokens], np.int64)
        self.token_at = np.concatenate([[0], np.cumsum(self.token_len)[:-1]])
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.plain, self.spaced = {}, {}
        self.n, self.pending = 0, []
        self.flat, self.start, self.length = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    # encoding of pieces

    def _matrix(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of pieces of about equal length."""
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(pieces)
        lens = np.array([len(p) for p in pieces])
        width = int(lens.max())
        ids = np.full((len(pieces), width + 1), -1, np.int32)
        inside = np.arange(width + 1) < lens[:, None]
        ids[inside] = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = self.pairs.look(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(pieces), width)
        row = np.arange(len(pieces))
        while len(row):
            at = rank.argmin(1)
            own = np.arange(len(row))
            best = rank[own, at]
            live = best < NONE
            if not live.all():
                for r in np.flatnonzero(~live):
                    out[row[r]] = ids[r][ids[r] >= 0]
                row, ids, rank, at, best = row[live], ids[live], rank[live], at[live], best[live]
                if not len(row):
                    break
                own = np.arange(len(row))
            cols = np.arange(ids.shape[1] - 1)
            ids[own, at] = best
            ids = np.take_along_axis(ids, cols + (cols > at[:, None]), 1)
            rank = np.take_along_axis(rank, cols[:-1] + (cols[:-1] > at[:, None]), 1) if len(cols) > 1 else np.full((len(row), 1), NONE, np.int32)
            if len(cols) > 1:
                ok = at < rank.shape[1]
                rank[own[ok], at[ok]] = self.pairs.look(ids[own[ok], at[ok]], ids[own[ok], at[ok] + 1])
                ok = at > 0
                rank[own[ok], at[ok] - 1] = self.pairs.look(ids[own[ok], at[ok] - 1], ids[own[ok], at[ok]])
        return out

    def _long(self, piece: bytes) -> np.ndarray:
        """The same order of merges for one long piece: a heap of (rank, place) over a linked list."""
        ids = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        first = self.pairs.look(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32)).tolist()
        now = [*first, int(NONE)]
        heap = [(r, i) for i, r in enumerate(first) if r < NONE]
        heapq.heapify(heap)
        rank = lambda a, b: int(self.pairs.look(np.array([a], np.int32), np.array([b], np.int32))[0])
        while heap:
            r, i = heapq.heappop(heap)
            if now[i] != r or ids[i] < 0:
                continue
            j = right[i]
            ids[i], ids[j], right[i] = r, -1, right[j]
            now[j] = int(NONE)
            if right[i] >= 0:
                left[right[i]] = i
            for k in (left[i], i):
                if k >= 0:
                    now[k] = rank(ids[k], ids[right[k]]) if right[k] >= 0 else int(NONE)
                    if now[k] < NONE:
                        heapq.heappush(heap, (now[k], k))
        return np.array([x for x in ids if x >= 0], np.int32)

    def pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece (distinct, not empty)."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        rest = []
        for i, p in enumerate(pieces):
            if (known := self.ranks.get(p)) is not None:
                out[i] = np.array([known], np.int32)
            elif len(p) > LONG:
                out[i] = self._long(p)
            else:
                rest.append(i)
        rest.sort(key=lambda i: len(pieces[i]))
        k = 0
        while k < len(rest):
            least = len(pieces[rest[k]])
            end = k + 1
            while end < len(rest) and len(pieces[rest[end]]) <= least + least // 4 and (end - k + 1) * len(pieces[rest[end]]) <= CELLS:
                end += 1
            for i, ids in zip(rest[k:end], self._matrix([pieces[i] for i in rest[k:end]]), strict=True):
                out[i] = ids
            k = end
        return out

    # units and texts

    def _unit(self, known: dict[str, int], unit: str, text: str) -> int:
        self.pending.append(text)
        known[unit] = self.n
        self.n += 1
        return self.n - 1

    def _fill(self) -> None:
        """Encode the units met first in this step."""
        if not self.pending:
            return
        index: dict[str, int] = {}
        uses = [[index.setdefault(p, len(index)) for p in self.split(u)] for u in self.pending]
        ids = self.pieces([p.encode("utf-8", "replace") for p in index])
        lens = np.array([sum(len(ids[k]) for k in u) for u in uses], np.int64)
        flat = [ids[k] for u in uses for k in u]
        begin = len(self.flat) + np.concatenate([[0], np.cumsum(lens)[:-1]])
        self.flat = np.concatenate([self.flat, *flat])
        self.start, self.length = np.concatenate([self.start, begin]), np.concatenate([self.length, lens])
        self.pending = []

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, and offsets."""
        if self.n > CACHED or len(self.flat) > 8 * CACHED:
            self.forget()
        counts, places = np.zeros(len(texts), np.int64), []
        plain, spaced, new = self.plain, self.spaced, self._unit
        for i, text in enumerate(texts):
            if not text:
                continue
            parts = _CUT.split(text) if _ODD.search(text) else None
            rest = text.split(" ") if parts is None else [p[1:] for p in parts[1:]]
            first = rest.pop(0) if parts is None else parts[0]
            got = [plain[first] if first in plain else new(plain, first, first)] if first else []
            got += [spaced[u] if u in spaced else new(spaced, u, " " + u) for u in rest]
            counts[i] = len(got)
            places.append(np.array(got, np.int64))
        self._fill()
        unit = np.concatenate(places) if places else np.empty(0, np.int64)
        ids = gather(self.flat, self.start[unit], self.length[unit])
        ends = np.concatenate([[0], np.cumsum(self.length[unit])])
        return ids, ends[np.concatenate([[0], np.cumsum(counts)])]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts, and offsets."""
        size = self.token_len[ids]
        return gather(self.token_bytes, self.token_at[ids], size), np.concatenate([[0], np.cumsum(size)])[offsets]


def gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """flat[start : start + length] of every run, one after the other."""
    before = np.cumsum(length) - length
    return flat[np.repeat(start - before, length) + np.arange(int(length.sum()))]


def _steps(batches: Iterator[pa.RecordBatch], weigh, size: int | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of about ``size`` bytes (STEP_BYTES), of one row at least."""
    size = STEP_BYTES if size is None else size
    for batch in batches:
        weight = np.cumsum(weigh(batch))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(weight, (weight[at - 1] if at else 0) + size, "right")))
            yield batch.slice(at, end - at)
            at = end


def _sizes(column: str):
    return lambda batch: _bytes(batch.column(column))


def _bytes(texts: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _binary(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])


def _run(df: DataFrame, source: str, outputs: list[T.StructField], keep_source: bool, weigh, make) -> DataFrame:
    """``df`` with ``outputs`` of ``make()(column)`` instead of columns of these names. Other columns travel as one struct, so their
    names may be any."""
    kept = but(df, *(f.name for f in outputs), *([] if keep_source else [source]))
    sent = df.select(packed(df, kept).alias("__kept"), col(source).alias("__source"))
    schema = T.StructType([sent.schema["__kept"], *outputs])

    def run(batches):
        state = None
        for batch in _steps(batches, lambda b: weigh(b.column("__source")), CODE_BYTES):
            state = state or make()
            yield pa.RecordBatch.from_arrays([batch.column("__kept"), *state(batch.column("__source"))], names=[f.name for f in schema])

    return sent.mapInArrow(run, schema).select(*unpacked("__kept", kept), *(col(f.name) for f in outputs))


_IDS = T.ArrayType(T.IntegerType(), False)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None, keep_text: bool = False) -> DataFrame:
    """``df`` without its text, with ``ids``; with ``decoded`` also the bytes that the ids decode to, in the same pass."""

    def make():
        bpe = Bpe(path, pattern)

        def step(column: pa.Array) -> list[pa.Array]:
            flat, offsets = bpe.encode(column.to_pylist())
            out = [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat, pa.int32()))]
            return [*out, _binary(*bpe.decode(flat, offsets))] if decoded else out

        return step

    outputs = [T.StructField(ids, _IDS), *([T.StructField(decoded, T.BinaryType())] if decoded else [])]
    return _run(df, text, outputs, keep_text, _bytes, make)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the bytes that ``ids`` decode to; null ids decode to nothing."""
    import pyarrow.compute as pc

    def make():
        bpe = Bpe(path, pattern)

        def step(column: pa.Array) -> list[pa.Array]:
            rows = [np.array(x or [], np.int64) for x in column.to_pylist()]
            return [_binary(*bpe.decode(np.concatenate([np.empty(0, np.int64), *rows]), np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int64)))]

        return step

    weigh = lambda rows: 8 * pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return _run(df, ids, [T.StructField(decoded, T.BinaryType())], True, weigh, make)


def tokenize_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    import public_tokenizers

    rows = encode(spread(docs.select("doc_id", "text")), path or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded="decoded")
    return rows.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return tokenize_documents(table(spark, sf_dir, "documents"))
