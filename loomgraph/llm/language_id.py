"""Language identification by cross-parsing entropy.

For each language, a suffix automaton of labelled text. A text is parsed greedily into the longest phrases that
occur in a language's text; the language that needs the fewest phrases, normalised to phrases * log2(length of the
language's text) / length of the text, wins; ties go to the name that sorts first.

Texts are lower-cased, and cut down to letters and single spaces. Automata are one dense table with a total
transition function: where no transition exists, the entry leads to where the automaton's start leads with that
letter, and counts a phrase. So one table look-up per byte and language is all, done for thousands of texts at once.
Long texts are cut into blocks of ``STEPS`` bytes for that, and the parse is carried over: a block is parsed from the
automaton's start first, then again from where the block before ended, until both parses are in the same state; what they
counted differently till then is put right. So a text is parsed as a whole, whatever its length.

Learning takes a bounded sample of whole labelled rows: of each language ``rows`` rows with the smallest hash of their id, of
these as many as fit into ``size`` bytes (less, if there are so many languages that the table would pass ``CELLS``). Rows
that don't fit are left out; only if a language has no row that fits, its shortest sampled one is cut. Every text is judged whole.

A text that is null or has no letter is ``und`` with score 0; so is every text if nothing could be learned. Rows are
kept one for one; rows without an id are never learned from and not held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_bpe import _sizes, _steps
from .common import but, col, packed, spread, table, unpacked

ROWS, BYTES, CELLS, STEPS = 192, 65_536, 64_000_000, 1024
_LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def letters(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS).split())


def automaton(text: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence of classes; state 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text.tolist():
        now = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = now
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return step


class Model:
    """All languages' automata in one table: entry = 2 * (row of the next state) + (1 if a phrase ended)."""

    def __init__(self, texts: dict[str, bytes]) -> None:
        self.langs = sorted(texts)
        seen = sorted({b for t in texts.values() for b in t})
        self.classes = np.zeros(256, np.int64)
        self.classes[seen] = np.arange(1, len(seen) + 1)
        width = self.width = len(seen) + 1
        tables, self.start, rows = [], [], 0
        self.bits = np.array([np.log2(max(2, len(texts[x]))) for x in self.langs])
        for lang in self.langs:
            steps = automaton(self.classes[np.frombuffer(texts[lang], np.uint8)])
            own = np.full((len(steps), width), -1, np.int64)
            for state, to in enumerate(steps):
                own[state, list(to)] = list(to.values())
            home = np.where(own[0] >= 0, own[0], 0)
            entry = np.where(own >= 0, 2 * (own + rows) * width, 2 * (home + rows) * width + 1)
            tables.append(entry.astype(np.int32))
            self.start.append(rows * width)
            rows += len(steps)
        self.table = np.concatenate([np.empty((0, width), np.int32), *tables]).ravel()
        self.start = np.array(self.start, np.int32)

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """[texts, languages]: phrases of each text."""
        sizes = np.array([len(t) for t in texts], np.int64)
        flat = self.classes[np.frombuffer(b"".join(texts), np.uint8)].astype(np.int32)
        n = -(-sizes // STEPS)
        owner = np.repeat(np.arange(len(texts)), n)
        part = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        begin = np.repeat(np.cumsum(sizes) - sizes, n) + part * STEPS
        length = np.minimum(STEPS, np.repeat(sizes, n) - part * STEPS)
        fresh = np.repeat(self.start[:, None], len(owner), 1)
        count, last = np.zeros((len(self.langs), len(owner)), np.int64), fresh.copy()
        for at in range(0, len(owner), 4096):
            some = np.arange(at, min(at + 4096, len(owner)))
            count[:, some], last[:, some], _ = self._run(flat, begin[some], length[some], fresh[:, some])
        # blocks that go on: from the state in which the one before ended, as long as that changes anything
        entered, todo = fresh, np.flatnonzero(part > 0)
        while len(todo):
            came = last[:, todo - 1]
            todo = todo[(came != entered[:, todo]).any(0)]
            if not len(todo):
                break
            changed = np.zeros(len(todo), bool)
            for at in range(0, len(todo), 4096):
                some = todo[at : at + 4096]
                came = last[:, some - 1].copy()
                more, ended, met = self._run(flat, begin[some], length[some], came, entered[:, some])
                count[:, some] += more
                changed[at : at + 4096] = ~met.all(0)
                last[:, some] = np.where(met, last[:, some], ended)
                entered[:, some] = came
            after = todo[changed] + 1
            after = after[after < len(owner)]
            todo = after[part[after] > 0]
        out = np.ones((len(texts), len(self.langs)), np.int64)
        np.add.at(out, owner, count.T)
        return out

    def _run(self, flat: np.ndarray, begin: np.ndarray, length: np.ndarray, state: np.ndarray, other: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases that end in blocks of ``flat`` parsed from ``state`` [languages, blocks], and the states at their ends.

        With ``other``, a second parse from there runs beside it: phrases are counted less those of the second, until both are
        in the same state, and the third result says where they have met.
        """
        order = np.argsort(-length, kind="stable")
        size = length[order]
        begin, state = begin[order], state[:, order].copy()
        count = np.zeros(state.shape, np.int64)
        second = None if other is None else other[:, order].copy()
        for t in range(int(size[0]) if len(size) else 0):
            m = int(np.searchsorted(-size, -t, "left"))  # blocks longer than t
            if second is not None and t % 16 == 0 and (state[:, :m] == second[:, :m]).all():
                break
            cells = flat[begin[:m] + t]
            entry = self.table[state[:, :m] + cells]
            count[:, :m] += entry & 1
            state[:, :m] = entry >> 1
            if second is not None:
                entry = self.table[second[:, :m] + cells]
                count[:, :m] -= entry & 1
                second[:, :m] = entry >> 1
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        met = np.ones(state.shape, bool) if second is None else state == second
        return count[:, back], state[:, back], met[:, back]

    def judge(self, texts: list[str | None], has_letter) -> tuple[list[str], list[float]]:
        cleaned = [letters(t) if t and has_letter(t) else b"" for t in texts]
        judged = [i for i, t in enumerate(texts) if self.langs and t and has_letter(t)]
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        if judged:
            own = [cleaned[i] or b" " for i in judged]
            cost = self.phrases(own) * self.bits / np.array([len(t) for t in own])[:, None]
            best = cost.argmin(1)
            low = cost[np.arange(len(own)), best]
            if len(self.langs) > 1:
                cost[np.arange(len(own)), best] = np.inf
                margin = 1 - low / cost.min(1)
            else:
                margin = np.ones(len(own))
            for i, b, s in zip(judged, best, margin, strict=True):
                langs[i], scores[i] = self.langs[b], float(min(1.0, max(0.0, s)))
        return langs, scores


def learn(labelled: DataFrame, rows: int = ROWS, size: int = BYTES) -> Model:
    """From rows (doc_id, text, lang) without nulls in doc_id and lang."""
    labelled = labelled.where("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL")
    counts = dict(labelled.groupBy("lang").count().collect())  # one number for each language
    if not counts:
        return Model({})
    limit = min(size, CELLS // (2 * 64 * len(counts)))
    whole = 1 << 40
    lot = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(whole))
    most = F.map_from_arrays(F.lit(list(counts)), F.lit([min(whole, int(whole * 4 * rows / n) + 1) for n in counts.values()]))
    drawn = labelled.where(lot < most[F.col("lang")]).select("lang", lot.alias("lot"), "text").where(F.octet_length("text") <= size)
    # an id may repeat in any number of rows, so the rows themselves are counted
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("lot", F.xxhash64("text")))
    texts: dict[str, bytes] = {}
    seen = set()
    for r in drawn.withColumn("nth", nth).where(F.col("nth") <= rows).orderBy("lang", "nth").collect():  # at most rows * size bytes a language
        own = letters(r["text"])
        if own and (r["lang"], own) not in seen and len(texts.get(r["lang"], b"")) + len(own) < limit:
            seen.add((r["lang"], own))
            texts[r["lang"]] = texts.get(r["lang"], b"") + b" " + own
    if lacking := sorted(set(counts) - set(texts)):
        short = labelled.where(F.col("lang").isin(lacking) & F.col("text").rlike(r"\S")).select("lang", F.struct(F.octet_length("text"), lot, F.substring("text", 1, limit).alias("text")).alias("t"))
        for r in short.groupBy("lang").agg(F.min("t").alias("t")).collect():
            if own := letters(r["t"]["text"]):
                texts[r["lang"]] = (b" " + own)[:limit]
    return Model(texts)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``lang_pred`` and ``score``; columns of those names, in any case, are replaced."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # CELLS bounds its size
    kept = but(docs, text, "lang_pred", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        has_letter = regex.compile(r"\p{L}").search
        for batch in _steps(batches, _sizes("text")):
            langs, scores = sent.value.judge(batch.column("text").to_pylist(), has_letter)
            yield pa.RecordBatch.from_arrays([batch.column("kept"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["kept", "lang_pred", "score"])

    rows = spread(docs.select(packed(docs, kept).alias("kept"), col(text).alias("text")))
    schema = T.StructType([rows.schema["kept"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema).select(*unpacked("kept", kept), "lang_pred", "score")


def fold(id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(id.cast("string")) % n


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(fold(F.col("doc_id"), 3) != 1).select("doc_id", "text", "lang"))
    held = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
