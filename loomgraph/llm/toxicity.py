"""Toxicity: a counterfactual-regularised linear classifier.

Features of a text are the distinct words (ASCII letters and non-ASCII characters, lower-cased) and their stems of
4 to 6 characters, present or not. The model is a logistic regression over the features whose rates differ
between the labels (log likelihood ratio above ``LEAST_GAIN``). In labelled texts that name an identity group, the group's term is swapped for others; the training
loss adds ``penalty`` times the squared change of the score that a swap causes, so a neutral mention of a group
doesn't move the score.

Learning takes a bounded sample: the ``SAMPLE`` labelled rows with the smallest hash of their id (an id with several
labels counts as toxic if one says so), and at most ``FEATURES`` features. Every text is scored whole. Without any
labelled row all scores are 0; with labels of one kind only, all are that label's share after smoothing. A null text
is the empty text. Rows are kept one for one; rows without an id are never learned from and not held out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_bpe import _sizes, _steps
from .common import but, col, packed, spread, table, unpacked
from .language_id import fold

SAMPLE, FEATURES, PENALTY, LEAST_GAIN = 8_000, 1024, 10.0, 8.0
STEMS = (4, 5, 6)
#: Terms for groups of people, in lists whose members can stand for each other.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab", "african", "european"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("deaf", "blind", "disabled", "elderly", "young"),
    ("femmes", "hommes"), ("frauen", "männer"), ("mujeres", "hombres"),
)
_GROUP = {term: [x for x in group if x != term] for group in IDENTITY for term in group}
_WORD = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> set[bytes]:
    return set(text.lower().encode("utf-8", "replace").translate(_WORD).split()) if text else set()


def features_of(word: bytes) -> list[int]:
    """Signed 32-bit hashes of the word and its stems."""
    chars = word.decode("utf-8", "replace")
    names = ["=" + chars, *("^" + chars[:n] for n in STEMS if len(chars) >= n)]
    return [h - (1 << 32) if (h := xxhash.xxh32_intdigest(n)) >> 31 else h for n in names]


class _Features(dict):
    def __missing__(self, word: bytes) -> list[int]:
        if len(self) > 200_000:
            self.clear()
        self[word] = f = features_of(word)
        return f


def swapped(words: set[bytes]) -> list[set[bytes]]:
    """The counterfactuals of each identity term among the words: one for every other term of its lists."""
    out = []
    for w in sorted(words):
        for other in _GROUP.get(w.decode("utf-8", "replace"), []):
            out.append(words - {w} | {other.encode()})
    return out


def featurize(rows: DataFrame) -> DataFrame:
    """(toxic, pair, features) of rows (row, text, toxic): pair 0 the text itself, then its counterfactuals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Features()
        for batch in _steps(batches, _sizes("text")):
            row, toxic, pair, found = [], [], [], []
            for r, text, label in zip(*(batch.column(c).to_pylist() for c in ("row", "text", "toxic")), strict=True):
                own = words_of(text)
                for i, words in enumerate([own, *swapped(own)]):
                    row.append(r)
                    toxic.append(label)
                    pair.append(i)
                    found.append(list({f for w in words for f in known[w]}))
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(toxic, pa.int32()), pa.array(pair, pa.int32()), pa.array(found, pa.list_(pa.int32()))], names=["row", "toxic", "pair", "features"])

    return rows.select("row", "text", "toxic").mapInArrow(run, "row bigint, toxic int, pair int, features array<int>")


class Model:
    """Weights by feature, a bias."""

    def __init__(self, weights: dict[int, float], bias: float) -> None:
        self.weights, self.bias = weights, bias

    def scorer(self):
        weights, known = self.weights, {}

        def score(text: str | None) -> float:
            if len(known) > 200_000:
                known.clear()
            hit: set[int] = set()
            for w in words_of(text):
                own = known.get(w)
                if own is None:
                    known[w] = own = tuple(f for f in features_of(w) if f in weights)
                if own:
                    hit.update(own)
            return float(1 / (1 + np.exp(-np.clip(self.bias + sum(weights[f] for f in sorted(hit)), -50, 50))))

        return score


def information(seen: np.ndarray, n: int) -> np.ndarray:
    """Log likelihood of presence at its own rate among n texts."""
    p = np.clip(seen / n, 1e-12, 1 - 1e-12)
    return seen * np.log(p) + (n - seen) * np.log1p(-p)


def fit(toxic: np.ndarray, pair: np.ndarray, row: np.ndarray, flat: np.ndarray, offsets: np.ndarray, penalty: float = PENALTY) -> Model:
    """From the output of ``featurize`` as arrays."""
    if not len(toxic):
        return Model({}, -50.0)
    base = pair == 0
    n1, n0 = int((toxic[base] == 1).sum()), int((toxic[base] == 0).sum())
    prior = float(np.log((n1 + 0.5) / (n0 + 0.5)))
    if not n1 or not n0:
        return Model({}, prior)
    owner = np.repeat(np.arange(len(toxic), dtype=np.int32), np.diff(offsets))
    names1, count1 = np.unique(flat[(base & (toxic == 1))[owner]], return_counts=True)
    names0, count0 = np.unique(flat[(base & (toxic == 0))[owner]], return_counts=True)
    names = np.union1d(names1, names0)
    seen1, seen0 = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    seen1[np.searchsorted(names, names1)], seen0[np.searchsorted(names, names0)] = count1, count0
    gain = information(seen1, n1) + information(seen0, n0) - information(seen1 + seen0, n1 + n0)
    chosen = np.flatnonzero((gain > LEAST_GAIN) & (seen1 + seen0 >= 4))
    chosen = np.sort(names[chosen[np.lexsort((names[chosen], -gain[chosen]))][:FEATURES]])
    if not len(chosen):
        return Model({}, prior)
    at = np.minimum(np.searchsorted(chosen, flat), len(chosen) - 1)
    hit = chosen[at] == flat
    x = np.zeros((len(toxic), len(chosen)), np.float32)
    x[owner[hit], at[hit]] = 1
    first = {r: i for i, r in zip(np.flatnonzero(base).tolist(), row[base].tolist(), strict=True)}
    other = np.flatnonzero(~base)
    change = x[other] - x[[first[r] for r in row[other].tolist()]] if len(other) else np.zeros((0, len(chosen)), np.float32)
    xb, y = x[base], (toxic[base] == 1).astype(np.float32)
    w, b = np.zeros(len(chosen), np.float32), prior
    m, v, decay = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1), 1e-5
    for step in range(1, 601):  # Adam on the whole sample
        p = 1 / (1 + np.exp(-np.clip(xb @ w + b, -50, 50)))
        g = xb.T @ (p - y) / len(y) + decay * w
        if len(change):
            g = g + penalty * 2 * change.T @ (change @ w) / len(change)
        g = np.append(g, (p - y).mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = (w - move[:-1]).astype(np.float32), float(b - move[-1])
    return Model({int(f): float(x) for f, x in zip(chosen, w, strict=True) if x}, b)


def learn(docs: DataFrame, labels: DataFrame, penalty: float = PENALTY) -> Model:
    """From documents (doc_id, text) and labels (doc_id, toxic), both without rows to hold out."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = known.select("doc_id", "toxic", F.xxhash64(F.lit("sample"), "doc_id").alias("lot")).orderBy("lot", "doc_id").limit(SAMPLE)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # SAMPLE rows of three numbers
    # an id may repeat in any number of rows: it stands for the text with the smallest hash
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text"))
    rows = rows.withColumn("nth", nth).where("nth = 1").select("doc_id", "text", "toxic")
    found = featurize(rows.select(F.col("doc_id").alias("row"), "text", "toxic"))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            model = fit_table(pa.Table.from_batches(held), penalty)
            yield pa.RecordBatch.from_arrays([pa.array([*model.weights, None], pa.int32()), pa.array([*model.weights.values(), model.bias], pa.float64())], names=["feature", "weight"])

    # the bounded sample is fitted in one task; the driver gets the weights alone
    weights = {r["feature"]: r["weight"] for r in found.repartition(1).mapInArrow(train, "feature int, weight double").collect()}
    bias = weights.pop(None, None)
    return Model(weights, bias) if bias is not None else Model({}, -50.0)


def fit_table(got: pa.Table, penalty: float) -> Model:
    got = got.sort_by([("row", "ascending"), ("pair", "ascending")])
    found = got["features"].combine_chunks()
    flat, offsets = found.flatten().to_numpy(), np.concatenate([[0], np.cumsum(found.value_lengths().to_numpy())]).astype(np.int64)
    return fit(got["toxic"].to_numpy(), got["pair"].to_numpy(), got["row"].to_numpy(), flat, offsets, penalty)


def score(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = False, out: str = "score") -> DataFrame:
    """``docs`` with the column ``out`` (one of that name, in any case, is replaced); without its text unless it is kept."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most FEATURES weights
    kept = but(docs, out, *([] if keep_text else [text]))

    def texts_of(batch: pa.RecordBatch) -> pa.Array:
        return batch.column("kept").field(text) if keep_text else batch.column("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = sent.value.scorer()
        for batch in _steps(batches, lambda b: _sizes("text")(pa.RecordBatch.from_arrays([texts_of(b)], names=["text"]))):
            yield pa.RecordBatch.from_arrays([batch.column("kept"), pa.array([of(t) for t in texts_of(batch).to_pylist()], pa.float64())], names=["kept", "found"])

    rows = spread(docs.select(packed(docs, kept).alias("kept"), *([] if keep_text else [col(text).alias("text")])))
    schema = T.StructType([rows.schema["kept"], T.StructField("found", T.DoubleType())])
    return rows.mapInArrow(run, schema).select(*unpacked("kept", kept), F.col("found").alias(out))


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 5) != 0)
    model = learn(docs, labels)
    held = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return score(docs.select("doc_id", held.alias("held_out"), "text"), model).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
