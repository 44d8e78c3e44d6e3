"""Filter interaction audit: what each filter of a chain removes, in every order of the chain, and its Shapley value.

A document's failures are a mask of the filters that it fails. All that the audit reports follows from how many documents of
a part have each mask. Their multilinear extension is the removal polynomial: with every filter i switched on with probability
x_i, the expected number of removed documents is a polynomial that is linear in each x_i. Its value at a corner (filters on or
off) is what a set of filters removes, so a chain's survivors, step by step, are corner values. A filter's Shapley value is
the integral of its partial derivative along the diagonal; times n! it is the sum over all orders of what the filter
removes. Coefficients and integrals are exact rationals.

Null texts are empty, null parts are the part ''. Rows without an id are copies of nothing and have no labels; repeated rows of
one id and text are all first. A label row counts if any row of the id has it. An empty table has no parts, hence no rows.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import factorial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, col, cut, table

#: ASCII white space, and the letters of the five filters.
WHITE, LETTERS = " \t\n\x0b\x0c\r", "ABCDE"


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t-\\r]+"))


def text_failures(text: Column, words: Column) -> list[Column]:
    """Whether a text (not null) fails A (under 200 words), B (few distinct words), C (many capitals), D (odd characters)."""
    n, length = F.size(words), F.length(text)
    capitals = length - F.length(F.translate(text, UPPER, ""))
    return [n < 200, 100 * F.size(F.array_distinct(words)) < 50 * n, 100 * capitals > 2 * length, text.rlike("[#$%&*|]")]


def bits(failures: list[Column]) -> Column:
    out = F.lit(0)
    for i, fails in enumerate(failures):
        out = out + F.when(fails, 1 << i).otherwise(0)
    return out


def failure_masks(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and by the filters A-E that they fail, and how many are labelled so.

    E compares texts by their SHA-256 over the table. Rows of one text meet at (text, id), not at the text, so that no task has
    a group of copies; before that a row stands for all repeated ones.
    """
    whole = F.coalesce(col(text), F.lit(""))
    seen = docs.select(col(id).cast("bigint").alias("id"), F.coalesce(col(part).cast("string"), F.lit("")).alias("part"), whole.alias("text"), words_of(whole).alias("words"))
    seen = seen.select("id", "part", F.unhex(F.sha2("text", 256)).alias("hash"), bits(text_failures(F.col("text"), F.col("words"))).alias("mask"))
    seen = cut(seen.groupBy("id", "part", "hash", "mask").agg(F.count("*").alias("n")))
    first = seen.where("id IS NOT NULL").groupBy("hash").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    judged = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("id")).agg(F.max((F.col("quality") == 1).cast("bigint")).alias("is_good"), F.max((F.col("toxic") == 1).cast("bigint")).alias("is_toxic"))
    known = seen.where("id IS NOT NULL").join(judged, "id", "left").join(first, ["id", "hash"], "left")
    known = known.withColumn("mask", F.col("mask") + F.when(F.col("first"), 0).otherwise(1 << LETTERS.index("E")))
    both = known.select("part", "mask", "n", "is_good", "is_toxic").unionByName(seen.where("id IS NULL").select("part", "mask", "n"), allowMissingColumns=True)
    of = lambda mark: F.sum(F.col("n") * F.coalesce(mark, F.lit(0))).alias(mark.removeprefix("is_"))
    return both.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("is_good"), of("is_toxic"))


class Removal:
    """The removal polynomial of documents counted by mask: ``coefficient[T]`` is that of the product of x_i for i in T."""

    def __init__(self, counts: dict[int, int], n_filters: int) -> None:
        self.n, self.total = n_filters, sum(counts.values())
        # a mask's documents are removed with probability 1 - prod(1 - x_i); multiplied out, each non-empty subset of the mask
        # has the coefficient +1 or -1
        self.coefficient = [0] * (1 << n_filters)
        for mask, count in counts.items():
            subset = mask
            while subset:
                self.coefficient[subset] += count if subset.bit_count() % 2 else -count
                subset = (subset - 1) & mask
        self.corners = [sum(c for t, c in enumerate(self.coefficient) if t & s == t) for s in range(1 << n_filters)]

    def removed(self, filters: int) -> int:
        """Documents that a set of filters removes: the polynomial at that corner."""
        return self.corners[filters]

    def shapley(self, i: int) -> Fraction:
        """The integral over t in 0..1 of the partial derivative by x_i at (t, ..., t): t^(k - 1) for a term of k factors."""
        return sum((Fraction(c, t.bit_count()) for t, c in enumerate(self.coefficient) if t >> i & 1), Fraction(0))


def audit(masks: DataFrame, letters: str = LETTERS) -> DataFrame:
    """A row for each part, order of the filters and step, from (part, mask, n, good, toxic); bit i of a mask is ``letters[i]``.

    A part has at most 2^len(letters) masks, which meet in one small group; it has len(letters)! * len(letters) rows.
    """
    n = len(letters)
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

    def play(group: pd.DataFrame) -> pd.DataFrame:
        every, good, toxic = (Removal(dict(zip(group["mask"].tolist(), group[c].tolist(), strict=True)), n) for c in ("n", "good", "toxic"))
        full = (1 << n) - 1
        shapley = [int(every.shapley(i) * factorial(n)) for i in range(n)]
        alone = [every.removed(full) - every.removed(full ^ 1 << i) for i in range(n)]
        rows = []
        for order in permutations(range(n)):
            on, label = 0, "".join(letters[i] for i in order)
            for step, i in enumerate(order, 1):
                to = on | 1 << i
                here = every.removed(to) - every.removed(on)
                rows.append((label, step, every.total - every.removed(to), here, every.removed(1 << i) - here, alone[i], good.removed(to) - good.removed(on), toxic.removed(to) - toxic.removed(on), shapley[i]))
                on = to
        return pd.DataFrame(rows, columns=["filter_order", "step", *names]).assign(part=group["part"].iloc[0])[["part", "filter_order", "step", *names]]

    return masks.groupBy("part").applyInPandas(play, "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in names))


#: The chains played out on masks: nothing of the polynomial.
ORACLE = """WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
  + CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > first THEN 16 ELSE 0 END AS mask,
  count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM w LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 4, 8, 16]) AS b),
o AS (SELECT p.c || q.c || r.c || s.c || t.c AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS chain FROM f p, f q, f r, f s, f t WHERE p.b | q.b | r.b | s.b | t.b = 31),
k AS (SELECT filter_order, step::INTEGER AS step, chain[step] AS own, coalesce(list_sum(chain[1:step - 1]), 0)::INTEGER AS before FROM o, range(1, 6) x(step)),
g AS (SELECT part, filter_order, step, own,
  sum(n) FILTER (mask & (before | own) = 0) AS kept, sum(n) FILTER (mask & before = 0 AND mask & own <> 0) AS removed, sum(n) FILTER (mask & before <> 0 AND mask & own <> 0) AS redundant,
  sum(n) FILTER (mask = own) AS unique_fails, sum(good) FILTER (mask & before = 0 AND mask & own <> 0) AS good_lost, sum(toxic) FILTER (mask & before = 0 AND mask & own <> 0) AS toxic_lost FROM m, k GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM g"""


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(failure_masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
