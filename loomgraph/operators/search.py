"""Label search by an index of trigrams, and the merge of two producers' graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import cut
from .graph import CONFIDENCES

#: Queries that go to all tasks; more are joined to the index by shuffle.
FEW_QUERIES = 100_000


def trigrams(text):
    """The distinct runs of three characters of a column."""
    n = F.length(text)
    return F.when(n >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(text, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def label_index(nodes: DataFrame) -> DataFrame:
    """(gram, node, label): a row for each trigram of a node's label in lower case, to be written once and searched often."""
    low = F.lower("label")
    return nodes.where("label IS NOT NULL").select(F.explode(trigrams(low)).alias("gram"), "node", low.alias("label"))


def find_labels(queries: DataFrame, index: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query, node) of all labels that contain a query, in any case.

    Of a query's trigrams only the rarest fetches labels, and these are compared with the whole query. Queries of one or two
    characters have no trigram: all labels are compared with them. Empty and null queries find nothing.
    """
    asked = cut(queries.select("query", F.lower("query").alias("q")).where("query IS NOT NULL AND query <> ''").distinct())
    grams = cut(asked.select("query", "q", F.explode(trigrams(F.col("q"))).alias("gram")))
    common = index.join(F.broadcast(grams.select("gram").distinct()) if grams.count() <= FEW_QUERIES else grams.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    # a query with a trigram that no label has finds nothing
    rarest = cut(grams.join(common, "gram", "left").groupBy("query", "q").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram")))
    small = rarest.count() <= FEW_QUERIES
    long = index.join(F.broadcast(rarest) if small else rarest, "gram").where(F.contains("label", "q")).select("query", "node")
    short = cut(asked.where(F.length("q") < 3))  # there are as many as pairs of characters at most
    if short.isEmpty():
        return long
    low = nodes.where("label IS NOT NULL").select("node", F.lower("label").alias("label"))
    near = low.select("node", F.explode(F.array_distinct(F.concat(F.split("label", ""), F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("label") - 1)), lambda i: F.substring("label", i, F.lit(2)))))).alias("q"))
    return long.unionByName(near.join(F.broadcast(short) if small else short, "q").select("query", "node"))


def merged_edges(first: DataFrame, second: DataFrame) -> DataFrame:
    """(src, dst, kind, confidence, producers) of two producers' edges: the surest confidence of either (resolved over heuristic
    over unknown; none counts as unknown), and who has the edge: ``first``, ``second`` or ``both``."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, reversed(CONFIDENCES))), F.col("confidence")), F.lit(0))
    rows = None
    for bit, edges in ((1, first), (2, second)):
        own = edges.select("src", "dst", "kind", F.greatest(rank, F.lit(1)).alias("rank"), F.lit(bit).alias("bit"))
        rows = own if rows is None else rows.unionByName(own)
    merged = rows.groupBy("src", "dst", "kind").agg(F.max("rank").alias("rank"), F.bit_or("bit").alias("bits"))
    pick = lambda names, at: F.element_at(F.array(*map(F.lit, names)), F.col(at).cast("int"))
    return merged.select("src", "dst", "kind", pick(list(reversed(CONFIDENCES)), "rank").alias("confidence"), pick(["first", "second", "both"], "bits").alias("producers"))
