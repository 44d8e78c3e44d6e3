"""Preorder intervals of forests, and minima over ranges: who lies under whom, and where two nodes meet."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import Pile, cut, lack, running


def intervals(tree: DataFrame) -> DataFrame:
    """(node, depth, first, last) of a forest (node, parent), children by name: a node comes ``first`` in the preorder, and what
    lies under it up to ``last``, so b is under a where a.first < b.first <= a.last.

    Levels from the roots down, sizes from the deepest level up, then offsets from the roots down: each level is one range sort by
    (parent, node) with running sums, so no task has all children of a node. A node with several parents is refused; those on a
    cycle have no root and no interval.
    """
    steps = cut(tree.where("parent IS NOT NULL").select("parent", "node").distinct())
    if not steps.groupBy("node").count().where("count > 1").isEmpty():
        raise ValueError("a node has several parents")
    every = tree.select("node").unionByName(steps.select(F.col("parent").alias("node"))).where("node IS NOT NULL").distinct()
    now = cut(lack(every, steps.select("node"), ["node"]).select(F.lit(None).cast(steps.schema["parent"].dataType).alias("parent"), "node"))
    levels = []
    while not now.isEmpty():
        levels.append(now)
        now = cut(now.select(F.col("node").alias("parent")).join(steps, "parent").select("parent", "node"))
    sized, below = [], None
    for level in reversed(levels):
        own = level.withColumn("size", F.lit(1).cast("bigint")) if below is None else level.join(below, "node", "left").select("parent", "node", (F.lit(1) + F.coalesce("beneath", F.lit(0))).cast("bigint").alias("size"))
        sized.append(cut(own))
        below = sized[-1].groupBy(F.col("parent").alias("node")).agg(F.sum("size").alias("beneath"))
    found, up = None, None
    for depth, level in enumerate(reversed(sized)):
        rows = running(level.withColumn("key", F.struct("parent", "node")), "key", "size")
        if up is None:
            rows = rows.select("node", "size", F.col("below").alias("first"))
        else:
            rows = cut(rows)
            base = rows.groupBy("parent").agg(F.min("below").alias("base")).join(up, "parent")
            rows = rows.join(base, "parent").select("node", "size", (F.col("from") + 1 + F.col("below") - F.col("base")).alias("first"))
        rows = cut(rows.select("node", F.lit(depth).alias("depth"), "first", (F.col("first") + F.col("size") - 1).alias("last")))
        up = rows.select(F.col("node").alias("parent"), F.col("first").alias("from"))
        found = Pile(rows) if found is None else found
        if found.parts[-1] is not rows:
            found.add(rows)
    return found.all() if found else every.select("node", F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("first"), F.lit(0).cast("bigint").alias("last")).limit(0)


class RangeMinimum:
    """Minima of any range of numbers by a sparse table: row k has the minima of 2^k numbers from each place on."""

    NONE = np.iinfo(np.int64).max

    def __init__(self, numbers: list[int]) -> None:
        self.rows = [np.array(numbers, np.int64)]
        while 2 << (len(self.rows) - 1) <= len(numbers):
            half, last = 1 << (len(self.rows) - 1), self.rows[-1]
            self.rows.append(np.minimum(last[:-half], last[half:]))

    def of(self, begin: int, end: int) -> int:
        """The least from ``begin`` on and before ``end``; ``NONE`` of an empty range."""
        if begin >= end:
            return int(self.NONE)
        k = (end - begin).bit_length() - 1
        return int(min(self.rows[k][begin], self.rows[k][end - (1 << k)]))
