"""Connected components, and classes of near-duplicates from candidate groups without all their pairs.

Only DataFrame operations; all state is in written tables, the driver sees counts alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_join

#: Nodes of a group that a row holds.
BLOCK = 64


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root is the smallest node that can be reached.

    Each round, every node takes the smallest label within two steps, the chains this makes are shortened by doubling,
    and links inside one component go; what is left links the labels. A hub of any size only adds partial minima.
    """
    labels, edges = None, cut(links.select("a", "b").where("a <> b").distinct())
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        one = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("next")).select("node", F.least("node", "next").alias("root"))
        two = both.join(one.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("further"))
        up = one.join(two, "node").select("node", F.least("root", "further").alias("root"))
        while True:
            above = up.select(F.col("node").alias("root"), F.col("root").alias("top"))
            jumped = cut(up.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root"), (F.coalesce("top", "root") != F.col("root")).alias("moved")))
            up = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            labels = up
        else:
            step = up.select(F.col("node").alias("root"), F.col("root").alias("top"))
            labels = cut(labels.join(step, "root", "left").select("node", F.coalesce("top", "root").alias("root")))
        a, b = (up.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
        edges = cut(edges.join(a, "a").join(b, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")).where("a <> b").distinct())
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    return labels


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: as an attribute it would be copied to each of its uses."""
    return F.transform(F.array(value), body)[0]


def spanning(xs: Column, ys: Column, linked: Callable[[Column, Column], Column]) -> Column:
    """An array of links (a, b) between nodes of xs and of ys, arrays of structs with node and root, that leaves the same
    components as all their links do: a link inside one root, or between nodes that earlier links joined, isn't even tried."""
    roots = lambda side: F.transform(side, lambda x: x["root"])
    none = F.transform(F.slice(xs, 1, 0), lambda x: F.struct(x["node"].alias("a"), x["node"].alias("b")))
    places = F.when(F.size(ys) > 0, F.sequence(F.lit(0), F.size(ys) - 1)).otherwise(F.array().cast("array<int>"))

    def step(acc: Column, i: Column) -> Column:
        def join(x: Column, root: Column) -> Column:
            fits = F.filter(places, lambda j: F.when(F.get(acc["ry"], j) != root, linked(x, F.get(ys, j))).otherwise(F.lit(False)))

            def merge(fits: Column) -> Column:
                met = F.array_distinct(F.transform(fits, lambda j: F.get(acc["ry"], j)))
                picked = F.transform(met, lambda r: F.get(ys, F.get(F.filter(fits, lambda j: F.get(acc["ry"], j) == r), F.lit(0))))
                new = F.transform(picked, lambda y: F.struct(F.least(x["node"], y["node"]).alias("a"), F.greatest(x["node"], y["node"]).alias("b")))
                renamed = lambda rs: F.transform(rs, lambda r: F.when(F.array_contains(met, r), root).otherwise(r))
                return F.struct(renamed(acc["rx"]).alias("rx"), renamed(acc["ry"]).alias("ry"), F.concat(acc["links"], new).alias("links"))

            return let(fits, lambda fits: F.when(F.size(fits) == 0, acc).otherwise(merge(fits)))

        return let(F.get(xs, i), lambda x: let(F.get(acc["rx"], i), lambda root: join(x, root)))

    start = F.struct(roots(xs).alias("rx"), roots(ys).alias("ry"), none.alias("links"))
    return F.aggregate(F.when(F.size(xs) > 0, F.sequence(F.lit(0), F.size(xs) - 1)).otherwise(F.array().cast("array<int>")), start, step)["links"]


def classes(members: DataFrame, values: DataFrame, screen: Callable[[Column, Column], Column], confirm: Callable[[Column, Column], Column]) -> DataFrame:
    """(node, root) of every node that has a link to another.

    members: (key, node), each row once; two nodes with a common key are candidates. values: (node, value).
    Two nodes are linked if ``confirm`` says so of their values; ``screen`` is cheap and true of all links.

    First, the smallest node of every group meets the others; a group of copies is then one class and done. In groups
    that are still in several classes, all pairs of different classes are tried, inside rows that hold two blocks of
    about ``BLOCK`` nodes of the group (``spanning``). A tried pair is no row; two blocks of n nodes together make at most
    n - 1 rows, links that join what nothing joined before. Every pair of nodes that share a key is tried or already in one
    class, and no row or task holds a whole group.
    """
    size = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    members = cut(members.join(size, "key"))
    hubs = cut(members.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("hub")))
    pairs = hot_join(members, hubs, "key", "hub").where("hub < node").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()

    def linked(pairs: DataFrame) -> DataFrame:
        both = pairs.join(values.select(F.col("node").alias("a"), F.col("value").alias("va")), "a").join(values.select(F.col("node").alias("b"), F.col("value").alias("vb")), "b")
        return both.where(screen(F.col("va"), F.col("vb"))).where(confirm(F.col("va"), F.col("vb"))).select("a", "b")

    links = cut(linked(pairs))
    labels = components(links)
    labelled = members.join(labels, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    opened = labelled.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("m")).where("least <> most AND m > 2").select("key", F.ceil(F.col("m") / BLOCK).alias("lots"))
    lot = F.pmod(F.xxhash64(F.lit("lot"), "node"), F.col("lots"))
    held = labelled.join(opened, "key").join(values, "node").select("key", "lots", lot.alias("lot"), F.struct("node", "root", "value").alias("x"))
    blocks = cut(held.groupBy("key", "lots", "lot").agg(F.collect_list("x").alias("xs")))
    left = blocks.select("key", "lot", "xs", F.explode(F.sequence(F.col("lot"), F.col("lots") - 1)).alias("with"))
    right = blocks.select(F.col("key").alias("rkey"), F.col("lot").alias("with_"), F.col("xs").alias("ys"))
    met = left.join(right, (F.col("key") == F.col("rkey")) & (F.col("with") == F.col("with_")))

    own = lambda x, y: ((F.col("lot") != F.col("with")) | (x["node"] < y["node"])) & screen(x["value"], y["value"])
    found = spanning(F.col("xs"), F.col("ys"), lambda x, y: F.when(own(x, y), confirm(x["value"], y["value"])).otherwise(F.lit(False)))
    # outer: else a filter on the array's size is added, which finds all links twice
    more = cut(met.select(F.explode_outer(found).alias("p")).where("p IS NOT NULL").select("p.a", "p.b").distinct())
    return labels if more.isEmpty() else components(links.unionByName(more))
