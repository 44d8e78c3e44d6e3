"""Strongly connected components, condensed graphs, and edges that are moved once for a walk of many rounds."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import Pile, cut, in_order, shared_folder


class Steps:
    """Edges (src, dst) written once, in buckets by source: a round of a walk moves its frontier to them and never the edges.

    A frontier of up to ``SMALL`` rows goes to all tasks, which then read the edges where they lie; a larger one is shuffled
    to the buckets. With ``sources`` (src), only edges from there are kept. ``close`` drops the table; what was found by then must have been written.
    """

    SMALL = 5_000  # a broadcast is collected and built in the driver's memory, once a round

    def __init__(self, edges: DataFrame, sources: DataFrame | None = None) -> None:
        self.spark = edges.sparkSession
        self.name = f"steps_{uuid.uuid4().hex}"
        self.folder = f"{shared_folder(self.spark)}/{self.name}"
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        # rows that meet by source lie right for being made distinct too: one shuffle does for both
        rows = edges.select("src", "dst").where("src IS NOT NULL").repartition(n, "src").distinct()
        if sources is not None:
            rows = rows.join(sources, "src", "left_semi")
        rows.write.bucketBy(n, "src").sortBy("src").option("path", self.folder).saveAsTable(self.name)
        self.edges = self.spark.table(self.name)

    def follow(self, frontier: DataFrame, n: int) -> DataFrame:
        """``frontier`` (node, ...; n rows, written) with ``dst``: a row for each edge that leaves its node."""
        side = F.broadcast(frontier) if n <= self.SMALL else frontier.hint("shuffle_hash")
        return self.edges.join(side, self.edges["src"] == side["node"])

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Edges of a lot at most, on average where nodes are dealt into several; starts of a lot of walks, and pairs that a walk hands on at once.
LOT, STARTS, HANDED = 1 << 19, 1 << 13, 1 << 16
#: What a row of a lot says of node a: an edge to b, the least found so far, or a value sent to it.
EDGE, LEAST, SENT = 0, 1, 2


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, part): part is the smallest node of the strongly connected component. Ends of edges count as nodes."""
    ids, _, parts = numbered_components(nodes, edges)
    return parts.join(ids.withColumnRenamed("nth", "part_nth"), parts["part"] == F.col("part_nth")).select("nth", F.col("node").alias("part")).join(ids, "nth").select("node", "part")


def numbered_components(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(node, nth), (a, b) and (nth, part), all written: nodes numbered in their order, edges between different ones, and each node's component.

    Forward-backward colouring: every node gets the smallest node that reaches it as its colour. A component has one
    colour, so edges between colours go. A node of its own colour and what reaches it inside the colour are one component. Before that, edges
    from where nothing enters and to where nothing leaves go, as long as that takes away an eighth: their nodes are components of their own.
    Once what is left fits one lot, a task finds its components.
    """
    edges = cut(edges.select("src", "dst"))
    every = nodes.select("node").unionByName(edges.select(F.explode(F.array("src", "dst")).alias("node"))).where("node IS NOT NULL").distinct()
    ids = cut(in_order(every, "node"))
    number = lambda end, n: ids.select(F.col("node").alias(end), F.col("nth").alias(n))
    pairs = cut(edges.where("src <> dst").join(number("src", "a"), "src").join(number("dst", "b"), "dst").select("a", "b").distinct())
    left, n, done = pairs, pairs.count(), None
    while n > LOT:
        before = n
        inner = left.join(left.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(left.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
        left = cut(inner)
        n = left.count()
        if n <= LOT or n <= before * 7 // 8:
            continue
        colours = least_before(left, n)
        colour = lambda end, c: colours.select(F.col("node").alias(end), F.col("least").alias(c))
        left = cut(left.join(colour("a", "c"), "a").join(colour("b", "d"), "b").where("c = d").select("a", "b", F.col("c").alias("colour")))
        # the smallest that a node reaches inside its colour is the colour's own node, or the node doesn't reach that
        back = least_before(left.select(F.col("b").alias("a"), F.col("a").alias("b")), left.count())
        found = cut(colours.join(back, "node").where(colours["least"] == back["least"]).select(F.col("node").alias("nth"), back["least"].alias("part")))
        done = Pile(found) if done is None else done
        if done.parts[-1] is not found:
            done.add(found)
        gone = found.select("nth")
        left = cut(left.select("a", "b").join(gone.withColumnRenamed("nth", "a"), "a", "left_anti").join(gone.withColumnRenamed("nth", "b"), "b", "left_anti"))
        n = left.count()
    rest = left.groupBy().applyInArrow(parts_of_lot, "nth bigint, part bigint")
    found = done.all().unionByName(rest) if done else rest
    return ids, pairs, cut(ids.select("nth").join(found, "nth", "left").select("nth", F.coalesce("part", "nth").alias("part")))


def parts_of_lot(edges: pa.Table) -> pa.Table:
    """(nth, part) of the ends of one lot of edges (a, b), by depth first search."""
    a, b = edges.column("a").to_numpy(), edges.column("b").to_numpy()
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    source, target = at[: len(a)], at[len(a) :]
    bounds = np.searchsorted(np.sort(source), np.arange(len(nodes) + 1)).tolist()
    target = target[np.argsort(source, kind="stable")].tolist()
    part, index, low, open_, counted = [-1] * len(nodes), [-1] * len(nodes), [0] * len(nodes), [], 0
    for root in range(len(nodes)):
        if index[root] >= 0:
            continue
        path, places = [root], [bounds[root]]
        index[root] = low[root] = counted
        counted += 1
        open_.append(root)
        while path:
            node, place = path[-1], places[-1]
            if place < bounds[node + 1]:
                places[-1] = place + 1
                to = target[place]
                if index[to] < 0:
                    index[to] = low[to] = counted
                    counted += 1
                    open_.append(to)
                    path.append(to)
                    places.append(bounds[to])
                elif part[to] < 0:
                    low[node] = min(low[node], index[to])
                continue
            path.pop()
            places.pop()
            if path:
                low[path[-1]] = min(low[path[-1]], low[node])
            if low[node] == index[node]:
                first = len(open_) - 1
                while open_[first] != node:
                    first -= 1
                least = min(open_[first:])
                for member in open_[first:]:
                    part[member] = least
                del open_[first:]
    return pa.table({"nth": nodes, "part": nodes[np.array(part, np.int64)]})


def least_before(pairs: DataFrame, n: int) -> DataFrame:
    """(node, least), written: the smallest node that reaches it along the n pairs (a, b), itself included; only ends of pairs.

    Nodes are dealt into lots with the edges that leave them. In a round a lot sends values on inside itself as far as they go and to other
    lots once, so rounds are as many as the borders that a value must cross.
    """
    lots = max(1, -(-n // LOT))
    lot = lambda c: F.pmod(F.col(c), F.lit(lots)).cast("bigint").alias("lot")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("a")).distinct()
    rows = pairs.select(lot("a"), F.lit(EDGE).alias("kind"), "a", "b").unionByName(ends.select(lot("a"), F.lit(SENT).alias("kind"), "a", F.col("a").alias("b")))
    while True:
        rows = cut(rows.groupBy("lot").applyInArrow(lambda table: sent_on(table, lots), "lot bigint, kind int, a bigint, b bigint"))
        if rows.where(F.col("kind") == SENT).isEmpty():
            return rows.where(F.col("kind") == LEAST).select(F.col("a").alias("node"), F.col("b").alias("least"))


def sent_on(table: pa.Table, lots: int) -> pa.Table:
    """A lot after a round: its edges, its nodes' least values, and what it sends to nodes of other lots."""
    lot, kind, a, b = (table.column(c).to_numpy() for c in ("lot", "kind", "a", "b"))
    held, sent, edge = kind == LEAST, kind == SENT, kind == EDGE
    nodes = np.unique(np.concatenate([a[held], a[sent]]))
    least = np.full(len(nodes), np.iinfo(np.int64).max)
    least[np.searchsorted(nodes, a[held])] = b[held]
    was = least.copy()
    np.minimum.at(least, np.searchsorted(nodes, a[sent]), b[sent])
    source, target = a[edge], b[edge]
    own = target % lots == lot[0]
    x = np.searchsorted(nodes, source[own])
    order = np.argsort(x, kind="stable")
    y, bounds = np.searchsorted(nodes, target[own])[order], np.searchsorted(x[order], np.arange(len(nodes) + 1))
    lower = np.flatnonzero(least < was)
    while len(lower):
        many = bounds[lower + 1] - bounds[lower]
        ways = np.arange(many.sum()) + np.repeat(bounds[lower] - np.cumsum(many) + many, many)
        to = y[ways]
        now = least[to]
        np.minimum.at(least, to, np.repeat(least[lower], many))
        lower = np.unique(to[least[to] < now])
    x, to = np.searchsorted(nodes, source[~own]), target[~own]
    news = (least < was)[x] & (least[x] < to)
    to, value = to[news], least[x][news]
    order = np.lexsort((value, to))
    to, value = to[order], value[order]
    first = np.flatnonzero(np.diff(to, prepend=-1))
    to, value = to[first], value[first]
    whole = lambda *x: np.concatenate(x).astype(np.int64)
    kinds = np.repeat([EDGE, LEAST, SENT], [len(source), len(nodes), len(to)]).astype(np.int32)
    return pa.table({"lot": whole(np.full(len(source) + len(nodes), lot[0]), to % lots), "kind": kinds, "a": whole(source, nodes, to), "b": whole(target, least, value)})


def condensed(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """(src, dst): edges between components (node, part), once each; there is no cycle among them."""
    a, b = parts.select(F.col("node").alias("src"), F.col("part").alias("a")), parts.select(F.col("node").alias("dst"), F.col("part").alias("b"))
    return edges.select("src", "dst").distinct().join(a, "src").join(b, "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def closure_of_components(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """G1, G3 on graphs with cycles: (seed, node) as ``graph.closure`` has it, through the graph of components.

    Seeds of one component share its walk, a cycle takes no rounds, and pairs are components until the end. Null seeds reach
    nothing but themselves and are left out.
    """
    ids, parts, of, reached = reached_components(seeds, edges)
    named = reached.join(parts.withColumnRenamed("part", "to"), "to").join(ids, "nth").select("start", "node")
    return of.join(named, "start").select("seed", "node")


def reach_counts(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(seed, n): the number of nodes that ``closure_of_components`` has for each seed, from the sizes of components: no pair of nodes is a row."""
    _, parts, of, reached = reached_components(seeds, edges)
    sizes = parts.groupBy(F.col("part").alias("to")).agg(F.count("*").alias("size"))
    counts = reached.join(sizes, "to").groupBy("start").agg(F.sum("size").alias("n"))
    return of.join(counts, "start").select("seed", "n")


def reached_components(seeds: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(node, nth), (nth, part), (seed, start) and (start, to): nodes' numbers and components, seeds' components and what these reach."""
    wanted = cut(seeds.select(F.col("node").alias("seed")).where("seed IS NOT NULL").distinct())
    ids, pairs, parts = numbered_components(wanted.select(F.col("seed").alias("node")), edges)
    of = cut(wanted.join(ids, wanted["seed"] == ids["node"]).join(parts, "nth").select("seed", F.col("part").alias("start")))
    links = cut(condensed(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")), parts.withColumnRenamed("nth", "node")))
    return ids, parts, of, walked(of.select("start").distinct(), links)


def walked(starts: DataFrame, links: DataFrame) -> DataFrame:
    """(start, to), written: what each start (start) reaches along links (src, dst) without cycles, itself included.

    Links that fit one lot go to every lot of starts, whose task walks from one start after another; more are walked in rounds of joins.
    """
    starts = cut(starts)
    if links.count() <= LOT:
        lots = max(1, -(-starts.count() // STARTS))
        lot = F.pmod(F.xxhash64("start"), F.lit(lots))
        each = links.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(lots - 1).cast("bigint"))).alias("lot"), "src", "dst")
        rows = starts.select(lot.alias("lot"), F.col("start").alias("src"), F.lit(-1).cast("bigint").alias("dst")).unionByName(each)
        return cut(rows.groupBy("lot").applyInArrow(walks_of_lot, "start bigint, to bigint"))
    steps = Steps(links)
    frontier = cut(starts.select("start", F.col("start").alias("node")))
    seen = Pile(frontier)
    while n := frontier.count():
        step = steps.follow(frontier, n).select("start", F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(seen.all(), ["start", "node"], "left_anti"))
        seen.add(frontier)
    steps.close()
    return cut(seen.all().withColumnRenamed("node", "to"))


def walks_of_lot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(start, to) of the starts of a lot: rows whose dst is -1 are starts, the others all links."""
    rows = pa.Table.from_batches(list(batches))
    source, target = (rows.column(c).to_numpy() for c in ("src", "dst"))
    begins = target < 0
    starts, a, b = source[begins], source[~begins], target[~begins]
    nodes, at = np.unique(np.concatenate([starts, a, b]), return_inverse=True)
    first, a, b = np.split(at, [len(starts), len(starts) + len(a)])
    bounds, b = np.searchsorted(np.sort(a), np.arange(len(nodes) + 1)).tolist(), b[np.argsort(a, kind="stable")].tolist()
    last, many, found = [-1] * len(nodes), [], []
    batch = lambda n: pa.RecordBatch.from_pydict({"start": np.repeat(starts[n - len(many) : n], many), "to": nodes[np.array(found, np.int64)]})
    for n, start in enumerate(first.tolist()):
        last[start], todo, before = n, [start], len(found)
        while todo:
            node = todo.pop()
            found.append(node)
            for to in b[bounds[node] : bounds[node + 1]]:
                if last[to] != n:
                    last[to] = n
                    todo.append(to)
        many.append(len(found) - before)
        if len(found) >= HANDED:
            yield batch(n + 1)
            many, found = [], []
    if many:
        yield batch(len(starts))
