"""Graph operators over edges (src, dst, kind, confidence).

Closures are semi-naive: each round joins only what the last one found, and the state is cut every round. Edges are written once
in buckets of their source (``components.Steps``), so rounds move frontiers only.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import Pile, cut, in_order, lack, one_per, running
from .components import Steps

#: Fixed values of the graph's schema.
EDGE_KINDS = ("calls", "imports", "contains", "routes_to")
CONFIDENCES = ("resolved", "heuristic", "unknown")
DFS_KINDS = ("calls", "contains")
#: Seeds that fit into the bits of a row.
BITS = 62


def of_kind(edges: DataFrame, kinds: Iterable[str] = EDGE_KINDS) -> DataFrame:
    """Edges of some kinds."""
    return edges.where(F.col("kind").isin(*kinds))


def uncertain(edges: DataFrame) -> DataFrame:
    """Edges that aren't resolved; a missing confidence counts."""
    return edges.where(~F.col("confidence").eqNullSafe("resolved"))


def closure(seeds: DataFrame, edges: DataFrame, kinds: Iterable[str] = EDGE_KINDS) -> DataFrame:
    """(seed, node) of all nodes that can be reached from each seed (column node of ``seeds``), itself included."""
    frontier = cut(seeds.select(F.col("node").alias("seed"), "node").distinct())
    few = frontier.select("seed").limit(BITS + 1).collect()
    steps = Steps(of_kind(edges, kinds))
    if len(few) <= BITS:
        return marked_closure(frontier, steps, sorted((r["seed"] for r in few), key=lambda x: (x is None, x)))
    seen = Pile(frontier)
    while n := frontier.count():
        step = steps.follow(frontier, n).select("seed", F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(seen.all(), ["seed", "node"], "left_anti"))
        seen.add(frontier)
    steps.close()
    return seen.all()


def marked_closure(seeds: DataFrame, steps: Steps, names: list) -> DataFrame:
    """``closure`` of at most ``BITS`` seeds: a node's row has a bit for each seed that reaches it, so shared nodes are walked once."""
    bits = F.create_map(*(F.lit(x) for i, n in enumerate(names) if n is not None for x in (n, 1 << i))) if any(n is not None for n in names) else F.lit(None)
    frontier = cut(seeds.where("seed IS NOT NULL").select("node", bits[F.col("seed")].cast("bigint").alias("mask")) if any(n is not None for n in names) else seeds.select("node", F.lit(0).cast("bigint").alias("mask")).limit(0))
    seen = Pile(frontier)
    while n := frontier.count():
        step = steps.follow(frontier, n).groupBy(F.col("dst").alias("node")).agg(F.bit_or("mask").alias("mask"))
        known = seen.all().groupBy("node").agg(F.bit_or("mask").alias("had"))
        new = step.join(known, "node", "left").select("node", F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("had", F.lit(0).cast("bigint")))).alias("mask"))
        frontier = cut(new.where("mask <> 0"))
        seen.add(frontier)
    steps.close()
    held = F.filter(F.array(*(F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) != 0, F.lit(n)) for i, n in enumerate(names))), lambda x: x.isNotNull()) if names else F.array().cast("array<string>")
    return seen.all().select(F.explode(held).alias("seed"), "node")


def reachable(seeds: DataFrame, edges: DataFrame, kinds: Iterable[str] = EDGE_KINDS) -> DataFrame:
    """G1: (node) that any seed reaches; one closure for all seeds together."""
    one = seeds.select("node").distinct()
    return closure_from_set(one, of_kind(edges, kinds).select("src", "dst"))


def closure_from_set(nodes: DataFrame, steps: DataFrame, written: Steps | None = None) -> DataFrame:
    """(node) of the closure of a set under (src, dst); ``written`` are the same edges, if a caller has them in buckets already."""
    held = written or Steps(steps)
    frontier = cut(nodes.select("node").distinct())
    seen = Pile(frontier)
    while n := frontier.count():
        step = held.follow(frontier, n).select(F.col("dst").alias("node")).distinct()
        frontier = cut(lack(step, seen.all(), ["node"]))
        seen.add(frontier)
    if written is None:
        held.close()
    return seen.all()


def unreached(nodes: DataFrame, reached: DataFrame) -> DataFrame:
    """Candidates for dead code."""
    return lack(nodes, reached, ["node"])


def cone(start: DataFrame, edges: DataFrame, up: bool = False) -> DataFrame:
    """Callees (or callers) of a node in any number of steps, without itself even on a cycle."""
    steps = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if up else edges.select("src", "dst")
    return lack(closure_from_set(start, steps.distinct()), start, ["node"])


def descendants(start: DataFrame, edges: DataFrame, up: bool = False) -> DataFrame:
    """Like ``cone``, but a start on a cycle is its own descendant."""
    steps = cut((edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if up else edges.select("src", "dst")).distinct())
    first = steps.join(start.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
    return closure_from_set(first, steps)


def distances(start: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, distance) in undirected steps; nodes that aren't there have no path (-1 for callers that need a value)."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    both = cut(both)
    # undirected steps from the last level lead to it, the one before, or to new nodes: no more has to be kept in sight
    frontier = cut(start.select("node", F.lit(0).alias("distance")).distinct())
    seen, before, d = Pile(frontier), frontier, 0
    while True:
        d += 1
        step = frontier.join(both, frontier["node"] == both["src"]).select(F.col("dst").alias("node")).distinct()
        before, frontier = frontier, cut(lack(step, before.unionByName(frontier), ["node"]).withColumn("distance", F.lit(d)))
        if frontier.isEmpty():
            return seen.all()
        seen.add(frontier)


def pair_distances(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """G14 for all pairs of a small graph: (a, b, distance)."""
    both = cut(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    frontier = cut(nodes.select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0).alias("distance")).distinct())
    seen, before, d = Pile(frontier), frontier, 0
    while True:
        d += 1
        step = frontier.join(both, frontier["b"] == both["src"]).select("a", F.col("dst").alias("b")).distinct()
        before, frontier = frontier, cut(step.join(before.unionByName(frontier), ["a", "b"], "left_anti").withColumn("distance", F.lit(d)))
        if frontier.isEmpty():
            return seen.all()
        seen.add(frontier)


def depths(nodes: DataFrame, edges: DataFrame, cap: int = 12) -> DataFrame:
    """(node, depth): longest path from a source, by rounds of 1 + the parents' maximum; capped, so cycles end.

    Self loops don't count. Sources and nodes that no source reaches have 0. The cap is min(cap, max(1, nodes - 1)).
    """
    known = cut(nodes.select("node").distinct())
    n = known.count()
    top = min(cap, max(1, n - 1))
    held = Steps(edges.select("src", "dst").where("src <> dst"))  # an edge is moved once, here
    steps = held.edges
    # level d: nodes at the end of some path of d edges from a source. A node's depth is the last level that has it, so levels
    # are written once and nothing is compared with what is known; level `top` is where all longer paths end
    sources = lack(known, steps.select(F.col("dst").alias("node")), ["node"])
    now = cut(sources.withColumn("depth", F.lit(0)))
    seen = Pile(now)
    for d in range(1, top + 1):
        now = cut(held.follow(now, now.count()).select(F.col("dst").alias("node")).distinct().withColumn("depth", F.lit(d)))
        if now.isEmpty():
            break
        seen.add(now)
    else:  # what can be reached from the last level has longer paths still
        seen.add(cut(lack(closure_from_set(now.select("node"), steps, held), now, ["node"]).withColumn("depth", F.lit(top))))
    held.close()
    deepest = seen.all().groupBy("node").agg(F.max("depth").alias("depth"))
    return known.join(deepest, "node", "left").select("node", F.coalesce("depth", F.lit(0)).alias("depth"))


def limited_children(edges: DataFrame, most: int) -> DataFrame:
    """The first distinct children of each node in name order: (src, dst, nth)."""
    order = Window.partitionBy("src").orderBy("dst")
    return edges.select("src", "dst").distinct().withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)


def visit_order(starts: DataFrame, edges: DataFrame, max_depth: int = 32, most_children: int = 64, kinds: Iterable[str] = DFS_KINDS, most_rows: int | None = None) -> DataFrame:
    """(seq, action, node, depth) of a depth-first walk from (ord, node).

    Children go by name, at most ``most_children`` each; a node on the current path isn't entered again, so a shared node is
    visited once per path. The number of paths can explode, as the walk's definition has it; a caller that can't want that
    may have a walk of more than ``most_rows`` nodes refused.
    """
    children = cut(limited_children(of_kind(edges, kinds), most_children))
    # a node of the walk has a number in its level; what is on its path are rows, of the last level alone
    at = F.monotonically_increasing_id().alias("at")
    level = cut(starts.select(at, F.lit(None).cast("bigint").alias("up"), F.col("ord").cast("bigint").alias("nth"), "node"))
    path = level.select("at", "node")
    levels, total = [level], level.count()
    for _ in range(max_depth):
        step = level.select(F.col("at").alias("up"), F.col("node").alias("src")).join(children, "src").select("up", "nth", F.col("dst").alias("node"))
        step = step.join(path.withColumnRenamed("at", "up"), ["up", "node"], "left_anti")
        level = cut(step.select(at, "up", F.col("nth").cast("bigint").alias("nth"), "node"))
        n = level.count()
        total += n
        if most_rows is not None and total > most_rows:
            raise ValueError(f"the walk visits more than {most_rows} nodes")
        if not n:
            break
        levels.append(level)
        path = cut(level.select("at", "node").unionByName(level.select(F.col("at").alias("to"), F.col("up").alias("at")).join(path, "at").select(F.col("to").alias("at"), "node")))
    # how many nodes the walk visits from each on, from the deepest level up; then when it comes to each, from the starts down
    sized, below = [], None
    for level in reversed(levels):
        size = F.lit(1).cast("bigint")
        own = level.withColumn("size", size) if below is None else level.join(below, "at", "left").select(*level.columns, (size + F.coalesce("beneath", F.lit(0))).alias("size"))
        sized.append(cut(own))
        below = sized[-1].groupBy(F.col("up").alias("at")).agg(F.sum("size").alias("beneath"))
    first, found = running(sized[-1].withColumn("key", F.struct("nth", "node", "at")), "key", "size"), None
    now = cut(first.select("at", "node", "size", (2 * F.col("below")).alias("enter")))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("up").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # siblings
    for d, level in enumerate([*sized[-2::-1], None]):
        events = now.select(F.lit("enter").alias("action"), "node", F.lit(d).alias("depth"), "enter").unionByName(now.select(F.lit("exit").alias("action"), "node", F.lit(d).alias("depth"), (F.col("enter") + 2 * F.col("size") - 1).alias("enter")))
        found = events if found is None else found.unionByName(events)
        if level is not None:
            placed = level.withColumn("before", before).join(now.select(F.col("at").alias("up"), F.col("enter").alias("from")), "up")
            now = cut(placed.select("at", "node", "size", (F.col("from") + 1 + 2 * F.col("before")).alias("enter")))
    return found.select((F.col("enter") + 1).cast("int").alias("seq"), "action", "node", "depth")


def peaks_and_orphans(nodes: DataFrame, edges: DataFrame, fallback: bool = False) -> DataFrame:
    """(node, is_peak, is_orphan): a peak has no callers, an orphan no callees either.

    With ``fallback``, as a map needs a peak: if every node has callers, the first one (by ord if there is that column, else by
    name) is the peak; if no peak has callees, none is an orphan.
    """
    out = edges.select(F.col("src").alias("node")).distinct().withColumn("calls", F.lit(True))
    into = edges.select(F.col("dst").alias("node")).distinct().withColumn("called", F.lit(True))
    known = nodes.select("node").distinct().join(out, "node", "left").join(into, "node", "left")
    out = known.select("node", F.col("called").isNull().alias("is_peak"), (F.col("called").isNull() & F.col("calls").isNull()).alias("is_orphan"))
    if not fallback:
        return out
    out = cut(out)
    first = nodes.agg(F.min_by("node", "ord" if "ord" in nodes.columns else "node").alias("first"))
    found = out.agg(F.coalesce(F.max("is_peak"), F.lit(False)).alias("any"), F.coalesce(F.max(F.col("is_peak") & ~F.col("is_orphan")), F.lit(False)).alias("joined"))
    return out.crossJoin(F.broadcast(first)).crossJoin(F.broadcast(found)).select("node", F.when(F.col("any"), F.col("is_peak")).otherwise(F.col("node") == F.col("first")).alias("is_peak"), (F.col("is_orphan") & F.col("joined")).alias("is_orphan"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, n_callers, n_callees) over distinct edges between known nodes."""
    known = nodes.select("node").distinct()
    inside = edges.select("src", "dst").distinct().join(known.withColumnRenamed("node", "src"), "src", "left_semi").join(known.withColumnRenamed("node", "dst"), "dst", "left_semi")
    out = inside.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_callees"))
    into = inside.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n_callers"))
    return known.join(into, "node", "left").join(out, "node", "left").select("node", F.coalesce("n_callers", F.lit(0)).cast("bigint").alias("n_callers"), F.coalesce("n_callees", F.lit(0)).cast("bigint").alias("n_callees"))


def inverted(edges: DataFrame) -> DataFrame:
    """Callers by callee."""
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()


def subtree_sizes(tree: DataFrame) -> DataFrame:
    """(node, size) of a forest given as (parent, node); a node counts itself.

    Levels from the roots down, then sums from the deepest level up: a row for each node, never one for each ancestor.
    """
    steps = cut(tree.where("parent IS NOT NULL").select("parent", "node").distinct())
    everyone = tree.select("node").unionByName(steps.select(F.col("parent").alias("node"))).distinct()
    now = cut(lack(everyone, steps.select("node"), ["node"]).select(F.lit(None).cast(steps.schema["parent"].dataType).alias("parent"), "node"))
    levels = []
    while not now.isEmpty():
        levels.append(now)
        now = cut(now.select(F.col("node").alias("parent")).join(steps, "parent").select("parent", "node"))
    below, out = None, None
    for level in reversed(levels):
        sized = level.withColumn("size", F.lit(1).cast("bigint")) if below is None else level.join(below, "node", "left").select("parent", "node", (F.lit(1) + F.coalesce("beneath", F.lit(0))).alias("size"))
        sized = cut(sized)
        below = sized.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.sum("size").alias("beneath"))
        out = Pile(sized) if out is None else out
        if out.parts[-1] is not sized:
            out.add(sized)
    return (out.all() if out else everyone.select(F.lit(None).alias("parent"), "node", F.lit(1).cast("bigint").alias("size"))).select("node", "size")


def primary_tree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(parent, node, level): breadth-first spanning forest from the peaks with callees; parent null for a root. If there is
    none of these, from all peaks; if there is no peak either, from the first node, which no caller then places.

    The walk's queue serves nodes in the order in which they were placed, each node's callees by name; a callee is placed
    by the node served if no caller with a smaller name is placed by then. Level by level, as joins: of the callers placed
    before a level is served, only the smallest-named can place a callee, at (its place in the queue, callee). That fails if a
    smaller-named caller is itself placed earlier in the same level, which is decided in rounds, earliest first. A node's place in
    its level's queue is a number, so rows don't grow with the level.
    """
    known = cut(nodes.select("node").distinct())
    held = Steps(edges.where("src <> dst").select("src", "dst"), known.withColumnRenamed("node", "src"))
    steps = held.edges
    # only who has more than one caller can have a smaller-named one that comes earlier
    shared = cut(steps.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n")).where("n > 1").select("node"))
    # without a node that calls and isn't called, all peaks are roots; without a peak the first node is
    peaks = peaks_and_orphans(nodes, steps, fallback=True)
    roots = cut(peaks.where("is_peak AND NOT is_orphan").select("node"))
    now = in_order(roots.select(F.lit(None).cast("string").alias("parent"), "node", F.lit(0).alias("level")), "node").withColumnRenamed("nth", "place")
    placed, level = Pile(cut(now.select("parent", "node", "level"))), 0
    waiting = None  # (node, least): callees that callers placed so far have failed to place
    while not now.isEmpty():
        level += 1
        # a node's callers make one row before anything moves to the placed ones
        near = held.follow(now.select("node", "place"), now.count()).select(F.col("dst").alias("to"), "src", "place")
        near = near.groupBy(F.col("to").alias("node")).agg(F.min(F.struct("src", "place")).alias("by")).select("node", F.col("by.src").alias("parent"), "by.place")
        near = lack(near, placed.all(), ["node"])
        near = near if waiting is None else near.join(waiting, "node", "left").where("least IS NULL OR parent < least").drop("least")
        tried = cut(near)
        # a callee's smaller-named callers that come earlier in the same level
        x, c = tried.select(F.col("node").alias("src"), F.col("place").alias("xplace")), tried.select(F.col("node").alias("dst"), "parent", "place")
        before = (F.col("xplace") < F.col("place")) | (F.col("xplace") == F.col("place")) & (F.col("src") < F.col("dst"))
        c = cut(c.join(shared.withColumnRenamed("node", "dst"), "dst", "left_semi"))
        open_, failed = tried.select("node"), None
        bars = None if c.isEmpty() else cut(held.follow(x.withColumnRenamed("src", "node"), x.count()).select("src", "dst", "xplace").join(c, "dst").where((F.col("src") < F.col("parent")) & before).select("src", "dst"))
        while bars is not None and not bars.isEmpty():
            free = lack(open_, bars.select(F.col("dst").alias("node")), ["node"])
            lost = cut(bars.join(free.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node")).distinct())
            failed = lost if failed is None else cut(failed.unionByName(lost))
            out = lost.select(F.col("node").alias("dst"))
            # lost ones bar nobody and wait no longer; the free ones have barred all they can
            bars = cut(lack(lack(bars, out, ["dst"]), out.withColumnRenamed("dst", "src"), ["src"]))
            open_ = cut(lack(open_, lost, ["node"]))
        done = tried if failed is None else lack(tried, failed, ["node"])
        now = cut(in_order(done.select("parent", "node", F.lit(level).alias("level"), "place"), "place", "node").drop("place").withColumnRenamed("nth", "place"))
        if failed is not None:
            late = tried.join(failed, "node", "left_semi").select("node", F.col("parent").alias("least"))
            waiting = late if waiting is None else waiting.unionByName(late)
            waiting = cut(waiting.groupBy("node").agg(F.min("least").alias("least")))
        placed.add(now.select("parent", "node", "level"))
    held.close()
    return placed.all()


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, part): part is the smallest node of the weakly connected component."""
    both = cut(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    label = cut(nodes.select("node", F.col("node").alias("part")))
    while True:
        near = both.join(label, both["dst"] == label["node"]).groupBy("src").agg(F.min("part").alias("near"))
        lower = label.join(near.withColumnRenamed("src", "node"), "node", "left").select("node", F.least("part", F.coalesce("near", "part")).alias("to"), "part")
        jump = lower.select(F.col("node").alias("to"), F.col("to").alias("further"))
        new = cut(lower.join(jump, "to", "left").select("node", F.coalesce("further", "to").alias("to"), "part"))
        label = new.select("node", F.col("to").alias("part"))
        if new.where("to <> part").isEmpty():
            return label


def tier_texts(start: DataFrame, edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(seed, text): a node's source and those of its descendants in order of distance, joined by empty lines."""
    near = cut(start.select(F.col("node").alias("seed"), "node", F.lit(0).alias("level")))
    seen, steps, level = Pile(near), cut(edges.select("src", "dst").distinct()), 0
    while not near.isEmpty():
        level += 1
        step = near.join(steps, near["node"] == steps["src"]).select("seed", F.col("dst").alias("node")).distinct()
        near = cut(step.join(seen.all(), ["seed", "node"], "left_anti").withColumn("level", F.lit(level)))
        seen.add(near)
    texts = seen.all().join(sources.select("node", "source"), "node").groupBy("seed").agg(F.array_sort(F.collect_list(F.struct("level", "node", "source"))).alias("s"))
    return texts.select("seed", F.array_join(F.transform("s", lambda x: x["source"]), "\n\n").alias("text"))


def split_pairs(tree: DataFrame) -> DataFrame:
    """(parent, a, b): unordered pairs of siblings."""
    a, b = tree.select("parent", F.col("node").alias("a")), tree.select("parent", F.col("node").alias("b"))
    return a.join(b, "parent").where("parent IS NOT NULL AND a < b")


def walked_edges(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges that leave a node that a walk from the starts visits, also to nodes visited before."""
    seen = closure_from_set(starts, edges.select("src", "dst").distinct())
    return edges.select("src", "dst").distinct().join(seen.withColumnRenamed("node", "src"), "src", "left_semi")


def predicted_walk(starts: DataFrame, scored: DataFrame, least: float = 0.55, branches: int = 2, max_depth: int = 10) -> DataFrame:
    """(src, dst, score, depth) of a walk over scored edges: the best ``branches`` of each node, of these the ones that
    reach ``least``, fewer than ``max_depth`` steps deep, each node once."""
    order = Window.partitionBy("src").orderBy(F.desc("score"), "dst")
    best = cut(scored.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= branches).where(F.col("score") >= least).select("src", "dst", "score"))
    near = seen = cut(starts.select("node"))
    out = None
    for depth in range(max_depth):
        step = cut(near.join(best, near["node"] == best["src"]).select("src", "dst", "score", F.lit(depth).alias("depth")))
        if step.isEmpty():
            break
        out = step if out is None else out.unionByName(step)
        near = cut(lack(step.select(F.col("dst").alias("node")).distinct(), seen, ["node"]))
        seen = cut(seen.unionByName(near))
    return out if out is not None else best.withColumn("depth", F.lit(0)).limit(0)


def entry_node(nodes: DataFrame, entry: str) -> DataFrame:
    """The node of that name, else the first (by ord) that ends with it as last segments."""
    rank = F.when(F.col("node") == entry, 0).when(F.col("node").endswith("." + entry), 1)
    return one_per(nodes.withColumn("rank", rank).where("rank IS NOT NULL").withColumn("__all", F.lit(1)), ["__all"], F.col("rank"), F.col("ord")).select("node")
