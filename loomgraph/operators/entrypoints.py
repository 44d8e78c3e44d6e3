"""Entrypoint detection (E0-E6): tiers of nodes, ranked."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import have, lack

#: Dotted ends of factory functions, receivers of route decorators.
FACTORY_ENDS = (".create_app", ".create_application", ".make_app", ".build_app", ".init_app")
ROUTE_STARTS = ("app.", "router.", "blueprint.", "api.")


def main_nodes(nodes: DataFrame) -> DataFrame:
    """E2."""
    return nodes.where((F.col("label") == "main") | F.col("label").endswith(".main"))


def factory_nodes(nodes: DataFrame) -> DataFrame:
    """A bare name doesn't fit, only one after a dot."""
    fits = F.lit(False)
    for end in FACTORY_ENDS:
        fits = fits | F.col("label").endswith(end)
    return nodes.where(fits)


def unknown_callees(edges: DataFrame) -> DataFrame:
    """A3: (node, callee) of unresolved calls."""
    text = F.coalesce("callee_expression", "callee")
    return edges.where("kind = 'calls' AND confidence = 'unknown'").select(F.col("src").alias("node"), text.alias("callee")).where("coalesce(callee, '') <> ''")


def contained(edges: DataFrame) -> DataFrame:
    """(node) of nodes that another holds for certain."""
    return edges.where("kind = 'contains' AND confidence = 'resolved'").select(F.col("dst").alias("node")).distinct()


def route_handlers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that nothing holds and that call something on an application, router, blueprint or api."""
    starts = F.lit(False)
    for s in ROUTE_STARTS:
        starts = starts | F.col("callee").startswith(s)
    return have(lack(nodes, contained(edges), ["node"]), unknown_callees(edges).where(starts), ["node"])


def package_api(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes in a package's init module that nothing holds."""
    path = F.coalesce("path", F.lit(""))
    return lack(nodes, contained(edges), ["node"]).where((path == "__init__.py") | path.endswith("/__init__.py"))


def detect(nodes: DataFrame, edges: DataFrame, configured: DataFrame | None = None) -> DataFrame:
    """(node, tier, ord) of nodes (node, label, path, kind, ord) and edges.

    Configured ids (node, ord) that exist are exclusive: in their order, repetitions included, tier 1. Else the union of
    main (2), factory (3), route handler (4) and package API (5), each node in its first tier. Else the first real
    node (6). Without nodes there are none.
    """
    if configured is not None:
        chosen = have(configured.select("node", "ord"), nodes, ["node"])
        if not chosen.isEmpty():
            return chosen.select("node", F.lit(1).alias("tier"), (F.row_number().over(Window.orderBy("ord")) - 1).alias("ord"))
    real = nodes.where("coalesce(kind, 'function') <> 'dynamic_callsite'")
    tiers = [(2, main_nodes(real)), (3, factory_nodes(real)), (4, route_handlers(real, edges)), (5, package_api(real, edges))]
    found = None
    for tier, rows in tiers:
        rows = rows.select("node", F.lit(tier).alias("tier"), F.col("ord").alias("at"))
        found = rows if found is None else found.unionByName(rows)
    found = found.groupBy("node").agg(F.min(F.struct("tier", "at")).alias("first")).select("node", "first.tier", "first.at")
    if found.isEmpty():
        found = real.where("node IS NOT NULL AND label IS NOT NULL").orderBy("ord").limit(1).select("node", F.lit(6).alias("tier"), F.col("ord").alias("at"))
    return found.select("node", "tier", (F.row_number().over(Window.orderBy("tier", "at")) - 1).alias("ord"))  # entrypoints are few and their order is the result
