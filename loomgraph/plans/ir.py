"""From a source tree to the execution graph: scan, parse, resolve, number, rank, validate."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import cut
from ..functions.text import function_id, structural_name
from ..operators import entrypoints as ranking
from ..operators import overlay, resolve, validate
from ..sources import documents, python_facts, script_facts, tree

BOUNDARY, SCRIPT_BOUNDARY = "py:boundary:unresolved", "ts:boundary:unresolved"
UNKNOWN_EVIDENCE = "unresolved_name_or_attribute_call"
INDEX_META = {
    "completeness": "partial",
    "engine": "ast",
    "known_limits": ["No types: calls on objects stay unresolved.", "Only static import statements are seen.", "Dynamic imports and reflection are invisible."],
}
SCRIPT_META = {
    "completeness": "partial",
    "engine": "tokens",
    "known_limits": ["No grammar: declarations are read from paired brackets.", "Dynamic imports and require() are not followed.", "Functions in object literals are no symbols."],
}


@dataclass(frozen=True)
class Raw:
    """Relations of an indexed repository."""

    root: str
    files: DataFrame
    symbols: DataFrame
    imports: DataFrame
    calls: DataFrame
    found: DataFrame
    language: str = "python"


@dataclass(frozen=True)
class CodeGraph:
    """nodes (node, kind, language, label, path, start_line, end_line, raw_symbol_id, ord), edges (W2 plus evidence, snippet,
    callee_expression, import_ref), entrypoints (node, tier, ord)."""

    nodes: DataFrame
    edges: DataFrame
    entrypoints: DataFrame
    language: str = "python"


def index_scripts(spark: SparkSession, root: str | Path, starts: list[str] | None = None) -> Raw:
    """TypeScript and JavaScript files; one scan and one reading for everything that follows."""
    found = cut(script_facts.facts(tree.hashed(tree.script_files(spark, str(root), starts))))
    return Raw(str(Path(root).resolve()), python_facts.file_rows(found), python_facts.symbol_rows(found), script_facts.import_rows(found), python_facts.call_rows(found), found, "typescript")


def index(spark: SparkSession, root: str | Path, starts: list[str] | None = None) -> Raw:
    """V4: by the language of the tree."""
    return (index_python if tree.language_of(root) == "python" else index_scripts)(spark, root, starts)


def index_python(spark: SparkSession, root: str | Path, starts: list[str] | None = None) -> Raw:
    """One scan and one parse for everything that follows; the result is cut, so nothing is parsed twice."""
    found = cut(python_facts.facts(tree.hashed(tree.python_files(spark, str(root), starts))))
    return Raw(str(Path(root).resolve()), python_facts.file_rows(found), python_facts.symbol_rows(found), python_facts.import_rows(found), python_facts.call_rows(found), found)


def build_graph(raw: Raw, configured: DataFrame | None = None, strict: bool = True) -> CodeGraph:
    """V4: the execution graph of a Python or script index. ``strict`` refuses two functions of one qualified name; else the last one counts."""
    script = raw.language != "python"
    own, boundary = ("ts", SCRIPT_BOUNDARY) if script else ("py", BOUNDARY)
    symbols = raw.symbols.where("kind IN ('function', 'async_function') AND qualified_name <> ''")
    known = cut(resolve.callable_symbols(raw.symbols))
    if not strict:
        symbols = known
    nodes = symbols.select(
        function_id(F.col("qualified_name"), own).alias("node"), F.lit("function").alias("kind"), F.lit(raw.language).alias("language"), F.col("qualified_name").alias("label"), "path",
        F.col("line").alias("start_line"), F.coalesce("end_line", "line").alias("end_line"), F.col("id").alias("raw_symbol_id"), "ord",
    )
    names = raw.calls.where("form = 'name'")
    if script:
        answered = resolve.resolve_script_names(names.select("call", "name", "scope", "module", "target"), known)
        sites = raw.calls.withColumn("is_builtin", F.lit(False)).withColumn("snippet", F.lit(None).cast("string"))
    else:
        answered, sites = resolve.resolve_names(names.select("call", "name", "scope", "target"), known), raw.calls
    calls = resolve.classify_calls(sites.join(answered.select("call", "resolved"), "call", "left"))
    calls = cut(calls.where("confidence IS NOT NULL"))
    sure = calls.where("confidence = 'resolved'").select(function_id(F.col("caller"), own).alias("src"), function_id(F.col("resolved"), own).alias("dst"))
    unknown = calls.where("confidence = 'unknown'").select(function_id(F.col("caller"), own).alias("src"), F.lit(boundary).alias("dst"), "line", F.coalesce("name", "expression").alias("callee"), "visit", "snippet", F.col("expression").alias("callee_expression"), F.when(F.col("form") == "name", F.col("target")).alias("import_ref"), F.col("name").alias("callee_name"))
    holds = resolve.contains_edges(known).select(function_id(F.col("src"), own).alias("src"), function_id(F.col("dst"), own).alias("dst"))
    edges = number(holds, sure, unknown)
    edge = nodes.select(F.lit(boundary).alias("node"), F.lit("dynamic_callsite").alias("kind"), F.lit(raw.language).alias("language"), F.lit("Unresolved / not traced (ts v0)" if script else "unresolved / not traced (v0)").alias("label"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"), F.lit(None).cast("string").alias("raw_symbol_id"), F.lit(2**62).cast("bigint").alias("ord"))
    if not unknown.isEmpty():
        nodes = nodes.unionByName(edge.limit(1))
    edges = cut(edges)
    points = ranking.detect(nodes, edges.withColumnRenamed("callee_name", "__callee").withColumn("callee", F.col("__callee")).drop("__callee"), configured)
    if strict:
        validate.require_valid(nodes, edges, points)
    return CodeGraph(nodes, edges, points, raw.language)


def number(holds: DataFrame, sure: DataFrame, unknown: DataFrame) -> DataFrame:
    """W2 with the call sites' details."""
    numbered = resolve.numbered_edges(holds, sure, unknown.select("src", "dst", "line", "callee", "visit")).withColumn("nth", F.expr("row_number() OVER (PARTITION BY src, line, callee ORDER BY CAST(substring(id, 3) AS BIGINT))"))
    details = unknown.withColumn("nth", F.expr("row_number() OVER (PARTITION BY src, line, callee ORDER BY visit)"))
    details = details.select(F.col("src").alias("s"), F.col("line").alias("l"), F.col("callee").alias("c"), F.col("nth").alias("n"), "snippet", "callee_expression", "import_ref", "callee_name")
    same = (F.col("src") == F.col("s")) & (F.col("line") == F.col("l")) & (F.col("callee") == F.col("c")) & (F.col("nth") == F.col("n")) & (F.col("confidence") == "unknown")
    return numbered.join(details, same, "left").drop("s", "l", "c", "n", "nth", "callee").withColumn("evidence", F.when(F.col("confidence") == "unknown", UNKNOWN_EVIDENCE))


def raw_document(raw: Raw) -> dict:
    """The RAW document: an export, so it is collected."""
    def clean(row) -> dict:
        return {k: (clean(v) if hasattr(v, "asDict") else v) for k, v in row.asDict().items() if v is not None}

    return {
        "schema_version": 0, "indexer": "python_ast_v0" if raw.language == "python" else "script_tokens_ts_v0", "index_meta": INDEX_META if raw.language == "python" else SCRIPT_META, "root": raw.root,
        "files": [clean(r) for r in raw.files.orderBy("path").collect()],
        "symbols": [clean(r) for r in raw.symbols.orderBy("ord").drop("path", "ord").collect()],
        "edges": [clean(r) for r in raw.imports.orderBy("from_file", "line").drop(*(["from_file"] if raw.language != "python" else [])).collect()],
    }


def graph_document(raw: Raw, graph: CodeGraph) -> dict:
    """The IR document."""
    nodes = []
    for r in graph.nodes.orderBy("ord").collect():
        n = {k: r[k] for k in ("kind", "language", "label")} | {"id": r["node"]}
        nodes.append(n | ({"location": {"path": r["path"], "start_line": r["start_line"], "end_line": r["end_line"]}, "raw_symbol_id": r["raw_symbol_id"]} if r["path"] else {}))
    edges = []
    for r in graph.edges.orderBy(F.expr("CAST(substring(id, 3) AS BIGINT)")).collect():
        site = {"line": r["line"], "snippet": r["snippet"], "callee": r["callee_name"], "callee_expression": r["callee_expression"], "import_ref": r["import_ref"]} if r["confidence"] == "unknown" else None
        e = {"id": r["id"], "from": r["src"], "to": r["dst"], "kind": r["kind"], "confidence": r["confidence"]}
        edges.append(e | ({"evidence": r["evidence"], "callsite": {k: v for k, v in site.items() if v is not None}} if site else {}))
    points = [r["node"] for r in graph.entrypoints.orderBy("ord").collect()]
    return {"schema_version": 0, "repo_root": raw.root, "languages": [graph.language], "entrypoints": points, "producers": [{"name": "loomgraph", "version": "0"}], "nodes": nodes, "edges": edges}


def generate_graph(spark: SparkSession, root: str | Path, overlay_path: str | Path | None = None, config: dict | None = None, provider=None) -> dict:
    """Everything about a repository: raw, nodes, edges, entrypoints, overlay by node, use cases.

    ``provider`` (prompt -> answer) may name the use cases; without one, or where it fails, structural names stay.
    """
    raw = index(spark, root)
    ids = ((config or {}).get("entrypoints") or {}).get("ids") or []
    graph = build_graph(raw, spark.createDataFrame(list(enumerate(ids)), "ord int, node string") if ids else None)
    ir = graph_document(raw, graph)
    if overlay_path is not None:
        entries = documents.load_overlay(overlay_path)["by_flow_node_id"]
    else:
        cases = overlay.use_cases(graph.nodes, graph.edges, graph.entrypoints)
        entries = {r["id"]: {k: v for k, v in r.asDict().items() if k != "id" and v is not None} for r in cases.collect()}
        if provider is not None:
            for r in overlay.label_entries(overlay.prompts(graph.nodes, graph.edges, graph.entrypoints), provider).collect():
                entries[r["id"]] |= {k: r[k] for k in ("displayName", "userDescription") if r[k]}
    cases = [{"id": i, **e} for i, e in entries.items() if e.get("use_case")]
    return {"raw": raw_document(raw), "nodes": ir["nodes"], "edges": ir["edges"], "entrypoints": ir["entrypoints"], "languages": ir["languages"], "overlay": {"by_flow_node_id": entries}, "use_cases": sorted(cases, key=lambda c: c["id"])}


def named(nodes: DataFrame) -> DataFrame:
    """F1 for all nodes."""
    return nodes.withColumn("displayName", structural_name(F.col("label")))
