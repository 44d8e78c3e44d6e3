"""JSON documents in and out (S12, S14, K1-K6): overlays, snapshots, diagnostics, reports."""

from __future__ import annotations

import json
import shutil
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..operators.overlay import SCOPES


def load_json(path: str | Path) -> dict:
    return json.loads(Path(path).read_text("utf-8"))


def dump_json(doc: object) -> str:
    """K1-K3: two blanks of indent, sorted keys, a line feed at the end."""
    return json.dumps(doc, indent=2, sort_keys=True) + "\n"


def write_json(doc: object, out: str | Path | None) -> str:
    """Writes to ``out`` and makes its folders; returns the text."""
    text = dump_json(doc)
    if out is not None:
        Path(out).parent.mkdir(parents=True, exist_ok=True)
        Path(out).write_text(text, "utf-8")
    return text


def load_overlay(path: str | Path) -> dict:
    """An overlay document; a missing file has five empty maps."""
    doc = load_json(path) if Path(path).exists() else {}
    return doc | {s: doc.get(s) or {} for s in SCOPES}


def overlay_rows(spark: SparkSession, doc: dict) -> DataFrame:
    """Long form (scope, id, key, value); values are JSON text, so any type returns as it was. An entry without keys has a null key."""
    rows = [(s, i, k, None if v is None else json.dumps(v)) for s in SCOPES for i, e in (doc.get(s) or {}).items() for k, v in (e.items() if e else [(None, None)])]
    return spark.createDataFrame(rows, "scope string, id string, key string, value string")


def overlay_document(rows: DataFrame, version: int = 0) -> dict:
    """Back from long form; an overlay is one document, so it is collected."""
    doc: dict = {"schema_version": version} | {s: {} for s in SCOPES}
    for r in rows.collect():
        entry = doc[r["scope"]].setdefault(r["id"], {})
        if r["key"] is not None:
            entry[r["key"]] = None if r["value"] is None else json.loads(r["value"])
    return doc


def snapshot_frames(spark: SparkSession, doc: dict) -> tuple[DataFrame, DataFrame]:
    """(symbols, files) of a RAW document."""
    symbols = [(s["id"], s["kind"], s["name"], s["qualified_name"], s["file_id"], s["line"], s["end_line"]) for s in doc["symbols"]]
    files = [(f["id"], f["path"], f.get("sha256")) for f in doc["files"]]
    return spark.createDataFrame(symbols, "id string, kind string, name string, qualified_name string, file_id string, line int, end_line int"), spark.createDataFrame(files, "id string, path string, sha256 string")


def type_checker_report(root: str | Path, seconds: int = 120) -> dict | None:
    """The JSON report of a type checker on the PATH; None without one, or if it fails or takes too long."""
    for tool in ("basedpyright", "pyright"):
        if shutil.which(tool):
            try:
                run = subprocess.run([tool, "--outputjson", str(root)], capture_output=True, text=True, timeout=seconds, check=False)
                return json.loads(run.stdout)
            except (OSError, subprocess.TimeoutExpired, ValueError):
                continue
    return None


def diagnostic_rows(spark: SparkSession, report: dict, root: str | Path) -> DataFrame:
    """(path, line0, severity, message, rule) of a report; files outside the root are left out."""
    top, rows = Path(root).resolve(), []
    for d in report.get("generalDiagnostics") or []:
        file = Path(d.get("file", "")).resolve()
        if file.is_relative_to(top):
            rows.append((file.relative_to(top).as_posix(), int(((d.get("range") or {}).get("start") or {}).get("line", 0)), d.get("severity"), d.get("message", ""), d.get("rule")))
    return spark.createDataFrame(rows, "path string, line0 int, severity string, message string, rule string")


def with_diagnostics(raw: dict, by_path: DataFrame | None, engine: str = "pyright") -> dict:
    """A copy of a RAW document with diagnostics and one more known limit; the document itself without any."""
    if by_path is None:
        return raw
    limit = "Diagnostics come from an external type checker and are partial."
    meta = raw.get("index_meta") or {}
    limits = [*meta.get("known_limits", []), *([limit] if limit not in meta.get("known_limits", []) else [])]
    paths = {r["path"]: [{k: v for k, v in i.asDict().items() if v is not None} for i in r["items"]] for r in by_path.collect()}
    return raw | {"index_meta": meta | {"known_limits": limits}, "diagnostics": {"schema_version": 0, "partial": True, "engine": engine, "by_path": paths}}


def tree_text(edges: list[tuple[str, str, float | None]], entry: str, title: str) -> str:
    """K7: a flow as lines of text, each node's callees below it in the order given; a node met again is marked, not opened."""
    children: dict[str, list[tuple[str, float | None]]] = {}
    for a, b, sure in edges:
        children.setdefault(a, []).append((b, sure))
    lines, seen = [f"=== {title} ===", entry], {entry}
    todo = [(n, k, "", i == 0) for i, (n, k) in enumerate(reversed(children.get(entry, [])))]
    while todo:
        name, sure, indent, last = todo.pop()
        lines.append(f"{indent}{'└── ' if last else '├── '}{name}" + ("" if sure is None else f"  ({sure:.2f})"))
        below = indent + ("    " if last else "│   ")
        if name in seen:
            lines.append(f"{below}  ↻ (already visited)")
            continue
        seen.add(name)
        todo += [(n, k, below, i == 0) for i, (n, k) in enumerate(reversed(children.get(name, [])))]
    return "\n".join(lines)


def terrain_document(nodes: DataFrame, edges: DataFrame) -> str:
    """K6: the map as compact JSON: node rows, and edges (src, dst, is_primary)."""
    points = [r.asDict() for r in nodes.orderBy("id").collect()]
    return json.dumps({"nodes": points, "edges": [{"from": r["src"], "to": r["dst"], "is_primary": r["is_primary"]} for r in edges.orderBy("src", "dst").collect()]}, separators=(",", ":"))
