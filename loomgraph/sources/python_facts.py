"""Facts of Python files in one parse (S6-S8, S15-S17, R2, R3, R6, R7): symbols, imports, and calls with what their name is bound to."""

from __future__ import annotations

import ast
import builtins
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUILTINS = frozenset(dir(builtins))
SCHEMA = (
    "ord int, path string, sha256 string, parse_ok boolean, error string,"
    "symbols array<struct<kind: string, name: string, qualified_name: string, line: int, end_line: int>>,"
    "imports array<struct<kind: string, module: string, line: int, names: array<string>, level: int>>,"
    "calls array<struct<caller: string, scope: string, form: string, name: string, target: string, is_builtin: boolean, expression: string, line: int, snippet: string>>,"
    "plain array<struct<qname: string, callee: string, form: string, class: string>>,"
    "functions array<struct<qname: string, source: string, docstring: string>>"
)
_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)


def module_name(path: str) -> str:
    parts = path.split("/")
    parts = parts[1:] if parts[0] == "src" else parts
    if not parts or not parts[-1].endswith(".py"):
        return ""
    parts[-1] = parts[-1][:-3]
    return ".".join(parts[:-1] if parts[-1] == "__init__" else parts)


def import_base(module: str | None, level: int, current: str) -> str:
    """R1, kept with its quirk: a package's own name counts as a module's."""
    if not level:
        return module or ""
    parts = current.split(".") if current else []
    if level > len(parts):
        return ""
    return ".".join([*parts[: len(parts) - level], *([module] if module else [])])


def bindings(node: ast.stmt, current: str) -> list[tuple[str, str]]:
    """(local name, target) of an import statement."""
    if isinstance(node, ast.Import):
        return [(a.asname or a.name.split(".")[0], a.name) for a in node.names]
    base = import_base(node.module, node.level, current)
    return [(a.asname or a.name, f"{base}.{a.name}" if base else a.name) for a in node.names if a.name != "*"]


def local_bindings(function: ast.AST, current: str) -> dict[str, str]:
    """What a function's own imports bind, nested definitions left out; of one name the first in the text counts."""
    found, todo = [], list(ast.iter_child_nodes(function))
    while todo:
        node = todo.pop()
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            found.append(node)
        elif not isinstance(node, (*_DEFS, ast.ClassDef, ast.Lambda)):
            todo.extend(ast.iter_child_nodes(node))
    out: dict[str, str] = {}
    for node in sorted(found, key=lambda n: (n.lineno, n.col_offset), reverse=True):
        out.update(bindings(node, current))
    return out


class _Reader(ast.NodeVisitor):
    def __init__(self, path: str, text: str, tree: ast.Module) -> None:
        self.module, self.text = module_name(path), text
        self.scope: list[str] = [self.module] if self.module else []
        self.function: str | None = None
        self.names = {k: v for n in tree.body if isinstance(n, (ast.Import, ast.ImportFrom)) for k, v in bindings(n, self.module)}
        self.symbols, self.imports, self.calls = [], [], []
        self.visit(tree)

    def _define(self, node, kind: str) -> None:
        self.scope.append(node.name)
        name = ".".join(self.scope)
        self.symbols.append({"kind": kind, "name": node.name, "qualified_name": name, "line": node.lineno, "end_line": node.end_lineno})
        before = self.function, self.names
        if kind != "class":
            self.function, self.names = name, self.names | local_bindings(node, self.module)
        self.generic_visit(node)
        self.function, self.names = before
        self.scope.pop()

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self._define(node, "class")

    def visit_FunctionDef(self, node: ast.FunctionDef) -> None:
        self._define(node, "function")

    def visit_AsyncFunctionDef(self, node: ast.AsyncFunctionDef) -> None:
        self._define(node, "async_function")

    def visit_Import(self, node: ast.Import) -> None:
        self.imports += [{"kind": "import", "module": a.name.split(".")[0], "line": node.lineno, "names": None, "level": None} for a in node.names]

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        self.imports.append({"kind": "import_from", "module": node.module or "", "line": node.lineno, "names": [a.name for a in node.names], "level": node.level})

    def visit_Call(self, node: ast.Call) -> None:
        form = {ast.Name: "name", ast.Attribute: "attribute"}.get(type(node.func))
        if self.function and form:
            name = node.func.id if form == "name" else None
            line = (ast.get_source_segment(self.text, node) or "").strip().replace("\n", " ")
            self.calls.append({
                "caller": self.function, "scope": ".".join(self.scope), "form": form, "name": name, "target": self.names.get(name), "is_builtin": name in BUILTINS,
                "expression": ast.unparse(node.func) if form == "attribute" else None, "line": node.lineno, "snippet": line if len(line) <= 200 else line[:197] + "...",
            })
        self.generic_visit(node)


def plain_functions(tree: ast.Module, text: str) -> tuple[list[dict], list[dict]]:
    """Functions at the top and methods of classes at the top as ``f`` or ``C.m``, and the calls in them."""
    functions, calls = [], []
    lines = text.split("\n")
    for top in tree.body:
        owner = top.name if isinstance(top, ast.ClassDef) else None
        for node in top.body if owner else [top]:
            if isinstance(node, _DEFS):
                qname = f"{owner}.{node.name}" if owner else node.name
                functions.append({"qname": qname, "source": "\n".join(lines[node.lineno - 1 : node.end_lineno]), "docstring": ast.get_docstring(node)})
                for call in ast.walk(node):
                    f = call.func if isinstance(call, ast.Call) else None
                    if isinstance(f, ast.Name):
                        calls.append({"qname": qname, "callee": f.id, "form": "bare", "class": owner})
                    elif isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name):
                        calls.append({"qname": qname, "callee": f.attr, "form": "self" if f.value.id == "self" and owner else "attr", "class": owner})
    return functions, calls


def read_file(path: str, content: bytes) -> dict:
    """All facts of one file; a file that can't be decoded or parsed has its error and nothing else."""
    none = {"symbols": [], "imports": [], "calls": [], "plain": [], "functions": []}
    try:
        text = content.decode("utf-8")
    except UnicodeDecodeError as e:
        return none | {"parse_ok": False, "error": f"utf-8 decode: {e}"}
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError) as e:
        return none | {"parse_ok": False, "error": f"{type(e).__name__}: {e}"}
    r = _Reader(path, text, tree)
    functions, plain = plain_functions(tree, text)
    return {"parse_ok": True, "error": None, "symbols": r.symbols, "imports": r.imports, "calls": r.calls, "plain": plain, "functions": functions}


def facts(files: DataFrame) -> DataFrame:
    """One row of ``SCHEMA`` for each row (ord, path, sha256, content)."""
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [read_file(p, bytes(c)) for p, c in zip(pdf["path"], pdf["content"], strict=True)]
            yield pd.DataFrame({"ord": pdf["ord"], "path": pdf["path"], "sha256": pdf["sha256"], **{k: [r[k] for r in rows] for k in ("parse_ok", "error", "symbols", "imports", "calls", "plain", "functions")}})

    return files.select("ord", "path", "sha256", "content").mapInPandas(run, SCHEMA)


def symbol_rows(found: DataFrame) -> DataFrame:
    """(id, kind, name, qualified_name, file_id, path, line, end_line, ord)."""
    rows = found.select("ord", "path", F.posexplode("symbols").alias("at", "s"))
    return rows.select(F.concat(F.lit("sym:"), "path", F.lit(":"), "s.qualified_name").alias("id"), "s.kind", "s.name", "s.qualified_name", F.concat(F.lit("file:"), "path").alias("file_id"), "path", "s.line", "s.end_line", *(["s.exported"] if "exported" in found.schema["symbols"].dataType.elementType.names else []), (F.col("ord").cast("bigint") * 1_000_000 + F.col("at")).alias("ord"))


def import_rows(found: DataFrame) -> DataFrame:
    """(from_file, kind, module, line, names, level)."""
    return found.select(F.concat(F.lit("file:"), "path").alias("from_file"), F.explode("imports").alias("i")).select("from_file", "i.*")


def file_rows(found: DataFrame) -> DataFrame:
    """(id, path, sha256, analysis)."""
    done = F.struct(F.when(F.col("parse_ok"), "complete").otherwise("failed").alias("completeness"), "parse_ok", "error")
    return found.select(F.concat(F.lit("file:"), "path").alias("id"), "path", "sha256", done.alias("analysis"))


def call_rows(found: DataFrame) -> DataFrame:
    """(call, caller, scope, form, name, target, is_builtin, expression, line, snippet, visit)."""
    rows = found.where("parse_ok").select("ord", F.posexplode("calls").alias("at", "c")).withColumn("visit", F.col("ord").cast("bigint") * 1_000_000 + F.col("at"))
    return rows.select(F.col("visit").alias("call"), "c.*", "visit")
