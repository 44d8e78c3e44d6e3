import json

import pytest

from loomgraph import cli
from loomgraph.operators import resolve, validate
from loomgraph.plans import ir
from loomgraph.sources import documents, python_facts, script_facts, tree

APP = '''"""An app."""

from web import Server
from shop.core import price_of, missing
from .util import tidy


def create_app():
    server = Server("x")

    @server.get("/p")
    def price(name):
        import shop.core as helper
        return price_of(tidy(name))

    return server


class Basket:
    def add(self, x):
        return self.add(print(x)) or missing(x) or len([])
'''
CORE = '''def price_of(name):
    def inner():
        return price_of(name)
    return inner()


async def later():
    return price_of("x")
'''


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    for path, text in {"src/shop/__init__.py": "", "src/shop/app.py": APP, "src/shop/core.py": CORE, "src/shop/util/__init__.py": "from .text import tidy\n", "src/shop/util/text.py": "def tidy(x):\n    return x.strip()\n", "src/shop/build/x.py": "def no(): pass\n", "src/shop/bad.py": "def broken(:\n"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    (root / "src/shop/latin.py").write_bytes(b"x = '\xff'\n")
    return root


def test_scan_keeps_init_files_and_skips_built_ones(spark, repo):
    paths = [r["path"] for r in tree.python_files(spark, str(repo)).orderBy("ord").collect()]
    assert paths == sorted(paths) and "src/shop/__init__.py" in paths and not any("build" in p for p in paths)
    assert tree.python_files(spark, str(repo), ["nothing"]).count() == 0
    assert tree.python_files(spark, str(repo), ["src", "src/shop"]).count() == 2 * len(paths)


def test_language_and_config(tmp_path):
    assert tree.language_of(tmp_path) == "python"
    (tmp_path / "a.ts").write_text("")
    hidden = any(p.startswith(".") for p in (tmp_path / "a.ts").resolve().parts)
    assert tree.language_of(tmp_path) == ("python" if hidden else "typescript")
    (tmp_path / "a.py").write_text("")
    assert tree.language_of(tmp_path) == "python"
    assert tree.load_config(tmp_path, "no.toml") == {}
    (tmp_path / "c.toml").write_text('[entrypoints]\nids = ["x"]\n')
    (tmp_path / "d.toml").write_text("[")
    assert tree.load_config(tmp_path, "c.toml")["entrypoints"]["ids"] == ["x"] and tree.load_config(tmp_path, "d.toml") == {}


def test_graph_of_a_repository(spark, repo):
    raw = ir.index_python(spark, repo)
    status = {r["path"]: r["analysis"] for r in raw.files.collect()}
    assert not status["src/shop/bad.py"]["parse_ok"] and status["src/shop/bad.py"]["error"].startswith("SyntaxError")
    assert status["src/shop/latin.py"]["error"].startswith("utf-8 decode") and status["src/shop/app.py"]["completeness"] == "complete"
    doc = ir.graph_document(raw, ir.build_graph(raw))
    fn = "py:fn:shop."
    sure = [(e["from"], e["to"], e["kind"]) for e in doc["edges"] if e["confidence"] == "resolved"]
    assert sure == [
        (fn + "app.create_app", fn + "app.create_app.price", "contains"), (fn + "core.price_of", fn + "core.price_of.inner", "contains"),
        (fn + "app.create_app.price", fn + "core.price_of", "calls"), (fn + "app.create_app.price", fn + "util.text.tidy", "calls"),
        (fn + "core.later", fn + "core.price_of", "calls"), (fn + "core.price_of", fn + "core.price_of.inner", "calls"), (fn + "core.price_of.inner", fn + "core.price_of", "calls"),
    ]
    open_ = [(e["from"], e["callsite"].get("callee") or e["callsite"].get("callee_expression"), e["callsite"]["line"]) for e in doc["edges"] if e["confidence"] == "unknown"]
    assert open_ == [(fn + "app.Basket.add", "missing", 21), (fn + "app.Basket.add", "self.add", 21), (fn + "app.create_app", "Server", 9), (fn + "app.create_app.price", "server.get", 11), (fn + "util.text.tidy", "x.strip", 2)]
    assert [e["id"] for e in doc["edges"]] == [f"e:{i}" for i in range(len(doc["edges"]))]
    assert next(e for e in doc["edges"] if e.get("callsite", {}).get("callee") == "missing")["callsite"]["import_ref"] == "shop.core.missing"
    assert doc["entrypoints"] == [fn + "app.create_app"] and doc["nodes"][-1]["id"] == ir.BOUNDARY


def test_generate_graph(spark, repo):
    out = ir.generate_graph(spark, repo, config={"entrypoints": {"ids": ["py:fn:shop.core.later", "ghost"]}})
    assert out["entrypoints"] == ["py:fn:shop.core.later"]
    assert out["use_cases"] == [{"id": "py:fn:shop.core.later", "displayName": "Later", "use_case": True, "reachable_node_count": 3}]
    assert out["overlay"]["by_flow_node_id"]["py:fn:shop.core.price_of"] == {"displayName": "Price Of"}


def test_two_functions_of_one_name(spark, tmp_path):
    (tmp_path / "a.py").write_text("def f():\n    pass\n\n\ndef f():\n    return 1\n")
    raw = ir.index_python(spark, tmp_path)
    with pytest.raises(ValueError, match="duplicate node id"):
        ir.build_graph(raw)
    assert [r["start_line"] for r in ir.build_graph(raw, strict=False).nodes.collect()] == [5]


def test_relative_imports_and_local_ones():
    assert python_facts.import_base("x", 1, "pkg.mod") == "pkg.x" and python_facts.import_base(None, 2, "a.b.c") == "a"
    assert python_facts.import_base("x", 1, "pkg") == "x" and python_facts.import_base("x", 3, "a.b") == ""
    facts = python_facts.read_file("m.py", b"from a import f\n\n\ndef g():\n    from b import f\n    from c import f\n    f()\n\n    def h():\n        f()\n\n\ndef k():\n    f()\n")
    assert [(c["caller"], c["target"]) for c in facts["calls"]] == [("m.g", "b.f"), ("m.g.h", "b.f"), ("m.k", "a.f")]


def test_plain_functions_resolve_by_suffix(spark):
    f = python_facts.read_file("m.py", b"class A:\n    def go(self):\n        self.go(); self.other(); x.unique(); x.get(); a.b.unique()\n\n\ndef top():\n    top()\n\n\nclass B:\n    def unique(self): pass\n    def get(self): pass\n")
    known = spark.createDataFrame([(x["qname"],) for x in f["functions"]], "qualified_name string")
    calls = spark.createDataFrame([(i, c["qname"], c["form"], c["callee"], c["class"]) for i, c in enumerate(f["plain"])], "call int, qname string, form string, name string, class string")
    got = {(r["qname"], r["name"]): r["resolved"] for r in resolve.unique_suffix(calls, known).collect()}
    assert got == {("A.go", "go"): "A.go", ("A.go", "other"): None, ("A.go", "unique"): "B.unique", ("A.go", "get"): None, ("top", "top"): "top"}


def test_command_line(spark, repo, tmp_path, capsys):
    a, b = tmp_path / "a.json", tmp_path / "o" / "b.json"
    assert cli.main(["index", str(repo), "-o", str(a)]) == 0
    old = json.loads(a.read_text())
    assert {s["qualified_name"] for s in old["symbols"]} >= {"shop.app.Basket", "shop.core.later"}
    new = json.loads(a.read_text())
    for s in new["symbols"]:
        s["id"] = s["id"].replace("core.py", "moved.py")
        s["file_id"] = s["file_id"].replace("core.py", "moved.py")
    for f in new["files"]:
        f["path"], f["id"] = f["path"].replace("core.py", "moved.py"), f["id"].replace("core.py", "moved.py")
    documents.write_json(new, b)
    assert cli.main(["diff", str(a), str(b)]) == 0
    assert json.loads(capsys.readouterr().out)["files"]["added"] == ["src/shop/moved.py"]
    over = tmp_path / "overlay.json"
    over.write_text(json.dumps({"by_symbol_id": {"sym:src/shop/core.py:shop.core.later": {"displayName": "L", "n": 1}, "ghost": {"k": None}}}))
    assert cli.main(["orphans", str(a), str(over), "-o", str(tmp_path / "r.json")]) == 1
    assert json.loads((tmp_path / "r.json").read_text())["by_symbol_id"] == ["ghost"]
    assert cli.main(["overlay-migrate", str(a), str(b), str(over)]) == 1
    assert cli.main(["overlay-migrate", str(a), str(b), str(over), "-o", str(tmp_path / "m.json")]) == 0
    moved = json.loads((tmp_path / "m.json").read_text())["by_symbol_id"]
    assert moved == {"sym:src/shop/moved.py:shop.core.later": {"displayName": "L", "n": 1}, "ghost": {"k": None}}
    assert cli.main(["overlay-migrate", str(a), str(b), str(over), "--dry-run"]) == 0
    assert cli.main(["execution-ir", str(repo), "-o", str(tmp_path / "ir.json")]) == 0
    assert documents.load_overlay(tmp_path / "none.json")["by_root_id"] == {}


def test_diagnostics(spark, tmp_path):
    from loomgraph.operators.analytics import diagnostics_by_path

    report = {"generalDiagnostics": [{"file": str(tmp_path / "a.py"), "message": "m", "range": {"start": {"line": 4}}}, {"file": "/else/b.py", "message": "n"}]}
    doc = documents.with_diagnostics({"index_meta": {"known_limits": []}}, diagnostics_by_path(documents.diagnostic_rows(spark, report, tmp_path)))
    assert doc["diagnostics"]["by_path"] == {"a.py": [{"line": 5, "message": "m", "severity": "information"}]} and len(doc["index_meta"]["known_limits"]) == 1
    assert documents.with_diagnostics({"x": 1}, None) == {"x": 1}


SCRIPT = b"""import def, { a as b, type C, d } from "lib/x";
import * as ns from 'ns';
export const f = async (x: number, y = g(1)): Promise<Map<string, number>> => {
  const inner = () => b(x);
  if (x > 1) { function hidden() { d(`t ${inner(2)} z`); } }
  return ns.run(x)?.then((q) => q.map<T>(def)).match(/a"b[/)]c/g);
};
let v = (1 + 2) / k(3) / 4, w = function named() { return new Foo(bar()); };
function* gen() { skipped(); }
export default class K<T> extends Base(mix) implements I {
  private field = helper();
  async method<U>(a: U = dflt()): Promise<void> { super.method(a); callee<number>(1); }
  sig(a: string): void;
  constructor() { const o = { meth() { return q() }, k: z() }; tag`x`; }
}
function outer(cb: () => void): { a: number } { function nested() { cb(); } return { a: nested() }; }
"""


def test_script_facts():
    r = script_facts.read_file("src/a/index.ts", SCRIPT)
    assert r["parse_ok"] and [(s["qualified_name"], s["line"], s["end_line"], s["exported"]) for s in r["symbols"]] == [
        ("a.f", 3, 7, True), ("a.f.inner", 4, 4, None), ("a.w", 8, 8, None), ("a.K.method", 12, 12, None), ("a.K.constructor", 14, 14, None), ("a.outer", 16, 16, None), ("a.outer.nested", 16, 16, None)]
    assert [(i["module"], i["from_module"], i["line"]) for i in r["imports"]] == [("lib/x", "a", 1), ("ns", "a", 2)]
    assert [(c["caller"], c["name"] or c["expression"], c["target"]) for c in r["calls"]] == [
        ("a.f", "g", None), ("a.f.inner", "b", "lib/x.a"), ("a.f", "d", "lib/x.d"), ("a.f", "inner", None), ("a.f", "ns.run", None), ("a.f", "ns.run(x)?.then", None), ("a.f", "q.map", None),
        ("a.f", "ns.run(x)?.then((q) => q.map<T>(def)).match", None), ("a.w", "bar", None), ("a.K.method", "super.method", None), ("a.K.method", "callee", None), ("a.K.constructor", "q", None), ("a.K.constructor", "z", None), ("a.K.constructor", "tag", None), ("a.outer.nested", "cb", None), ("a.outer", "nested", None)]
    for broken in (b"function f( {", b"a)", b"`x ${y", b"/* x"):
        assert not script_facts.read_file("a.ts", broken)["parse_ok"]
    assert script_facts.module_name("src/index.ts") == "index" and script_facts.module_name("lib/u/index.jsx") == "lib.u"


def test_script_graph(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "index.ts").write_text('import { shout, check } from "./words";\nimport { debounce } from "lib";\n\nexport function main(): void {\n  if (check("x")) {\n    console.log(shout("x"));\n  }\n  debounce(local);\n}\n\nfunction local() {\n  return missing();\n}\n')
    (tmp_path / "src" / "words.ts").write_text("export function shout(s: string): string {\n  return s.toUpperCase();\n}\n\nexport const check = (s: string): boolean => s.length > 0;\n")
    (tmp_path / "src" / "bad.ts").write_text("function broken( {")
    assert ir.tree.language_of(tmp_path) == "typescript"
    raw = ir.index(spark, tmp_path)
    doc = ir.raw_document(raw)
    assert {s["qualified_name"] for s in doc["symbols"]} == {"index.main", "index.local", "words.shout", "words.check"} and {f["path"]: f["analysis"]["parse_ok"] for f in doc["files"]} == {"src/bad.ts": False, "src/index.ts": True, "src/words.ts": True}
    assert [(e["id"], e["module"], e["line"]) for e in doc["edges"]] == [("imp:src/index.ts:0", "./words", 1), ("imp:src/index.ts:1", "lib", 2)]
    out = ir.graph_document(raw, ir.build_graph(raw))
    assert validate.document_errors(out) == [] and out["languages"] == ["typescript"] and out["entrypoints"] == ["ts:fn:index.main"]
    sure = {(e["from"], e["to"]) for e in out["edges"] if e["kind"] == "calls" and e["confidence"] == "resolved"}
    assert sure == {("ts:fn:index.main", "ts:fn:words.check"), ("ts:fn:index.main", "ts:fn:words.shout")}
    unknown = [(e["from"], e["to"], e["callsite"]) for e in out["edges"] if e["confidence"] == "unknown"]
    assert ("ts:fn:index.main", "ts:boundary:unresolved", {"line": 8, "callee": "debounce", "import_ref": "lib.debounce"}) in unknown
    assert ("ts:fn:index.local", "ts:boundary:unresolved", {"line": 12, "callee": "missing"}) in unknown and len(unknown) == 4
    assert len(ir.generate_graph(spark, tmp_path)["nodes"]) == 5
