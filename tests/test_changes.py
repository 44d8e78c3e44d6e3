import pytest

from loomgraph.operators import diff, entrypoints, overlay, validate


def syms(spark, rows):
    return spark.createDataFrame([(f"sym:{p}:{q}", "function", q.split(".")[-1], q, f"file:{p}", 1, 2) for p, q in rows], "id string, kind string, name string, qualified_name string, file_id string, line int, end_line int")


def files(spark, paths):
    return spark.createDataFrame([(f"file:{p}", p, s) for p, s in paths], "id string, path string, sha256 string")


def test_identical_snapshots_have_no_difference(spark):
    s, f = syms(spark, [("a.py", "a.f")]), files(spark, [("a.py", "1")])
    assert diff.diff_files(f, f).count() == 0 and diff.diff_symbols(s, s).count() == 0 and diff.remap(s, s, f, f).count() == 0


def test_rename_tiers(spark):
    old = syms(spark, [("a.py", "m.f"), ("b.py", "m.g"), ("b.py", "n.g"), ("lib/c.py", "old.h"), ("x.py", "k.z"), ("y.py", "k.z")])
    new = syms(spark, [("c.py", "m.f"), ("d.py", "q.g"), ("d.py", "r.g"), ("lib/d.py", "new.h"), ("z.py", "k.z")])
    of, nf = files(spark, [("a.py", "1"), ("b.py", "1"), ("lib/c.py", "1"), ("x.py", "1"), ("y.py", "1"), ("p/u.py", "1")]), files(spark, [("c.py", "1"), ("d.py", "1"), ("lib/d.py", "1"), ("z.py", "1"), ("q/u.py", "1")])
    got = {(r["tier"], r["key"]) for r in diff.remap(old, new, of, nf).collect()}
    assert got == {("high", "m.f"), ("ambiguous_qualified_name", "k.z"), ("ambiguous_kind_name_dir", ".|g|function"), ("ambiguous_kind_name_dir", ".|z|function"), ("medium", "lib|h|function"), ("medium", "u.py"), ("medium", "c.py")}


def rows(spark, items):
    return spark.createDataFrame(items, "scope string, id string, key string, value string")


def test_migration_moves_merges_and_skips(spark):
    remap = spark.createDataFrame([("symbol", "high", ["s:a"], ["s:b"]), ("symbol", "high", ["s:x"], ["s:y"]), ("symbol", "medium", ["s:m"], ["s:n"]), ("file", "medium", ["f:a"], ["f:b"])], "entity string, tier string, from_ids array<string>, to_ids array<string>")
    before = rows(spark, [("by_symbol_id", "s:a", "displayName", "moved"), ("by_symbol_id", "s:a", "note", ""), ("by_symbol_id", "s:b", "displayName", "there"), ("by_symbol_id", "s:b", "note", "kept"), ("by_symbol_id", "s:m", "k", "v"), ("by_file_id", "f:a", "k", "v")])
    after, report = overlay.migrate(before, remap)
    got = {(r["id"], r["key"]): r["value"] for r in after.collect()}
    assert got == {("s:b", "displayName"): "moved", ("s:b", "note"): "kept", ("s:m", "k"): "v", ("f:b", "k"): "v"}
    assert {(r["kind"], r["action"], r["from_id"]) for r in report.collect()} == {("symbol", "merged", "s:a"), ("symbol", "skipped", "s:x"), ("file", "moved", "f:a")}
    assert ("s:n", "k") in {(r["id"], r["key"]) for r in overlay.migrate(before, remap, True)[0].collect()}


def test_delta_wins_even_when_empty(spark):
    got = overlay.merge_delta(rows(spark, [("s", "a", "k", "old"), ("s", "a", "l", "x")]), rows(spark, [("s", "a", "k", None), ("s", "b", "k", "new")]))
    assert {(r["id"], r["key"]): r["value"] for r in got.collect()} == {("a", "k"): None, ("a", "l"): "x", ("b", "k"): "new"}


def test_orphans_of_all_scopes(spark):
    entries = rows(spark, [("by_symbol_id", "sym:a.py:f", "k", "v"), ("by_symbol_id", "ghost", "k", "v"), ("by_directory_id", "dir:p", "k", "v"), ("by_directory_id", "dir:p/q", "k", "v"), ("by_directory_id", "dir:z", "k", "v"), ("by_root_id", "raw-root", "k", "v"), ("by_root_id", "other", "k", "v"), ("by_flow_node_id", "py:fn:f", "k", "v")])
    symbols, fs = syms(spark, [("a.py", "f")]), files(spark, [("p/q/x.py", "1"), ("top.py", "1")])
    got = {tuple(r) for r in overlay.orphans(entries, symbols, fs, spark.createDataFrame([("py:fn:g",)], "node string")).collect()}
    assert got == {("by_symbol_id", "ghost"), ("by_directory_id", "dir:z"), ("by_root_id", "other"), ("by_flow_node_id", "py:fn:f")}


def graph(spark, labels, calls=(), holds=()):
    n = spark.createDataFrame([(x, x, "pkg/__init__.py" if x.startswith("api_") else "pkg/m.py", "function", i) for i, x in enumerate(labels)], "node string, label string, path string, kind string, ord int")
    e = [(a, "b", "calls", "unknown", c, None) for a, c in calls] + [(a, b, "contains", "resolved", None, None) for a, b in holds]
    return n, spark.createDataFrame(e, "src string, dst string, kind string, confidence string, callee_expression string, callee string")


def found(df):
    return [(r["node"], r["tier"]) for r in df.orderBy("ord").collect()]


def test_entrypoint_tiers_are_a_union(spark):
    n, e = graph(spark, ["x.create_app", "create_app", "r", "held", "api_f", "m.main", "other"], [("r", "router.get"), ("held", "app.get"), ("other", "name.strip")], [("r", "held")])
    assert found(entrypoints.detect(n, e)) == [("m.main", 2), ("x.create_app", 3), ("r", 4), ("api_f", 5)]


def test_entrypoint_fallback_config_and_nothing(spark):
    n, e = graph(spark, ["a", "b"])
    assert found(entrypoints.detect(n, e)) == [("a", 6)]
    conf = spark.createDataFrame([("b", 0), ("zz", 1), ("b", 2)], "node string, ord int")
    assert found(entrypoints.detect(n, e, conf)) == [("b", 1), ("b", 1)]
    assert found(entrypoints.detect(n, e, conf.where("node = 'zz'"))) == [("a", 6)]
    assert found(entrypoints.detect(n.limit(0), e)) == []


def test_violations(spark):
    n = spark.createDataFrame([("a", "function", "python", "a"), ("a", "function", "python", "a"), ("b", "", "python", "b")], "node string, kind string, language string, label string")
    e = spark.createDataFrame([("e:0", "a", "zz", "calls", "maybe")], "id string, src string, dst string, kind string, confidence string")
    p = spark.createDataFrame([("q",)], "node string")
    got = {(r["rule"], r["item"]) for r in validate.violations(n, e, p).collect()}
    assert got == {("duplicate_id", "a"), ("empty_kind", "b"), ("bad_confidence", "e:0"), ("unknown_dst", "e:0"), ("unknown_entrypoint", "q")}
    with pytest.raises(ValueError, match="duplicate node id"):
        validate.require_valid(n, e, p)


@pytest.mark.parametrize("doc", [[], {"schema_version": 1, "unified_diff": "x"}, {"unified_diff": 3}, {"unified_diff": " "}, {"overlay": []}, {"overlay": {"by_file_id": 3}}])
def test_bad_bundles(doc):
    with pytest.raises(ValueError):
        validate.parse_bundle(doc)


def test_good_bundles():
    assert validate.parse_bundle({"unified_diff": "d", "more": 1}) == {"schema_version": 0, "unified_diff": "d"}
    assert validate.parse_bundle({"overlay": {"by_file_id": {"a": {}}}})["overlay"]["by_symbol_id"] == {}


def test_answers_and_prompts(spark):
    assert overlay.parse_label('```json\n{"displayName": "A", "userDescription": 3}\n```') == {"displayName": "A", "userDescription": "3"}
    assert overlay.parse_label("no") is None and overlay.parse_label('{"displayName": "A"}') is None
    n = spark.createDataFrame([("a", "do_it"), ("b", "other")], "node string, label string")
    e = spark.createDataFrame([("a", "b", "calls", "resolved")], "src string, dst string, kind string, confidence string")
    p = overlay.prompts(n, e, n.where("node = 'a'"))
    assert "do_it, other" in p.collect()[0]["prompt"]
    got = overlay.label_entries(p, lambda text: '{"displayName": "Do", "userDescription": "It"}').collect()
    assert [tuple(r) for r in got] == [("a", "Do", "It")]


def test_documents_of_a_wrong_shape():
    good = {"schema_version": 0, "languages": ["python"], "entrypoints": ["a"], "nodes": [{"id": "a", "kind": "function", "language": "python", "label": "a", "location": {"path": "a.py"}}, {"id": "b", "kind": "function", "language": "python", "label": "b"}], "edges": [{"from": "a", "to": "b", "kind": "calls", "confidence": "resolved", "callsite": {"line": 3, "callee": None}}]}
    assert validate.document_errors(good) == []
    assert validate.document_errors([]) == ["document: not an object"]
    assert validate.document_errors({}) == [f"{k}: not there" for k in ("schema_version", "languages", "nodes", "edges", "entrypoints")]
    bad = {"schema_version": 1, "languages": "x", "entrypoints": ["z", 4], "nodes": [5, {"id": " ", "kind": "", "language": "l", "label": 3, "location": []}, {"id": "a", "kind": "k", "language": "l", "label": "x", "location": {"path": 7}}, {"id": "a", "kind": "k", "language": "l", "label": "x"}],
           "edges": [6, {"from": "a", "to": "q", "kind": "owns", "confidence": "maybe", "callsite": []}, {"from": "a", "to": "a", "kind": "calls", "confidence": "resolved", "callsite": {"line": "3", "callee": 1, "snippet": 2, "import_ref": 3, "callee_expression": 4}}, {"from": "a", "kind": "calls", "confidence": "resolved"}]}
    errors = validate.document_errors(bad)
    assert errors[:2] == ["schema_version: 1 is none of 0", "languages: 'x' is no list"] and len(errors) == 22
    assert {"nodes[0]: 5 is no object", "nodes[1].id: ' ' is no filled string", "nodes[3].id: 'a' is the id of nodes[2].id too", "nodes[1].location: [] is no object", "nodes[2].location.path: 7 is no string", "edges[1].to: unknown node 'q'", "edges[1].confidence: 'maybe' is none of 'resolved', 'heuristic', 'unknown'",
            "edges[2].callsite.line: '3' is no integer", "edges[3].to: not there", "entrypoints[0]: unknown node 'z'", "entrypoints[1]: 4 is no string"} <= set(errors)


def test_a_null_overlay_is_none():
    with pytest.raises(ValueError, match="bundle.overlay must be an object"):
        validate.parse_bundle({"unified_diff": "d", "overlay": None})
