"""The query API on one small workspace."""

import json

import pytest

from saltmarsh import tools
from saltmarsh.operators import semantic

A = "import b\n\ndef main():\n    x = helper(1)\n    return x\n"
B = "# adds one\ndef helper(n):\n    return n + 1\n"


@pytest.fixture(scope="module")
def ws(spark):
    df = spark.createDataFrame
    files = df([("a.py", A, "python", False), ("b.py", B, "python", False)], "path string, content string, language string, is_external boolean")
    syms = df([("s1", "a.py", "main", "function", 3, 5, 5, 12, 0, None, 1, "function"), ("s2", "b.py", "helper", "function", 2, 5, 3, 16, 0, None, 2, "function"), ("s3", "a.py", "x", "variable", 4, 5, 4, 6, 1, "main", 3, "local-variable")], "id string, path string, name string, kind string, sl int, sc int, el int, ec int, depth int, container_name string, ord int, rule_id string")
    refs = df([("s2", "b.py", 2, 5, 2, 11), ("s2", "a.py", 4, 9, 4, 15), ("s2", "a.py", 1, 8, 1, 9), ("s2", "gone.py", 1, 1, 1, 2)], "query_id string, path string, sl int, sc int, el int, ec int")
    defs = df([("s2", "b.py", 2, 5, 2, 11), ("s2", "node_modules/x/i.js", 1, 1, 50, 1), ("s1", "a.py", 3, 5, 3, 9)], "query_id string, path string, sl int, sc int, el int, ec int")
    m = semantic.syntax_matches(files)
    calls = df([("s1", "outgoing", "b.py", 2, "helper", "function", None, 4, 9, 1), ("s1", "outgoing", "b.py", 2, "helper", "function", None, 4, 9, 2), ("s1", "outgoing", "lib/z.py", 1, "z", "function", None, 4, 20, 3), ("s1", "outgoing", "b.py", 3, "n", "property", None, 4, 1, 4)], "query_id string, direction string, path string, line int, name string, kind string, detail string, sl int, sc int, ord int")
    hovers = df([("a.py", 4, 9, "```python\ndef helper(n)\n```\nadds one")], "path string, line int, character int, markdown string")
    diags = df([("a.py", "error", "m"), ("a.py", "warning", "m"), ("b.py", None, "m")], "path string, severity string, message string")
    nodes = df([("f1", "file", "a.py"), ("s1", "symbol", "main"), ("s2", "symbol", "helper")], "id string, node_type string, name string")
    edges = df([("e1", "defines", "f1", "s1"), ("e2", "calls", "s1", "s2")], "id string, kind string, from_id string, to_id string")
    vec = df([("v1", "a.py", "h1", [1.0, 0.0], A, "main", "function"), ("v2", "b.py", "h2", [0.8, 0.6], B, "helper", "function")], "id string, path string, segment_hash string, embedding array<float>, code string, symbol string, kind string")
    return tools.Workspace(files, syms, m.where("rule_id = 'all-identifiers'"), refs, defs, m.where("match_type = 'reference'"), calls, hovers, diags, nodes, edges, vec)


def test_files_and_source(ws):
    assert [r[0] for r in ws.list_files(1, 1).collect()] == ["b.py"]
    assert ws.read_source_code("b.py", 2, 1, 2, 4).first()["source"] == "def"
    assert ws.read_source_code("b.py").first()["source"] == B
    assert ws.health().first()["languages"] == ["python"]


def test_symbols(ws):
    assert [r["name"] for r in ws.document_symbol("a.py").collect()] == ["main"]
    assert {r["name"] for r in ws.document_symbol("a.py", True, True).collect()} == {"main", "x"}
    got = ws.find_symbol("help").first()
    assert (got["match_kind"], got["snippet"]) == ("prefix", "# adds one\ndef helper(n):\n    return n + 1")
    assert ws.get_symbol_definition("helper", "b.py").first()["source"] == "def helper(n):\n    return n + 1"
    assert ws.find_identifier("a.py", "helper").count() == 1
    assert ws.find_identifier("a.py", "x", 4, 5).first()["tier"] == 0
    assert ws.related_symbols("a.py", 3, 6).count() == 0


def test_navigation(ws):
    got = ws.go_to_definition("b.py", 2, 6).orderBy("external").collect()
    assert [(r["path"], r["external"], r["name"]) for r in got] == [("b.py", False, "helper"), ("node_modules/x/i.js", True, None)]
    assert [(r["name"], r["status"]) for r in ws.find_referenced_symbols("a.py", 3, 6).collect()] == [("helper", "internal")]  # main is defined there, not called
    calls = ws.call_hierarchy("a.py", 3, 6, "outgoing").collect()
    assert [(r["name"], r["path"]) for r in calls] == [("helper", "b.py")]
    assert {r["name"] for r in ws.call_hierarchy("a.py", 3, 6, "outgoing", True).collect()} == {"helper", "z"}


def test_references(ws):
    got = ws.find_references("helper", detail=True)
    assert got["candidates"].first()["id"] == "s2"
    assert got["counts"].first()[:] == (3, 1, 1, 1, 0)
    assert [tuple(r) for r in got["files"].collect()] == [("a.py", 2), ("b.py", 1)]
    assert [(r["path"], r["class"]) for r in got["references"].collect()] == [("a.py", "import"), ("a.py", "call"), ("b.py", "definition")]
    assert {r["query_id"]: r["uses"] for r in ws.usage_counts().collect()} == {"s2": 3}


def test_hover_and_diagnostics(ws):
    req = json.dumps([{"path": "q", "line": 1, "character": 1}, {"path": "a.py", "line": 4, "character": 9}])
    assert [(r["idx"], r["signature"], r["text"]) for r in ws.hover(req).collect()] == [(0, None, None), (1, "def helper(n)", "adds one")]
    assert {r["path"]: (r["error"], r["warning"], r["total"]) for r in ws.get_diagnostics().collect()} == {"a.py": (1, 1, 2), "b.py": (0, 0, 1), None: (1, 1, 3)}


def test_search_and_map(ws):
    got = ws.semantic_search([1.0, 0.0], "adds helper").collect()
    assert [(r["id"], r["rank"]) for r in got] == [("v1", 1), ("v2", 2)]
    over = ws.codemap("overview")
    assert over["stats"].first()[:] == (2, 2, 2) and over["symbols"].first()["id"] == "s2"
    imp = ws.codemap("impact", "help")
    assert {r["id"] for r in imp["nodes"].collect()} == {"s2", "s1", "f1"}
    assert {(r["from_name"], r["to_name"]) for r in imp["edges"].collect()} == {("a.py", "main"), ("main", "helper")}


def test_enabled_tools():
    assert len(tools.enabled_tools("minimal")) == 4 and len(tools.enabled_tools()) == 11 and len(tools.enabled_tools("full")) == 15
    assert "codemap" in tools.enabled_tools("minimal", ["codemap"]) and "hover" not in tools.enabled_tools("minimal", [], ["hover"])


def test_implementations_and_definitions_in_context(spark, ws):
    import dataclasses

    impl = spark.createDataFrame([("s2", "b.py", 9, 1, 9, 4), ("s2", "a.py", 2, 1, 2, 4), ("s1", "a.py", 1, 1, 1, 2)], "query_id string, path string, sl int, sc int, el int, ec int")
    w = dataclasses.replace(ws, implementations=impl)
    assert [(r["path"], r["sl"], r["selected"]) for r in w.go_to_implementation("b.py", 2, 6).collect()] == [("a.py", 2, "helper"), ("b.py", 9, "helper")]
    got = w.definition_with_context("b.py", 2, 6)
    assert [(r["path"], r["source"], r["uses"]) for r in got["definitions"].orderBy("external").collect()] == [("b.py", "def helper(n):\n    return n + 1", 3), ("node_modules/x/i.js", None, 3)]
    assert got["selected"].first()[:] == ("helper", "identifier") and got["siblings"].count() == 0
    assert w.selected_identifier("gone.py", 1, 1).first()[:] == ("unknown", "none")
    hovers = spark.createDataFrame([("gone.py", 1, 1, "```\nfn zed()\n```")], "path string, line int, character int, markdown string")
    assert dataclasses.replace(w, hovers=hovers).selected_identifier("gone.py", 1, 1).first()[:] == ("fn", "hover")
