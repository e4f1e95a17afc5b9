"""Operators on hand-made relations: ties, gaps, empty inputs, properties."""

import json
import random

import pytest
from pyspark.sql import functions as F

from saltmarsh.functions import paths
from saltmarsh.operators import graph, index, markdown, paging, positions, references, search, semantic, symbols, texts, usage
from saltmarsh.sources import files as sources
from saltmarsh.sources import versions
from saltmarsh.streaming import events


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


# texts


@pytest.mark.parametrize("rng,out", [((1, 1, 1, 4), "abc"), ((1, 2, 2, 3), "bc\ndé"), ((2, 1, 99, 99), "déf\n"), ((3, 1, 1, 1), ""), ((1, 1, 2, 2), "abc\nd")])
def test_read_range(spark, rng, out):
    df = spark.createDataFrame([("abc\ndéf\n",)], "c string")
    assert df.select(texts.read_range(F.col("c"), *rng)).first()[0] == out


def test_line_range(spark):
    df = spark.createDataFrame([("a\nb\nc",)], "c string")
    assert df.select(texts.line_range(F.col("c"), 1, 2), texts.line_range(F.col("c"), 7, 9)).first()[:] == ("b\nc", "")
    assert df.select(texts.read_source(F.col("c"), 1, 1, 1, 2), texts.read_source(F.col("c"), 1)).first()[:] == ("a", "a\nb\nc")


def test_chunks(spark):
    f = spark.createDataFrame([("a", "1\n2\n3\n4\n5"), ("e", ""), ("t", "x\n"), ("m", "é\né")], "path string, content string")
    got = rows(texts.tumbling_chunks(f, 2, 1).select("path", "start_line", "end_line", "code"))
    assert got == [("a", 1, 2, "1\n2"), ("a", 3, 4, "3\n4"), ("a", 5, 5, "5"), ("m", 1, 2, "é\né"), ("t", 1, 1, "x")]
    assert rows(texts.overlapping_chunks(f, 2, 0, 1).select("path", "start_line", "end_line", "code")) == got
    assert rows(texts.tumbling_chunks(f, 2, 5).select("path")) == [("m",)]


def test_overlap():
    assert texts.overlap_starts([1] * 5, 3, 2) == [(0, 3), (2, 5)]
    assert texts.overlap_starts([1] * 5, 2, 100) == [(0, 2), (2, 4), (4, 5)]
    assert texts.overlap_starts([], 2, 1) == []
    for _ in range(50):
        sizes = [random.randrange(9) for _ in range(random.randrange(1, 40))]
        spans = texts.overlap_starts(sizes, random.randrange(1, 6), random.randrange(12))
        assert spans[0][0] == 0 and spans[-1][1] == len(sizes) and all(b[0] <= a[1] and b[0] > a[0] for a, b in zip(spans, spans[1:]))


PY = "import os\n\n# adds\n# numbers\ndef add(a, b):\n    return a + b + helper(a)\n\n\nclass Box:\n    def get(self):\n        return 1\n\nLIMIT = 3\n"


def test_syntax_and_semantic_chunks(spark):
    f = spark.createDataFrame([("a.py", "python", PY), ("b.c", "c", "int x;")], "path string, language string, content string")
    m = semantic.syntax_matches(f)
    assert rows(m.where("match_type = 'symbol'").select("rule_id", "name", "sl")) == [("class", "Box", 9), ("constant", "LIMIT", 13), ("function", "add", 5), ("function", "get", 10)]
    assert rows(m.where("rule_id = 'function-call'").select("name").distinct()) == [("helper",)]  # the name in a definition is no call
    assert rows(references.allowed_rules(m).select("rule_id").distinct()) == [("function-call",)]
    c = {r["symbol_name"]: r for r in semantic.semantic_chunks(f).collect()}
    assert set(c) == {"add", "Box", "LIMIT"}
    assert (c["add"]["start_line"], c["add"]["end_line"], c["add"]["doc_comment"]) == (5, 6, "# adds\n# numbers")
    assert c["add"]["code"].startswith("import os") and c["Box"]["symbol_kind"] == "type"


def test_doc_comments():
    assert semantic.doc_comment(["/* a", " b */", "", "f"], 3) == "/* a\n b */"
    assert semantic.doc_comment(["x", "f"], 1) is None
    assert semantic.doc_comment(["f"], 0) is None
    assert semantic.doc_comment(["/// a", "// b", "f"], 2) == "/// a\n// b"


def test_embed_and_enrich(spark):
    c = spark.createDataFrame([("h1", "a b"), ("h2", "a b"), ("h3", "")], "segment_hash string, text string")
    v = {r[0]: r[1] for r in semantic.embed(c).collect()}
    assert v["h1"] == v["h2"] and len(v["h3"]) == 64 and abs(sum(x * x for x in v["h1"]) - 1) < 1e-5
    c = spark.createDataFrame([("h1", "function", "x"), ("h2", "function", "y"), ("h3", "lines", "z"), ("h4", "type", "bad")], "segment_hash string, symbol_kind string, code string")
    cache = spark.createDataFrame([("h1", "known", ["t"])], "segment_hash string, summary string, tags array<string>")
    got = rows(semantic.enrich(c, cache, lambda code: json.dumps({"summary": f"s {code}", "tags": ["a"]}) if code != "bad" else "{").select("segment_hash", "summary", "tags"))
    assert got == [("h1", "known", ["t"]), ("h2", "s y", ["a"]), ("h3", None, None), ("h4", None, None)]


# paging


@pytest.mark.parametrize("limit,offset", [(3, 0), (3, 6), (5, 9), (20, 0), (3, 99)])
def test_pages(spark, limit, offset):
    df = spark.range(10)
    items = list(range(10))
    assert [r[0] for r in paging.page(df, ["id"], limit, offset).collect()] == items[offset : offset + limit]
    assert paging.page_info(df, limit, offset).first()["truncated"] == (min(offset + limit, 10) < 10)


def test_pages_put_together_are_the_whole(spark):
    df = spark.range(23)
    assert [r[0] for o in range(0, 25, 5) for r in paging.page(df, [F.desc("id")], 5, o).collect()] == list(range(22, -1, -1))


# positions


def test_containers(spark):
    s = spark.createDataFrame([("a", "outer", 0, 1, 1, 10, 1), ("a", "inner", 1, 2, 1, 4, 1), ("a", "twin", 2, 2, 1, 4, 1), ("b", "far", 3, 50, 1, 60, 1), ("b", "near", 4, 20, 1, 21, 1)], "path string, name string, ord int, sl int, sc int, el int, ec int")
    k = spark.createDataFrame([(0, "a", 3, 1), (1, "a", 8, 1), (2, "b", 23, 1), (3, "none", 1, 1), (4, "a", 3, 1)], "idx int, path string, line int, character int")
    got = [(r["idx"], r["found"], r["name"]) for r in positions.containers(k, s).orderBy("idx").collect()]
    assert got == [(0, "container", "inner"), (1, "container", "outer"), (2, "nearest", "near"), (3, "none", None), (4, "container", "inner")]


def test_identifiers(spark):
    i = spark.createDataFrame([("a", "x", 1, 1, 1, 2), ("a", "y", 2, 5, 2, 8), ("a", "z", 2, 20, 2, 22), ("a", "w", 9, 1, 9, 2)], "path string, name string, sl int, sc int, el int, ec int")
    k = spark.createDataFrame([(0, "a", 2, 6), (1, "a", 2, 17), (2, "a", 5, 1), (3, "q", 1, 1)], "idx int, path string, line int, character int")
    got = [(r["idx"], r["tier"], r["name"], r["closest"]) for r in positions.identifiers_at(k, i).orderBy("idx").collect()]
    assert got == [(0, 0, "y", None), (1, 1, "z", None), (2, 2, None, ["y", "z", "x"]), (3, None, None, None)]


def test_definitions_to_symbols(spark):
    s = spark.createDataFrame([("a", "x", 5, 3), ("a", "y", 7, 1)], "path string, name string, sl int, sc int")
    k = spark.createDataFrame([(0, "a", 5, 3), (1, "a", 8, 2), (2, "a", 90, 1)], "id int, path string, line int, character int")
    assert rows(positions.definitions_to_symbols(k, s).select("id", "name", "exact")) == [(0, "x", True), (1, "y", False), (2, None, None)]


# symbols


def test_symbol_dedup_prefers_declarations_and_is_idempotent(spark):
    s = spark.createDataFrame([(1, "f", "function (re-export)"), (2, "f", "function"), (3, "f", "function"), (4, "g", "class")], "id int, name string, kind string")
    once = symbols.dedup(s, ["id"])
    assert rows(once.select("id")) == [(2,), (4,)]
    assert rows(symbols.dedup(once.select("id", "name", "kind"), ["id"]).select("id")) == [(2,), (4,)]


def test_candidates(spark):
    s = spark.createDataFrame([("foo", "function", "a.ts", 1, 1, None), ("foo", "class", "node_modules/x/b.ts", 1, 1, None), ("foo", "class", "b.ts", 9, 1, None), ("foo", "class", "b.ts", 2, 1, "c"), ("fooBar", "class", "c.ts", 1, 1, None)], "name string, kind string, path string, line int, character int, container_name string")
    got = [(r["path"], r["line"]) for r in symbols.candidates(s, "foo").orderBy("place").collect()]
    assert got == [("b.ts", 2), ("b.ts", 9), ("a.ts", 1), ("node_modules/x/b.ts", 1)]
    assert [r["path"] for r in symbols.candidates(s, "foo", "a.ts").collect()] == ["a.ts"]
    assert symbols.candidates(s, "fzz").count() == 0


def test_workspace_filter_is_off_where_it_is_empty(spark):
    s = spark.createDataFrame([("a",), ("b",)], "path string")
    assert symbols.in_workspace(s, s.where("path = 'a'")).count() == 1
    assert symbols.in_workspace(s, s.limit(0)).count() == 2


def test_trees(spark):
    s = spark.createDataFrame([("a", "root", 1, 1, 9, 1), ("a", "kid", 2, 1, 3, 1), ("a", "kid2", 4, 1, 5, 1)], "path string, id string, sl int, sc int, el int, ec int")
    assert [r["id"] for r in symbols.flattened(s).orderBy("place").collect()] == ["kid", "kid2", "root"]
    assert [r["id"] for r in symbols.flattened(s, False).orderBy("place").collect()] == ["root", "kid", "kid2"]


def test_overload_implementations(spark):
    text = ["f(a): b;", "", "// c", "f(b): c;", "f(x) { }"]
    df = spark.createDataFrame([("a", k + 1, x) for k, x in enumerate(text)], "path string, line_no int, line string")
    assert rows(symbols.overload_implementations(df)) == [("a", 1, 5), ("a", 4, 5)]


# references and calls


def test_classes(spark):
    r = spark.createDataFrame([("a", 1, 1, "import x"), ("a", 2, 1, "import x"), ("a", 3, 1, "export * from 'x'"), ("a", 4, 1, "x()"), ("a", 5, 1, None)], "path string, sl int, sc int, line_text string")
    c = references.classify(r, r.where("sl = 1"))
    assert rows(c.select("sl", "class")) == [(1, "definition"), (2, "import"), (3, "reexport"), (4, "call"), (5, "call")]
    assert references.class_counts(c).first()[:] == (5, 1, 1, 2, 1)


def test_calls(spark):
    c = spark.createDataFrame([(1, "a", 5, "f", "function", None, 2, 2), (2, "a", 5, "g", "function", None, 1, 1), (3, "a", 5, "f", "function", None, 1, 1), (4, "b", 1, "h", "property", None, 1, 1)], "ord int, path string, line int, name string, kind string, detail string, sl int, sc int")
    m = references.merge_calls(c)
    assert [(r["name"], [tuple(x) for x in r["sites"]]) for r in m.orderBy("path").collect()] == [("f", [(1, 1), (2, 2)]), ("h", [(1, 1)])]
    assert references.callable_only(m).count() == 1
    ws = spark.createDataFrame([("./a/",)], "path string")
    e = references.mark_external(m, ws)
    assert rows(e.select("path", "external")) == [("a", False), ("b", True)]
    assert references.internal(e.withColumn("external", F.lit(None).cast("boolean"))).count() == 2
    assert not any(x[0] for x in references.mark_external(m, ws.limit(0)).select("external").collect())
    d = spark.createDataFrame([("f", "function", "x", 1, None, True), ("f", "function", "y", 1, "d", False), ("f", "function", "w", 1, "", False)], "name string, kind string, path string, line int, detail string, external boolean").withColumn("sites", F.array(F.struct(F.lit(1).alias("sl"), F.lit(1).alias("sc"))))
    assert rows(references.dedup_outgoing(d).select("path")) == [("y",)]


def test_noise_and_later_wins(spark):
    flags = ["in_definition", "in_import", "assignment_lhs", "property_key", "html_tag"]
    df = spark.createDataFrame([tuple([k] + [k == j for j in range(5)]) for k in range(6)] + [(9, None, None, None, None, None)], "id int, " + ", ".join(f"{f} boolean" for f in flags))
    assert rows(references.noise_filtered(df).select("id")) == [(5,), (9,)]
    a, b = spark.createDataFrame([(1, "a"), (2, "a")], "k int, v string"), spark.createDataFrame([(2, "b")], "k int, v string")
    assert rows(references.later_wins([a, b], "k")) == [(1, "a"), (2, "b")]


def test_referenced_symbols(spark):
    r = spark.createDataFrame([("x", 1), ("x", 1), ("y", 2), ("z", 3)], "name string, query_id int")
    d = spark.createDataFrame([(1, "b", 2), (1, "a", 9), (2, "ext", 1)], "query_id int, path string, line int")
    w = spark.createDataFrame([("a",), ("b",)], "path string")
    assert rows(references.referenced_symbols(r, d, w)) == [("x", "a", 9, "internal"), ("y", "ext", 1, "external"), ("z", None, None, "not_found")]


# graph


def test_bfs_has_least_depths(spark):
    random.seed(1)
    pairs = {(random.randrange(30), random.randrange(30)) for _ in range(60)}
    e = spark.createDataFrame([(f"{a}>{b}", "calls", str(a), str(b)) for a, b in pairs], "id string, kind string, from_id string, to_id string")
    start = spark.createDataFrame([("0",)], "id string")
    want, seen = {0: 0}, {0}
    for d in range(1, 5):
        seen = {b for a, b in pairs if a in seen} - set(want)
        want |= dict.fromkeys(seen, d)
    for depth in (0, 1, 4):
        got = {int(r[0]): r[1] for r in graph.bfs(e, start, "outgoing", depth).collect()}
        assert got == {k: v for k, v in want.items() if v <= depth}


def test_impact_and_context(spark):
    e = spark.createDataFrame([(f"{k}:{a}{b}", k, a, b) for k, a, b in (("calls", "a", "b"), ("calls", "b", "c"), ("imports", "x", "c"), ("calls", "c", "a"), ("calls", "z", "x"))], "id string, kind string, from_id string, to_id string")
    start = spark.createDataFrame([("c",)], "id string")
    n, es = graph.impact(e, start, 1)
    assert rows(n) == [("b", 1), ("c", 0), ("x", 1)]
    assert rows(es.select("id")) == [("calls:ab",), ("calls:bc",), ("calls:zx",), ("imports:xc",)]
    assert rows(graph.impact(e, start, 1, "imports")[0]) == [("c", 0), ("x", 1)]
    n, es = graph.context(e, start, 1)
    assert rows(n.select("id")) == [("a",), ("b",), ("c",), ("x",)] and es.count() == 5
    assert graph.limited(n, es, 2)[0].count() == 2


def test_resolve(spark):
    n = spark.createDataFrame([("f", "file", "src/a.rs"), ("s1", "symbol", "Parser"), ("s2", "symbol", "myparse")], "id string, node_type string, name string")
    assert rows(graph.resolve(n, "src/a.rs").select("id")) == [("f",)]
    assert rows(graph.resolve(n, "pars").select("id")) == [("s1",)]
    assert rows(graph.resolve(n, "arse").select("id")) == [("s1",), ("s2",)]
    assert graph.resolve(n, "zzz").count() == 0


def test_build_and_remove(spark):
    f = spark.createDataFrame([("a.rs",), ("b.rs",)], "path string")
    s = spark.createDataFrame([("a.rs", "main", "function", 1, 1), ("b.rs", "run", "function", 2, 1), ("b.rs", "T", "struct", 9, 1)], "path string, name string, kind string, sl int, sc int")
    c = spark.createDataFrame([("a.rs", "main", "b.rs", "run"), ("b.rs", "T", "a.rs", "main")], "path string, caller string, to_path string, name string")
    g = graph.build(f, s, c)
    assert rows(graph.edge_counts(g)) == [("calls", 1), ("defines", 3)]


# index


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, ver int")
    new = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 1)], "k int, v string, ver int")
    once = index.upsert(old, new, ["k"], "ver")
    assert rows(once) == [(1, "a", 1), (2, "d", 3), (3, "e", 1)]
    assert rows(index.upsert(once, new, ["k"], "ver")) == rows(once)


def test_state_and_changes(spark):
    s = spark.createDataFrame([("a", "1")], "key string, value string")
    assert rows(index.put_state(s, "a", "2")) == [("a", "2")] and index.put_state(s, "a", None).count() == 0
    now = spark.createDataFrame([("same", "1"), ("new", "1"), ("other", "2")], "path string, content_hash string")
    was = spark.createDataFrame([("same", "1"), ("other", "1"), ("gone", "1")], "path string, content_hash string")
    assert rows(index.changed(now, was)) == [("gone", "deleted"), ("new", "new"), ("other", "changed"), ("same", "unchanged")]


def test_atomic_overwrite(spark, tmp_path):
    p = str(tmp_path / "t")
    index.overwrite_atomically(spark.range(3), p)
    index.overwrite_atomically(spark.read.parquet(p).where("id > 0"), p)
    assert spark.read.parquet(p).count() == 2
    index.reset(spark.read.parquet(p), p)
    assert spark.read.parquet(p).count() == 0
    assert index.load_or_empty(spark, str(tmp_path / "no"), "id long")[1] == "Empty"


def test_fetch_keeps_order_and_duplicates(spark):
    q = spark.createDataFrame([(0, "b"), (1, "zz"), (2, "b")], "pos int, k string")
    e = spark.createDataFrame([("b", 1)], "k string, v int")
    assert [(r["pos"], r["v"]) for r in index.fetch_in_order(q, e, "k").orderBy("pos").collect()] == [(0, 1), (1, None), (2, 1)]


# search


def test_search(spark):
    v = spark.createDataFrame([("s1", "src/a", [1.0, 0.0], "x foo", None), ("s1", "src/b", [1.0, 0.0], "x foo", None), ("s2", "src/a", [0.9, 0.1], "bar", "foo"), ("s3", "lib/c", [0.0, 1.0], "", None), ("s4", "src/d", [-1.0, 0.0], "", None)], "segment_hash string, path string, embedding array<float>, code string, symbol string").withColumn("id", F.concat("segment_hash", "path")).withColumn("kind", F.lit(None).cast("string"))
    q = spark.createDataFrame([(0, [1.0, 0.0])], "qid int, q array<float>")
    t = search.top_k(search.score(v, q), 0)
    assert t.count() == 1  # k is 1 at least
    whole = search.top_k(search.score(v, q), 5000)
    assert whole.count() == 5
    for k in (1, 3):
        assert set(rows(search.top_k(search.score(v, q), k).select("id"))) <= set(rows(whole.select("id")))
    got = search.semantic_search(v, q, "foo", 5, "src", 0.1)
    assert [(r["path"], r["segment_hash"]) for r in got.orderBy("rank").collect()] == [("src/a", "s1")]
    assert search.post_filter(whole, kinds=["a"]).count() == 0
    assert search.filtered(v, "nowhere").count() == 0


# usage, markdown, sources


def test_usage(spark):
    c = spark.createDataFrame([("a", True), ("a", False), ("b", None)], "tool string, success boolean")
    assert rows(usage.tool_stats(c)) == [("a", 2, 1, 1), ("b", 1, 0, 1)]
    assert usage.enabled(["a", "b", "c"], None, ["b"]) == ["a", "c"]
    assert usage.enabled(["a", "b", "c"], ["b", "c"], ["b"]) == ["c"]
    assert usage.merged_settings({"x": {"a": 1}}, {"x": {"a": 2, "b": 3}, "y": 1}, {"y": 0, "z": None}) == {"x": {"a": 1, "b": 3}, "y": 1, "z": None}
    assert usage.may_become("Ready", "Updating") and not usage.may_become("Disabled", "Ready")
    assert usage.projected({"title": "t", "type": "object", "items": {"$schema": "s", "type": "x"}}) == {"type": "object", "items": {"type": "x"}}


def test_settings_files(tmp_path):
    assert usage.load_settings(str(tmp_path / "no.json")) is None
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(ValueError):
        usage.load_settings(str(tmp_path / "bad.json"))
    assert usage.load_stats(str(tmp_path / "bad.json")) == {}


def test_markdown(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), ("c", 9)], "path string, count long")
    assert markdown.references_summary(df).first()[0] == "- `c`: 9\n- `a`: 1\n- `b`: 1"


def test_file_scan(spark, tmp_path):
    for p, t in (("src/a.py", "x\ny"), ("src/sub/b.rs", "z"), ("node_modules/m/i.js", "1"), (".git/x", "1"), ("out/o.py", "1"), ("e.txt", "")):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    (tmp_path / "src/bad.py").write_bytes(b"a\xff")
    got = sources.scan(spark, str(tmp_path), exclude=["node_modules"], ignore="out/\n# c\n")
    assert rows(got.select("path", "language", "line_count")) == [("src/a.py", "python", 2), ("src/bad.py", "python", 1), ("src/sub/b.rs", "rust", 1)]
    assert rows(sources.scan(spark, str(tmp_path), ["**/*.rs"], []).select("path")) == [("src/sub/b.rs",)]
    assert rows(sources.folders(got)) == [("src",), ("src/sub",)]
    assert got.where("path = 'src/bad.py'").first()["content"] == "a�"


def test_ignore_rules(spark):
    rules = sources.ignore_rules("*.log\n!keep.log\n/top\nsub/dir/\n")
    hit = lambda p: spark.range(1).select(sources.ignored(F.lit(p), rules)).first()[0]
    assert [hit(p) for p in ("a/x.log", "keep.log", "top/a", "a/top", "sub/dir/x", "sub/dir")] == [True, False, True, False, True, False]


# streams


def events_df(spark):
    return spark.createDataFrame([("a", "2024-01-01 00:00:00", "modify"), ("a", "2024-01-01 00:00:01", "modify"), ("a", "2024-01-01 00:00:09", "delete"), ("b", "2024-01-01 00:00:00", "create"), ("node_modules/x", "2024-01-01 00:00:00", "create")], "path string, ts string, op string").withColumn("ts", F.col("ts").cast("timestamp"))


def test_event_operators(spark):
    e = events.wanted(events_df(spark), exclude=["node_modules/**"])
    assert e.count() == 4
    assert rows(events.debounced(e).select("path", "n")) == [("a", 1), ("a", 2), ("b", 1)]
    assert rows(events.routed(e)) == [("a", "delete"), ("b", "upsert")]
    assert rows(events.microbatches(e).select("path")) == [("a",), ("a",), ("b",)]
    assert rows(events.toggled(e)) == [("a",), ("b",)]


def test_stream_keeps_a_table(spark, tmp_path):
    src, table, content = tmp_path / "in", str(tmp_path / "t"), {"a": "one", "b": "two"}
    src.mkdir()

    def put(name, items):
        (src / name).write_text("\n".join(json.dumps({"path": p, "ts": t, "op": o}) for p, t, o in items))

    def read(changed):
        known = changed.sparkSession.createDataFrame(list(content.items()), "path string, content string")
        return changed.join(known, "path").select("path", "content")

    put("1.json", [("a", "2024-01-01T00:00:00Z", "create"), ("b", "2024-01-01T00:00:00Z", "create")])
    run = lambda: events.keep_index(events.file_events(spark, str(src)), table, read, str(tmp_path / "ck"))
    run()
    assert rows(versions.read(spark, table)) == [("a", "one"), ("b", "two")]
    content["a"] = "new"
    put("2.json", [("a", "2024-01-01T00:01:00Z", "modify"), ("b", "2024-01-01T00:01:00Z", "delete")])
    run()
    run()
    assert rows(versions.read(spark, table)) == [("a", "new")]
    assert rows(versions.read(spark, table, 0)) == [("a", "one"), ("b", "two")]


def test_stream_counts_as_the_batch_does(spark, tmp_path):
    src = tmp_path / "calls"
    src.mkdir()
    (src / "1.json").write_text('{"tool": "a", "success": true}\n{"tool": "a", "success": false}\n{"tool": "b"}')
    s = spark.readStream.schema("tool string, success boolean").json(str(src))
    q = events.running_counters(s).writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    batch = events.running_counters(spark.read.schema("tool string, success boolean").json(str(src)))
    assert rows(spark.table("counted")) == rows(batch) == [("a", 2, 1, 1), ("b", 1, 0, 1)]


def test_walk(spark):
    df = spark.createDataFrame([("a/b/c",), ("x/b",), ("b",)], "p string")
    assert rows(df.where(~paths.under_excluded(F.col("p"), ["a"]))) == [("b",), ("x/b",)]


# later additions


def test_an_unknown_language_is_chunked_by_lines(spark):
    from saltmarsh.operators import indexer

    text = "\n".join(f"some line number {k} of this text" for k in range(30))
    f = spark.createDataFrame([("a", None, text), ("b", "zzz", text), ("c", "python", "def f(x):\n" + "    y = x\n" * 9)], "path string, language string, content string")
    got = {r["path"]: r["symbol_kind"] for r in indexer.chunk(f).collect()}
    assert got == {"a": "lines", "b": "lines", "c": "function"}


def test_readers_see_the_old_table_between_renames(spark, tmp_path):
    p = str(tmp_path / "t")
    index.overwrite_atomically(spark.range(3), p)
    (tmp_path / "t").rename(tmp_path / "t.old")
    df, state = index.load_or_empty(spark, p, "id long")
    assert state == "Ready" and df.count() == 3
    index.overwrite_atomically(spark.range(5), p)
    assert index.load_or_empty(spark, p, "id long")[0].count() == 5


def test_next_ids_are_dense_and_in_order(spark):
    old = spark.createDataFrame([(4,), (9,)], "id long")
    for n in (0, 1, 300):
        new = spark.createDataFrame([(f"k{(k * 37) % 1000:04d}",) for k in range(n)] * 2, "k string")
        got = sorted((r["id"], r["k"]) for r in index.next_ids(old, new, "k").collect())
        assert [r[0] for r in got] == list(range(10, 10 + n)) and [r[1] for r in got] == sorted(r[1] for r in got)


def test_noise_by_language(spark):
    from saltmarsh.operators import references

    cases = [
        (1, "x", "rust", ["call_expression"], None, False),
        (2, "x", "rust", ["identifier", "function_item"], None, True),
        (3, "x", "tsx", ["import_specifier"], None, True),
        (4, "x", "python", ["assignment"], "left", True),
        (5, "x", "python", ["assignment"], "right", False),
        (6, "x", "javascript", ["pair"], "key", True),
        (7, "x", "go", ["pair"], "key", False),
        (8, "Div", "rust", [], None, True),
        (9, "x", None, ["function_item"], "left", False),
        (10, "x", "ruby", ["assignment"], "right", True),
    ]
    df = spark.createDataFrame([c[:5] for c in cases], "id int, name string, language string, ancestors array<string>, field string")
    kept = {r["id"] for r in references.noise_filtered(references.noise_flags(df)).collect()}
    assert kept == {c[0] for c in cases if not c[5]}


def test_search_reads_facts_of_the_best_only(spark):
    v = spark.createDataFrame([(k, [1.0, k / 10]) for k in range(20)], "id int, embedding array<float>")
    f = spark.createDataFrame([(k, f"src/f{k}", f"code {k}", None) for k in range(0, 20, 2)], "id int, path string, code string, symbol string")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "qid int, q array<float>")
    whole = v.join(f, "id").withColumn("segment_hash", F.sha2("code", 256))
    both = [search.semantic_search(x, q, "code 4", 4, "src", 0.1, facts=y).select("id", "path", "score", "rank") for x, y in ((whole, None), (v, f))]
    assert sorted(rows(both[0])) == sorted(rows(both[1])) and both[0].count() == 4
    plan = both[1]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("sha2(") < plan.rindex("WindowGroupLimit")


def test_stores(spark):
    from saltmarsh.operators import stores

    e = spark.createDataFrame([("h1", "a/x", ["t"]), ("h2", "a/y", None), ("h3", "b", [])], "segment_hash string, path string, tags array<string>")
    ids = spark.createDataFrame([("h1", 1), ("h2", 5), ("h3", 7), ("gone", 9)], "segment_hash string, id int")
    assert rows(stores.paths_from_id(e, ids, 5)) == [("a/y",), ("b",)] and rows(stores.ids_under(e, ids, "a")) == [(1,), (5,)]
    assert stores.exists(e, "path", "b") and not stores.exists(e, "path", "zz")
    assert rows(stores.entries(e, ids.unionByName(ids)).select("path")) == [("a/x",), ("a/y",), ("b",)]
    assert rows(stores.read_tags(stores.with_tags(e).drop("tags")).select("segment_hash", "tags")) == rows(e.select("segment_hash", "tags"))


def test_every_public_function_is_used():
    """Each function of the library is called by a query, a tool, a stream or another function."""
    import pathlib
    import re

    root = pathlib.Path(__file__).parents[1] / "saltmarsh"
    parts = [p for p in root.rglob("*.py") if "llm" not in p.parts]
    text = {p: p.read_text() for p in parts}
    lost = []
    for p in parts:
        if p.parent.name not in ("operators", "functions", "sources", "streaming"):
            continue
        for name in re.findall(r"^def ([a-z]\w*)\(", text[p], re.M):
            if not any(re.search(rf"\b{name}\b(?<!def {name})", re.sub(rf"^def {name}\(", "", t, flags=re.M)) for t in text.values()):
                lost.append(f"{p.stem}.{name}")
    # for users, and covered by tests: what writes, waits or draws
    assert set(lost) <= {"events.file_events", "events.keep_index", "events.running_counters", "index.reset", "indexer.fits", "indexer.repair", "markdown.diagnostics_report", "markdown.graph_report", "markdown.references_summary", "markdown.symbols_list", "usage.load_stats", "usage.may_become", "usage.projected", "usage.save_stats", "usage.state_valid", "text.inline_code", "text.truncate_signature", "text.is_symbol_reexport_line", "text.symbol_column_on_line", "stores.exists", "ranges.from_wire", "paths.parent"}, lost


def test_retries_wait_longer_and_answers_are_put_in_order():
    from saltmarsh.operators import semantic

    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 4:
            raise semantic.RateLimited(7.0) if len(calls) == 2 else OSError("x")
        return "done"

    assert semantic.retried(call, wait=waits.append) == "done" and waits == [0.1, 7.0, 0.4]
    with pytest.raises(OSError):
        semantic.retried(lambda: (_ for _ in ()).throw(OSError("y")), 2, waits.append)
    assert len(waits) == 5
    assert semantic.in_order([(1, [2]), (0, [1])], 2) == [[1.0], [2.0]] and semantic.in_order([[3]], 1) == [[3.0]]
    with pytest.raises(ValueError, match="1 vectors for 2"):
        semantic.in_order([[3]], 2)


def test_a_failing_source_is_left_out(spark):
    ok = lambda: spark.range(2).select(F.col("id").alias("k"))
    bad = lambda: spark.read.parquet("/nowhere/at/all")
    found, failed = sources.union_of_sources({"x": ok, "y": bad}, ["k"])
    assert rows(found) == [(0, "x"), (1, "x")] and list(failed) == ["y"]
    with pytest.raises(Exception, match="nowhere"):
        sources.union_of_sources({"y": bad}, ["k"])
