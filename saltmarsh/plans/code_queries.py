"""Queries over a workspace of code made from the tables: syntax, chunks, stores, and each tool of the query API.

Every part is a file of Python with one function that its line items call.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators import indexer, positions, semantic, stores, symbols
from ..sources import files as file_source
from ..sources.tables import table
from ..sources.work import scratch
from ..streaming import events as streams
from ..tools import Workspace
from .registry import query

PATH = "'pkg' || p_size || '/m' || p_partkey || '.py'"
CODE = "'# about ' || p_name || chr(10) || 'def s' || p_partkey || '(x):' || chr(10) || '    y = helper(x, \"' || p_type || '\")' || chr(10) || '    return y' || chr(10)"


def _key(k: str, before: str, after: str = ""):
    return F.concat(F.lit(before), F.col(k).cast("string"), F.lit(after))


def _path(k="p_partkey"):
    return F.concat(F.lit("pkg"), F.col("p_size").cast("string"), _key(k, "/m", ".py"))


def code_files(spark, d):
    code = F.concat(F.lit("# about "), "p_name", F.lit("\ndef "), _key("p_partkey", "s", "(x):\n    y = helper(x, \""), "p_type", F.lit("\")\n    return y\n"))
    return table(spark, d, "part").select(_path().alias("path"), code.alias("content"), F.lit("python").alias("language"), F.lit(False).alias("is_external"), "p_partkey", "p_size")


def workspace(spark, d) -> Workspace:
    p, li = table(spark, d, "part"), table(spark, d, "lineitem")
    name = _key("p_partkey", "s")
    last = F.length(name) + 4
    syms = p.select(name.alias("id"), _path().alias("path"), name.alias("name"), F.lit("function").alias("kind"), F.lit(2).alias("sl"), F.lit(5).alias("sc"), F.lit(4).alias("el"), F.lit(13).alias("ec"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("container_name"), F.col("p_partkey").alias("ord"), F.lit("function").alias("rule_id"))
    place = p.select(F.col("p_partkey").alias("l_suppkey"), _path().alias("path"))
    uses = li.select("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag").join(place, "l_suppkey")
    refs = uses.select(_key("l_partkey", "s").alias("query_id"), "path", F.col("l_linenumber").alias("sl"), F.col("l_quantity").cast("int").alias("sc"), F.col("l_linenumber").alias("el"), (F.col("l_quantity").cast("int") + 5).alias("ec"))
    defs = syms.select(F.col("id").alias("query_id"), "path", "sl", "sc", F.lit(2).alias("el"), (F.length("name") + 4).alias("ec"))
    external = p.where("p_size > 25").select(name.alias("query_id"), _key("p_partkey", "node_modules/x/", ".js").alias("path"), F.lit(1).alias("sl"), F.lit(1).alias("sc"), F.lit(9).alias("el"), F.lit(1).alias("ec"))
    idents = p.select(_path().alias("path"), name.alias("name"), F.lit(2).alias("sl"), F.lit(5).alias("sc"), F.lit(2).alias("el"), last.cast("int").alias("ec"))
    matches = idents.select("path", F.lit("function-call").alias("rule_id"), F.lit("s9").alias("name"), F.lit(3).alias("sl"), F.lit(9).alias("sc"), F.lit(3).alias("el"), F.lit(15).alias("ec"))
    calls = uses.select(_key("l_partkey", "s").alias("query_id"), F.when(F.col("l_returnflag") == "R", "incoming").otherwise("outgoing").alias("direction"), "path", F.lit(2).alias("line"), _key("l_suppkey", "s").alias("name"), F.when(F.col("l_returnflag") == "A", "property").otherwise("function").alias("kind"), F.lit(None).cast("string").alias("detail"), F.col("l_linenumber").alias("sl"), F.col("l_quantity").cast("int").alias("sc"), F.col("l_linenumber").alias("ord"))
    hovers = p.select(_path().alias("path"), F.lit(2).alias("line"), F.lit(5).alias("character"), F.concat(F.lit("```python\ndef "), name, F.lit("(x)\n```\nabout "), "p_name").alias("markdown"))
    diags = table(spark, d, "events").join(p.select(F.col("p_partkey").alias("user_id"), _path().alias("path")), "user_id").select("path", F.when(F.col("event_type").isin("error", "view"), F.when(F.col("event_type") == "error", "error").otherwise("warning")).alias("severity"), F.lit("m").alias("message"))
    nodes = syms.select("id", F.lit("symbol").alias("node_type"), "name").unionByName(p.select(_path().alias("id"), F.lit("file").alias("node_type"), _path().alias("name")))
    e = uses.select(F.lit("calls").alias("kind"), _key("l_partkey", "s").alias("from_id"), _key("l_suppkey", "s").alias("to_id")).distinct()
    e = e.unionByName(syms.select(F.lit("defines").alias("kind"), F.col("path").alias("from_id"), F.col("id").alias("to_id"))).withColumn("id", F.concat_ws(">", "kind", "from_id", "to_id"))
    vec = table(spark, d, "embeddings").select(F.col("vec_id").alias("p_partkey"), "embedding").join(code_files(spark, d), "p_partkey").select(_key("p_partkey", "v").alias("id"), "path", _key("p_partkey", "h").alias("segment_hash"), "embedding", F.col("content").alias("code"), _key("p_partkey", "s").alias("symbol"), F.lit("function").alias("kind"))
    return Workspace(code_files(spark, d).drop("p_partkey", "p_size"), syms, idents, refs, defs.unionByName(external), matches, calls, hovers, diags, nodes, e, vec, implementations=refs)


FILES = f"f AS (SELECT {PATH} AS path, {CODE} AS content, p_partkey, p_size, p_name, p_type, 's' || p_partkey AS name FROM part)"


# sources and chunks


@query("SELECT n_regionkey, n_nationkey, 'unknown' AS language, n_name || chr(10) AS content, CAST(strlen(n_name) + 1 AS BIGINT) AS size_bytes, sha256(n_name || chr(10))[1:32] AS content_hash FROM nation WHERE n_regionkey <> 3 AND n_nationkey <> 5", views=False)
def workspace_scan(spark, d):
    """Files of a folder, one for each nation, found by globs and an ignore file."""
    root = scratch(spark, "files")
    n = table(spark, d, "nation").select("n_name", "n_regionkey", "n_nationkey")
    n.repartition("n_nationkey").write.partitionBy("n_regionkey", "n_nationkey").text(root)
    found = file_source.scan(spark, root, ["**/*.txt"], ["n_regionkey=3"], "n_nationkey=5/\n")
    number = lambda k: F.regexp_extract("path", rf"{k}=(\d+)/", 1).cast("int").alias(k)
    return found.select(number("n_regionkey"), number("n_nationkey"), "language", "content", "size_bytes", "content_hash")


@query(f"WITH {FILES} SELECT path, match_type, rule_id, m.name AS name, CAST(sl AS INT) AS sl, CAST(sc AS INT) AS sc FROM f, (VALUES ('symbol', 'function', '', 2, 5), ('symbol', 'local-variable', 'y', 3, 5), ('reference', 'function-call', 'helper', 3, 9)) t(match_type, rule_id, n, sl, sc), LATERAL (SELECT CASE WHEN n = '' THEN f.name ELSE n END AS name) m")
def syntax_scan(spark, d):
    return semantic.syntax_matches(code_files(spark, d)).where(~F.col("rule_id").isin("all-identifiers", "all-references")).select("path", "match_type", "rule_id", "name", "sl", "sc")


@query(f"WITH {FILES} SELECT path, 2 AS start_line, 4 AS end_line, content[:-2] AS code, '# about ' || p_name AS doc_comment, name AS symbol_name, 'function' AS symbol_kind FROM f")
def semantic_chunks(spark, d):
    return semantic.semantic_chunks(code_files(spark, d)).drop("segment_hash")


@query(f"WITH {FILES} SELECT path, CASE WHEN p_size % 2 = 0 THEN 2 ELSE 1 END AS start_line, CASE WHEN p_size % 2 = 0 THEN 'function' ELSE 'lines' END AS symbol_kind FROM f")
def chunk_dispatch(spark, d):
    """Languages with rules are cut at boundaries; others, and none, by lines."""
    f = code_files(spark, d).withColumn("language", F.when(F.col("p_size") % 2 == 0, "python").when(F.col("p_size") % 3 == 0, "text"))
    return indexer.chunk(f).select("path", "start_line", "symbol_kind")


@query(f"WITH {FILES} SELECT path, 64 AS dim, CAST(1 AS DOUBLE) AS norm FROM f")
def chunks_with_vectors(spark, d):
    """Every chunk with the vector of its hash."""
    made = indexer.update(indexer.empty(spark), code_files(spark, d).select("path", "language", "content"))
    v = made.chunks.join(made.vectors, "segment_hash")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return v.select("path", F.size("embedding").alias("dim"), F.round(norm, 6).alias("norm"))


@query("SELECT p_partkey AS id, CASE WHEN p_size < 10 THEN 'cached' WHEN p_size % 2 = 0 AND p_size % 3 <> 0 THEN 'k' || p_partkey END AS summary FROM part", views=False)
def enrichment_states(spark, d):
    """Cached descriptions stay, kinds that can be described are, others have none."""
    p = table(spark, d, "part")
    c = p.select(F.col("p_partkey").alias("id"), "p_size", _key("p_partkey", "k").alias("segment_hash"), F.when(F.col("p_size") % 2 == 0, "function").otherwise("lines").alias("symbol_kind"), F.when(F.col("p_size") % 3 != 0, _key("p_partkey", "k")).otherwise("").alias("code"))
    cached = c.where("p_size < 10").select("segment_hash", F.lit("cached").alias("summary"), F.array(F.lit("t")).alias("tags"))
    return semantic.enrich(c, cached, lambda code: json.dumps({"summary": code, "tags": []})).select("id", "summary")


@query("SELECT p_partkey AS id FROM part WHERE p_size % 2 = 0 AND p_size % 3 <> 0", views=False)
def enrichable(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 2 == 0, "type").otherwise("lines").alias("symbol_kind"), F.when(F.col("p_size") % 3 != 0, "x").otherwise("").alias("code"))
    return semantic.enrichable(p).select("id")


@query(f"WITH {FILES} SELECT path, count(*) AS n FROM f JOIN events ON user_id = p_partkey WHERE p_size % 2 = 1 AND p_size <> 7 GROUP BY path")
def wanted_events(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("p_partkey")).join(code_files(spark, d), "p_partkey").select("path")
    return streams.wanted(e, ["pkg*[13579]/*.py"], ["pkg7/**"]).groupBy("path").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, CASE WHEN p_size > 30 THEN 'fn ' || p_name || '()' WHEN p_size > 15 THEN 'let x' ELSE p_name || ' is' END AS signature, CASE WHEN p_size > 15 THEN 'about ' || p_name ELSE p_name || ' is' END AS text FROM part", views=False)
def hover_signature(spark, d):
    md = F.when(F.col("p_size") > 30, F.concat(F.lit("```rust\nlet x\n```\n```rust\nfn "), "p_name", F.lit("()\n```\nabout "), "p_name")).when(F.col("p_size") > 15, F.concat(F.lit("```\nlet x\n```\n\nabout "), "p_name")).otherwise(F.concat("p_name", F.lit(" is")))
    return table(spark, d, "part").withColumn("md", md).select("p_partkey", text.hover_signature(F.col("md"), F.col("p_name")).alias("signature"), text.hover_text(F.col("md")).alias("text"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'rust' WHEN p_size % 3 = 1 THEN 'c' ELSE 'unknown' END AS graph, CASE WHEN p_size % 3 = 0 THEN 'rust' WHEN p_size % 3 = 1 THEN 'cpp' ELSE 'unknown' END AS syntax FROM part", views=False)
def languages_of_headers(spark, d):
    p = F.concat("p_name", F.element_at(F.array(*map(F.lit, (".rs", ".h", ".zzz"))), (F.col("p_size") % 3 + 1).cast("int")))
    return table(spark, d, "part").select("p_partkey", paths.detect_language(p).alias("graph"), paths.detect_language(p, paths.SYNTAX_LANGUAGES).alias("syntax"))


# symbols


@query(f"WITH {FILES} SELECT name FROM f WHERE p_size > 10")
def symbols_in_workspace(spark, d):
    return symbols.in_workspace(workspace(spark, d).symbols, code_files(spark, d).where("p_size > 10")).select("name")


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY e, l_linenumber DESC, l_partkey) AS INT) AS place FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_linenumber + l_partkey % 5 AS e FROM lineitem)", views=False)
def flattened_tree(spark, d):
    s = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    s = s.select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("sl"), F.lit(1).alias("sc"), (F.col("l_linenumber") + F.col("l_partkey") % 5).alias("el"), F.lit(1).alias("ec"), F.col("l_partkey").alias("id"))
    return symbols.flattened(s).select(F.col("path").alias("l_orderkey"), F.col("sl").alias("l_linenumber"), F.col("id").alias("l_partkey"), "place")


@query("SELECT p_partkey FROM part WHERE p_size % 4 = 0", views=False)
def without_children(spark, d):
    return symbols.without_children(table(spark, d, "part").withColumn("depth", F.col("p_size") % 4)).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size % 3 = 0 AND p_name <> 'red widget'", views=False)
def related_symbols(spark, d):
    rule = F.element_at(F.array(*map(F.lit, ("function", "local-variable", "all-identifiers"))), (F.col("p_size") % 3 + 1).cast("int"))
    return symbols.related(table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"), rule.alias("rule_id")), "red widget").select("p_partkey")


# stores


@query("SELECT p_partkey FROM part WHERE p_brand = 'Brand#3'", views=False)
def symbols_of_a_file(spark, d):
    return stores.by_key(table(spark, d, "part"), "p_brand", "Brand#3").select("p_partkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)", views=False)
def entries_of_hashes(spark, d):
    e = table(spark, d, "orders").select(F.col("o_custkey").alias("segment_hash"), "o_orderkey")
    return stores.entries(e, table(spark, d, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("segment_hash"))).select("o_orderkey")


@query("SELECT vec_id AS id FROM embeddings JOIN files ON doc_id = vec_id WHERE starts_with(path, 'src1/')")
def ids_under_a_path(spark, d):
    from ..sources.tables import files

    e = files(spark, d).select(F.col("doc_id").alias("segment_hash"), "path")
    return stores.ids_under(e, table(spark, d, "embeddings").select(F.col("vec_id").alias("segment_hash"), F.col("vec_id").alias("id")), "src1")


# tools: the function of part 7, and of others where that has little

AT = f"t AS (SELECT * FROM f WHERE p_partkey = 7)"


def _seven(spark, d):
    w = workspace(spark, d)
    size = table(spark, d, "part").where("p_partkey = 7").first()["p_size"]
    return w, f"pkg{size}/m7.py"


@query(f"WITH {FILES} SELECT path FROM f ORDER BY path LIMIT 50 OFFSET 10")
def tool_list_files(spark, d):
    return workspace(spark, d).list_files(50, 10)


@query(f"WITH {FILES}, {AT} SELECT path, 's7' AS source FROM t")
def tool_read_source_code(spark, d):
    w, path = _seven(spark, d)
    return w.read_source_code(path, 2, 5, 2, 7)


@query(f"WITH {FILES}, {AT} SELECT name, kind, array_to_string(string_split(content, chr(10))[1:3], chr(10)) AS snippet FROM t, (SELECT 'function' AS kind)")
def tool_document_symbol(spark, d):
    w, path = _seven(spark, d)
    return w.document_symbol(path).select("name", "kind", "snippet")


@query(f"WITH {FILES} SELECT name, CASE WHEN name = 's1' THEN 'exact' WHEN starts_with(name, 's1') THEN 'prefix' WHEN contains(name, 's1') THEN 'substring' ELSE 'fuzzy' END AS match_kind FROM f WHERE regexp_matches(name, 's.*1') ORDER BY name LIMIT 200")
def tool_find_symbol(spark, d):
    return workspace(spark, d).find_symbol("s1").select("name", "match_kind")


@query(f"WITH {FILES}, {AT} SELECT name, array_to_string(string_split(content, chr(10))[2:4], chr(10)) AS source FROM t")
def tool_get_symbol_definition(spark, d):
    w, path = _seven(spark, d)
    return w.get_symbol_definition("s7", path).select("name", "source")


@query(f"WITH {FILES}, {AT} SELECT 0 AS tier, name, 2 AS sl, 5 AS sc FROM t")
def tool_find_identifier(spark, d):
    w, path = _seven(spark, d)
    return w.find_identifier(path, "s7", 2, 6).select("tier", "name", "sl", "sc")


@query(f"WITH {FILES}, {AT} SELECT path, FALSE AS external, name, array_to_string(string_split(content, chr(10))[2:4], chr(10)) AS source FROM t UNION ALL SELECT 'node_modules/x/7.js', TRUE, NULL, NULL FROM t WHERE p_size > 25")
def tool_go_to_definition(spark, d):
    w, path = _seven(spark, d)
    return w.definition_with_context(path, 2, 6)["definitions"].select("path", "external", "name", "source")


@query(f"WITH {FILES} SELECT path, CAST(l_linenumber AS INT) AS sl, CAST(l_quantity AS INT) AS sc, 's7' AS selected FROM lineitem JOIN f ON p_partkey = l_suppkey WHERE l_partkey = 7")
def tool_go_to_implementation(spark, d):
    w, path = _seven(spark, d)
    return w.go_to_implementation(path, 2, 6).select("path", "sl", "sc", "selected")


@query(f"WITH {FILES} SELECT count(*) AS total, count(*) FILTER (l_suppkey = 7 AND l_linenumber = 2 AND CAST(l_quantity AS INT) = 5) AS definitions FROM lineitem JOIN f ON p_partkey = l_suppkey WHERE l_partkey = 7")
def tool_find_references(spark, d):
    w, path = _seven(spark, d)
    return w.find_references("s7", path)["counts"].select("total", "definitions")


@query(f"WITH {FILES} SELECT path, count(*) AS count FROM lineitem JOIN f ON p_partkey = l_suppkey WHERE l_partkey = 7 GROUP BY path ORDER BY count DESC, path LIMIT 10")
def tool_reference_files(spark, d):
    w, path = _seven(spark, d)
    return w.find_references("s7", path)["files"]


@query(f"WITH {FILES} SELECT 's9' AS name, CASE WHEN p_size > 25 THEN 'node_modules/x/9.js' ELSE path END AS path, CASE WHEN p_size > 25 THEN 1 ELSE 2 END AS line, CASE WHEN p_size > 25 THEN 'external' ELSE 'internal' END AS status FROM f WHERE p_partkey = 9")
def tool_find_referenced_symbols(spark, d):
    w, path = _seven(spark, d)
    return w.find_referenced_symbols(path, 2, 6, externals=True)


@query(f"WITH {FILES} SELECT DISTINCT name, path FROM lineitem JOIN f ON p_partkey = l_suppkey WHERE l_partkey = 7 AND l_returnflag = 'R'")
def tool_call_hierarchy(spark, d):
    w, path = _seven(spark, d)
    return w.call_hierarchy(path, 2, 6, "incoming").select("name", "path")


@query(f"WITH {FILES}, {AT} SELECT 0 AS idx, NULL AS signature, NULL AS text UNION ALL SELECT 1, 'def s7(x)', 'about ' || p_name FROM t")
def tool_hover(spark, d):
    w, path = _seven(spark, d)
    return w.hover(json.dumps([{"path": "nowhere", "line": 1, "character": 1}, {"path": path, "line": 2, "character": 5}])).select("idx", "signature", "text")


@query(f"WITH {FILES}, e AS (SELECT path, event_type FROM events JOIN f ON p_partkey = user_id) SELECT path, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'view') AS warning, count(*) AS total FROM e GROUP BY ROLLUP (path)")
def tool_get_diagnostics(spark, d):
    return workspace(spark, d).get_diagnostics().select("path", "error", "warning", "total")


@query("SELECT 'Ready' AS state, (SELECT count(*) FROM part) AS files, (SELECT count(*) FROM part) AS symbols, ['python'] AS languages", views=False)
def tool_health(spark, d):
    return workspace(spark, d).health().select("state", "files", "symbols", "languages")


@query(f"""WITH {FILES}, q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 1), s AS (SELECT 'v' || p_partkey AS id, content, name, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 6) AS score FROM embeddings JOIN f ON p_partkey = vec_id, q),
t AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS r FROM s QUALIFY r <= 20) SELECT id, round(score * 0.85 + CAST(contains(translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'widget') AS INT) * 0.15, 6) AS score FROM t WHERE score >= 0.4""")
def tool_semantic_search(spark, d):
    q = table(spark, d, "embeddings").where("vec_id = 1").first()["embedding"]
    return workspace(spark, d).semantic_search(q, "widget", 20).select("id", "score")


@query(f"WITH {FILES}, e AS (SELECT DISTINCT 's' || l_partkey AS a FROM lineitem JOIN part ON p_partkey = l_suppkey WHERE l_suppkey = 7 AND l_partkey <> 7) SELECT id, CAST(depth AS INT) AS depth FROM (SELECT 's7' AS id, 0 AS depth UNION ALL SELECT a, 1 FROM e UNION ALL SELECT path, 1 FROM f WHERE p_partkey = 7) ORDER BY depth, id LIMIT 50")
def tool_codemap(spark, d):
    return workspace(spark, d).codemap("impact", "s7", depth=1)["nodes"]


@query(f"WITH {FILES} SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) || '/' AS module, count(*) AS files, count(*) AS symbols FROM f GROUP BY 1 ORDER BY 1 LIMIT 50")
def tool_codemap_overview(spark, d):
    return workspace(spark, d).codemap("overview")["modules"]
