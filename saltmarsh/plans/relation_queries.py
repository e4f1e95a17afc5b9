"""Smaller relational operators: predicates, set operations, merges, settings, incremental parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths, ranges, text, values
from ..operators import index, references, search, semantic, usage
from ..sources import files as file_source
from ..sources.tables import files, table
from .registry import query


@query(r"SELECT p_partkey, p FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'a_b/%' WHEN 1 THEN 'axb/%' WHEN 2 THEN 'a_b/x' ELSE 'a_b\%' END || p_name AS p FROM part) WHERE starts_with(p, 'a_b/%')", views=False)
def escaped_prefix(spark, d):
    p = F.concat(F.element_at(F.array(*map(F.lit, ("a_b/%", "axb/%", "a_b/x", "a_b\\%"))), (F.col("p_partkey") % 4 + 1).cast("int")), "p_name")
    pattern = F.concat(text.escape_like(F.lit("a_b/%")), F.lit("%"))
    return table(spark, d, "part").withColumn("p", p).withColumn("pattern", pattern).where("p LIKE pattern").select("p_partkey", "p")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR o_orderstatus = 'O'", views=False)
def kind_membership(spark, d):
    k = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    return table(spark, d, "orders").where(k.isin("F", "O", "P")).select("o_orderkey")


@query("SELECT page_id, regexp_matches(p, '(^|/)(node_modules|target|\\.git|dist|build|vendor|\\.venv|__pycache__|\\.next)/') AS ignored, contains(p, 'vendor/') AS external, starts_with(p, '/') AND NOT starts_with(p, '/w/') AS outside FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'vendor/' WHEN 1 THEN 'a/dist/' WHEN 2 THEN '/w/' WHEN 3 THEN '/wide/' ELSE '' END || url AS p FROM pages)", views=False)
def external_paths(spark, d):
    p = F.concat(F.element_at(F.array(*map(F.lit, ("vendor/", "a/dist/", "/w/", "/wide/", ""))), (F.col("page_id") % 5 + 1).cast("int")), "url")
    return table(spark, d, "pages").select("page_id", paths.is_watcher_ignored(p).alias("ignored"), paths.is_external_path(p).alias("external"), paths.is_outside(p, "/w").alias("outside"))


@query("SELECT page_id, array_to_string(list_filter(string_split(url, '/'), lambda x: x <> '' AND x <> '.'), '/') AS p FROM pages", views=False)
def lexical_paths(spark, d):
    return table(spark, d, "pages").select("page_id", paths.lexical_path(F.concat(F.lit("./x/../"), "url")).alias("p"))


@query("SELECT p_partkey, CASE WHEN p_size > 40 THEN 'project' WHEN p_size > 20 THEN 'general' ELSE 'default' END AS setting FROM part", views=False)
def settings_override(spark, d):
    a, b = F.when(F.col("p_size") > 40, "project"), F.when(F.col("p_size") > 20, "general")
    return table(spark, d, "part").select("p_partkey", usage.first_set(a, b, F.lit("default")).alias("setting"))


@query("""
WITH t AS (SELECT c_nationkey AS owner, c_custkey % 3 AS level, CASE WHEN c_custkey % 2 = 0 THEN 'inner.' ELSE '' END || c_mktsegment AS field, CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS value FROM customer)
SELECT owner, field, value FROM t WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY owner, field ORDER BY level, value) = 1
""", views=False)
def settings_merged(spark, d):
    """Settings of projects in levels, merged field by field."""
    field = F.concat(F.when(F.col("c_custkey") % 2 == 0, "inner.").otherwise(""), "c_mktsegment")
    rows = table(spark, d, "customer").select(F.col("c_nationkey").alias("owner"), (F.col("c_custkey") % 3).alias("level"), field.alias("field"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_name")).alias("value"))
    return usage.merged_rows(rows)


@query("SELECT p_partkey, list_sort(list_distinct(list_filter([p_brand, p_type, 'x', 'y'], lambda t: t <> 'y' AND t <> p_type))) AS enabled FROM part", views=False)
def tool_enablement(spark, d):
    on = usage.enabled_column(F.array("p_brand", "p_type"), F.array(F.lit("x"), F.lit("y")), F.array(F.lit("y"), F.col("p_type")))
    return table(spark, d, "part").select("p_partkey", F.array_sort(on).alias("enabled"))


@query("SELECT p_partkey, p_brand AS a, CASE WHEN p_size > 25 THEN 'p' ELSE p_type END AS b FROM part", views=False)
def map_override(spark, d):
    general = F.create_map(F.lit("a"), F.col("p_brand"), F.lit("b"), F.col("p_type"))
    project = F.when(F.col("p_size") > 25, F.create_map(F.lit("b"), F.lit("p"))).otherwise(F.create_map().cast("map<string,string>"))
    m = values.merged_map(general, project)
    return table(spark, d, "part").select("p_partkey", m["a"].alias("a"), m["b"].alias("b"))


@query("SELECT l_orderkey, list_sort(list(DISTINCT l_linenumber)) AS lines FROM lineitem GROUP BY l_orderkey", views=False)
def range_merge(spark, d):
    return values.merged_lists(table(spark, d, "lineitem").select("l_orderkey", F.array("l_linenumber").alias("lines")), "l_orderkey", "lines")


@query("SELECT event_id, greatest(CAST(floor(value) AS INT) - 1, 0) AS wire, (2 < l OR (2 = l AND 3 <= c)) AND (l < 5 OR (l = 5 AND c <= 6)) AS inside, CASE WHEN (2 < l OR (2 = l AND 3 <= c)) AND (l < 5 OR (l = 5 AND c <= 6)) THEN 0 WHEN l < 2 OR (l = 2 AND c < 3) THEN abs(2 - l) * 1000000 + abs(3 - c) ELSE abs(l - 5) * 1000000 + abs(c - 6) END AS away FROM (SELECT *, CAST(user_id % 9 AS INT) AS l, CAST(event_id % 9 AS INT) AS c FROM events)", views=False)
def range_predicates(spark, d):
    r, at = [F.lit(x) for x in (2, 3, 5, 6)], (F.col("l"), F.col("c"))
    e = table(spark, d, "events").withColumn("l", (F.col("user_id") % 9).cast("int")).withColumn("c", (F.col("event_id") % 9).cast("int"))
    wire = ranges.to_wire(F.floor("value").cast("int"))
    return e.select("event_id", wire.alias("wire"), ranges.contains(*r, *at).alias("inside"), ranges.distance(*r, *at).alias("away"))


@query("SELECT c_custkey, s_suppkey IS NOT NULL AS cached FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey", views=False)
def cached_or_pending(spark, d):
    key = lambda c: F.col(c).cast("string").alias("segment_hash")
    c, s = table(spark, d, "customer").select("c_custkey", key("c_custkey")), table(spark, d, "supplier").select(key("s_suppkey"))
    have, pending = semantic.cached_and_pending(c, s)
    return have.select("c_custkey", F.lit(True).alias("cached")).unionByName(pending.select("c_custkey", F.lit(False).alias("cached")))


@query("SELECT n_name AS key, CASE n_name WHEN 'PERU' THEN 'set' ELSE CAST(n_nationkey AS VARCHAR) END AS value FROM nation WHERE n_name <> 'CHINA' UNION ALL SELECT 'none yet', 'new' UNION ALL SELECT 'PERU', 'set' WHERE 'PERU' NOT IN (SELECT n_name FROM nation)", views=False)
def state_upsert(spark, d):
    s = table(spark, d, "nation").select(F.col("n_name").alias("key"), F.col("n_nationkey").cast("string").alias("value"))
    return index.put_state(index.put_state(index.put_state(s, "PERU", "set"), "CHINA", None), "none yet", "new")


@query("WITH v AS (SELECT vec_id AS id, label AS seg, row_number() OVER (ORDER BY vec_id) AS rank FROM embeddings) SELECT id, seg FROM v QUALIFY row_number() OVER (PARTITION BY seg ORDER BY rank) = 1", views=False)
def first_per_segment(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("segment_hash"), F.col("vec_id").alias("rank"), F.lit(0).alias("qid"))
    return search.first_per_segment(v).select("id", F.col("segment_hash").alias("seg"))


@query("SELECT doc_id, round(0.85 * s + 0.15 * l, 6) AS score FROM (SELECT doc_id, doc_id % 100 / 100.0 AS s, CAST(contains(translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'tion') AS INT) AS l FROM files)")
def hybrid_scores(spark, d):
    lex = text.lexical_score(text.query_terms(F.lit("tion")), F.col("content"), F.lit(None).cast("string"))
    return files(spark, d).select("doc_id", F.round(text.hybrid_score((F.col("doc_id") % 100) / 100.0, lex), 6).alias("score"))


NOISE = """WITH r AS (SELECT l_orderkey, l_partkey, l_linenumber, ['typescript', 'python', 'rust', 'go', 'ruby', 'javascript', 'other'][CAST(l_suppkey % 7 AS INT) + 1] AS language,
    ['function_declaration', 'import_statement', 'assignment_expression', 'pair', 'call_expression', 'assignment', 'let_declaration'][CAST(l_partkey % 7 AS INT) + 1] AS parent, CASE WHEN l_quantity > 30 THEN 'left' WHEN l_quantity > 15 THEN 'key' ELSE 'right' END AS field, CASE WHEN l_tax > 0.07 THEN 'Div' ELSE 'x' END AS name FROM lineitem),
f AS (SELECT *, (language IN ('typescript', 'javascript', 'go') AND parent = 'function_declaration') OR (language = 'rust' AND parent = 'let_declaration') OR (language = 'ruby' AND parent = 'assignment') OR (language = 'python' AND parent = 'import_statement') AS in_definition,
    language IN ('typescript', 'javascript', 'python') AND parent = 'import_statement' AS in_import, field = 'left' AND ((language IN ('typescript', 'javascript', 'rust') AND parent = 'assignment_expression') OR (language IN ('python', 'ruby') AND parent = 'assignment')) AS assignment_lhs,
    field = 'key' AND language IN ('typescript', 'javascript', 'python') AND parent = 'pair' AS property_key, name = 'Div' AS html_tag FROM r)"""


def _captures(spark, d):
    pick = lambda xs, k: F.element_at(F.array(*map(F.lit, xs)), (F.col(k) % len(xs) + 1).cast("int"))
    language = pick(("typescript", "python", "rust", "go", "ruby", "javascript", "other"), "l_suppkey")
    parent = pick(("function_declaration", "import_statement", "assignment_expression", "pair", "call_expression", "assignment", "let_declaration"), "l_partkey")
    field = F.when(F.col("l_quantity") > 30, "left").when(F.col("l_quantity") > 15, "key").otherwise("right")
    name = F.when(F.col("l_tax") > 0.07, "Div").otherwise("x")
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", language.alias("language"), F.array(parent, F.lit("program")).alias("ancestors"), field.alias("field"), name.alias("name"))


@query(NOISE + " SELECT language, in_definition, in_import, assignment_lhs, property_key, html_tag, count(*) AS n FROM f GROUP BY ALL", views=False)
def reference_flags(spark, d):
    flags = ["in_definition", "in_import", "assignment_lhs", "property_key", "html_tag"]
    return references.noise_flags(_captures(spark, d)).groupBy("language", *flags).agg(F.count("*").alias("n"))


@query(NOISE + " SELECT l_orderkey, l_partkey, l_linenumber FROM f WHERE NOT (in_definition OR in_import OR assignment_lhs OR property_key OR html_tag)", views=False)
def reference_noise(spark, d):
    return references.noise_filtered(references.noise_flags(_captures(spark, d))).select("l_orderkey", "l_partkey", "l_linenumber")


@query("SELECT rule, count(*) AS n FROM (SELECT ['function-call', 'function-call-x', 'decorator', 'component-render', 'all-references'][CAST(l_linenumber % 5 AS INT) + 1] AS rule FROM lineitem) WHERE rule NOT IN ('component-render', 'all-references') GROUP BY rule", views=False)
def rule_allow_list(spark, d):
    rule = F.element_at(F.array(*map(F.lit, ("function-call", "function-call-x", "decorator", "component-render", "all-references"))), (F.col("l_linenumber") % 5 + 1).cast("int"))
    return references.allowed_rules(table(spark, d, "lineitem").select(rule.alias("rule_id"))).groupBy(F.col("rule_id").alias("rule")).agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT o_orderkey, [{'line': CAST(o_orderkey % 3 AS INT), 'char': 1}, {'line': CAST(o_orderkey % 3 + 1 AS INT), 'char': 4}, {'line': 1, 'char': 1}, {'line': 2, 'char': 4}] AS l FROM orders)
SELECT o_orderkey, list_transform(list_filter([1, 2, 3, 4], lambda i: list_position(l, l[i]) = i), lambda i: l[i]) AS places FROM c""", views=False)
def selection_chain(spark, d):
    at = (F.col("o_orderkey") % 3).cast("int")
    one = lambda a, b: F.struct(a.alias("sl"), F.lit(1).alias("sc"), b.alias("el"), F.lit(5).alias("ec"))
    chain = F.array(one(at, at + 1), one(F.lit(1), F.lit(2)))
    return table(spark, d, "orders").select("o_orderkey", ranges.selection_positions(chain).alias("places"))


@query("SELECT user_id, event_id, CAST(min(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS BIGINT) AS low, count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS n FROM events", views=False)
def sliding_context(spark, d):
    from ..operators import paging

    e = table(spark, d, "events").select("user_id", F.col("event_id").alias("line_no"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("line"))
    parts = F.split("context", "\n")
    out = paging.context_windows(e, 3, 3, ("user_id",))
    return out.select("user_id", F.col("line_no").alias("event_id"), F.array_min(parts).cast("long").alias("low"), F.size(parts).cast("long").alias("n"))


@query("SELECT n_nationkey, n_name, CAST(row_number() OVER (ORDER BY n_name DESC, n_nationkey) AS INT) AS rank FROM nation", views=False)
def result_ranks(spark, d):
    from ..operators import paging

    out = paging.ranked(table(spark, d, "nation"), [F.desc("n_name"), "n_nationkey"])
    return out.select("n_nationkey", "n_name", F.col("rank").cast("int").alias("rank"))


@query("SELECT event_type AS tool, round(100.0 * count(*) FILTER (value > 20) / count(*), 6) AS percent FROM events GROUP BY 1", views=False)
def progress_percent(spark, d):
    g = table(spark, d, "events").groupBy(F.col("event_type").alias("tool")).agg(F.count_if(F.col("value") > 20).alias("a"), F.count("*").alias("b"))
    return g.select("tool", F.round(values.progress_percent(F.col("a"), F.col("b")), 6).alias("percent"))


@query("SELECT n_name AS name, 'a' AS source FROM nation UNION ALL SELECT r_name, 'b' FROM region", views=False)
def union_of_sources(spark, d):
    """Of three sources one is missing and left out."""
    read = lambda t, c: lambda: table(spark, d, t).select(F.col(c).alias("name"))
    rows, failed = file_source.union_of_sources({"a": read("nation", "n_name"), "missing": read("no_such_table", "x"), "b": read("region", "r_name")}, ["name"])
    assert set(failed) == {"missing"}
    return rows
