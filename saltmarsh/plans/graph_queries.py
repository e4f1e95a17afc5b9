"""Queries over the code graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values
from ..operators import graph, graph_upkeep, paging
from ..sources.dealt import dealt
from ..sources.tables import edge_ends, edge_id, edges, files, nodes, table
from ..sources.work import drop, materialize, scratch
from .registry import query


def part_facts(spark, d, *columns):
    """(symbols, calls): parts are functions of their brand's file; a line item calls from its part to that of its supplier's number, where both are of one file.

    Line items and parts meet in tasks of bounded rows by narrow rows; the parts of a task are hashed there, never sent to all.
    """
    p, li = table(spark, d, "part"), table(spark, d, "lineitem").select("l_partkey", "l_suppkey", *columns)
    name = lambda n, k: F.concat_ws("_", n, F.col(k).cast("string"))
    s = p.select(F.col("p_brand").alias("path"), name("p_name", "p_partkey").alias("name"), F.lit("function").alias("kind"), F.col("p_size").alias("sl"), F.col("p_partkey").cast("int").alias("sc"))
    rows = li.count()
    end = lambda key, path, n: dealt(p.select(F.col("p_partkey").alias(key), F.col("p_brand").alias(path), F.col("p_name").alias(n)), rows, key).hint("shuffle_hash")
    c = dealt(li, rows, "l_partkey").join(end("l_partkey", "path", "from"), "l_partkey")
    c = dealt(c, rows, "l_suppkey").join(end("l_suppkey", "to_path", "to"), "l_suppkey").where("path = to_path")
    return s, c.select("path", name("from", "l_partkey").alias("caller"), "to_path", name("to", "l_suppkey").alias("name"), *columns)


def stored_edges(spark, d):
    """The edges as a table: searches read them once a level, the view would be derived each time."""
    return materialize(edges(spark, d), "edges")


@query("SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM part) AS symbols, (SELECT count(*) FROM edges) AS edges")
def graph_stats(spark, d):
    return graph.stats(files(spark, d), table(spark, d, "part"), edges(spark, d))


@query("SELECT kind, count(*) AS n FROM edges GROUP BY kind")
def edge_counts(spark, d):
    return graph.edge_counts(edges(spark, d))


@query("""
WITH f AS (SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) || '/' AS module, count(*) AS files FROM files WHERE starts_with(path, 'src') AND NOT is_external GROUP BY 1),
s AS (SELECT 'src' || p_size || '/en/' AS module, count(*) AS symbols FROM part GROUP BY 1) SELECT module, files, coalesce(symbols, 0) AS symbols FROM f LEFT JOIN s USING (module)
""")
def overview_modules(spark, d):
    s = table(spark, d, "part").select(F.concat(F.lit("src"), F.col("p_size").cast("string"), F.lit("/en/x.rs")).alias("path"))
    return graph.modules(files(spark, d), s, "src")


@query("SELECT 'p' || p_partkey AS id, p_name AS name, coalesce(n, 0) AS calls FROM part LEFT JOIN (SELECT to_id, count(*) AS n FROM edges WHERE kind = 'calls' GROUP BY 1) e ON e.to_id = 'p' || p_partkey ORDER BY calls DESC, id LIMIT 25")
def top_symbols(spark, d):
    s = table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"))
    return graph.top_symbols(s, edges(spark, d), 25)


BFS = """
l1 AS (SELECT DISTINCT to_id AS id FROM edges WHERE from_id = 'n3'), l2 AS (SELECT DISTINCT to_id AS id FROM edges JOIN l1 ON from_id = l1.id), reach AS (SELECT id, min(depth) AS depth FROM (SELECT 'n3' AS id, 0 AS depth UNION ALL SELECT id, 1 FROM l1 UNION ALL SELECT id, 2 FROM l2) GROUP BY id)
"""


@query(f"WITH {BFS} SELECT id, CAST(depth AS INT) AS depth FROM reach")
def bfs_depth(spark, d):
    return graph.bfs(stored_edges(spark, d), _start(spark, "n3"), "outgoing", 2)


def _start(spark, id_):
    return spark.range(1).select(F.lit(id_).alias("id"))


@query("""
WITH w AS (SELECT 'n3' AS id, 0 AS depth UNION SELECT edges.to_id, depth + 1 FROM w JOIN edges ON from_id = w.id WHERE depth < 3) SELECT w.id, CAST(min(depth) AS INT) AS depth FROM w GROUP BY w.id
""")
def bfs_recursive_twin(spark, d):
    return graph.bfs(stored_edges(spark, d), _start(spark, "n3"), "outgoing", 3)


@query("""
WITH i1 AS (SELECT DISTINCT from_id AS id FROM edges WHERE to_id = 'p7'), n AS (SELECT 'p7' AS id UNION SELECT id FROM i1 UNION SELECT from_id FROM edges JOIN i1 ON to_id = i1.id)
SELECT id, kind, from_id, to_id FROM edges WHERE to_id IN (SELECT id FROM n)
""")
def impact(spark, d):
    return graph.impact(stored_edges(spark, d), _start(spark, "p7"), 2)[1].select("id", "kind", "from_id", "to_id")


@query("""
WITH i1 AS (SELECT DISTINCT from_id AS id FROM edges WHERE to_id = 'p7' AND kind = 'calls'), n AS (SELECT 'p7' AS id UNION SELECT id FROM i1) SELECT id, kind, from_id, to_id FROM edges WHERE kind = 'calls' AND to_id IN (SELECT id FROM n)
""")
def impact_of_kind(spark, d):
    return graph.impact(stored_edges(spark, d), _start(spark, "p7"), 2, "calls")[1].select("id", "kind", "from_id", "to_id")


@query("""
WITH c1 AS (SELECT to_id AS id FROM edges WHERE from_id = 'o5' UNION SELECT from_id FROM edges WHERE to_id = 'o5'), n AS (SELECT 'o5' AS id UNION SELECT id FROM c1)
SELECT id, kind, from_id, to_id FROM edges WHERE to_id IN (SELECT id FROM n) OR from_id IN (SELECT id FROM n)
""")
def context(spark, d):
    return graph.context(stored_edges(spark, d), _start(spark, "o5"), 1)[1].select("id", "kind", "from_id", "to_id")


@query(f"WITH {BFS} SELECT id, CAST(depth AS INT) AS depth FROM reach ORDER BY depth, id LIMIT 50")
def graph_limit(spark, d):
    e = stored_edges(spark, d)
    return graph.limited(graph.bfs(e, _start(spark, "n3"), "outgoing", 2), e)[0]


@query("SELECT id FROM edges ORDER BY id LIMIT 100")
def graph_limit_edges(spark, d):
    return graph.limited(_start(spark, "n3").withColumn("depth", F.lit(0)), edges(spark, d))[1].select("id")


@query("SELECT id, node_type, name, 1 AS tier FROM nodes WHERE node_type = 'symbol' AND starts_with(lower(name), 'order_12')")
def target_resolve(spark, d):
    return graph.resolve(nodes(spark, d), "Order_12")


@query("SELECT id, node_type, name, 2 AS tier FROM nodes WHERE node_type = 'symbol' AND name ILIKE '%idget%'")
def target_resolve_substring(spark, d):
    return graph.resolve(nodes(spark, d), "idget")


@query("""
WITH k AS (SELECT o_orderkey, list({'line': l_linenumber, 'character': CAST(l_quantity AS INT)} ORDER BY l_linenumber, CAST(l_quantity AS INT)) AS sites FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT id, coalesce(sites, []) AS sites FROM edges LEFT JOIN k ON to_id = 'o' || o_orderkey WHERE kind = 'imports'
""")
def edges_with_sites(spark, d):
    s = table(spark, d, "lineitem").select((F.concat(F.lit("imports>"), F.lit("c"))).alias("p"), F.col("l_orderkey"), F.col("l_linenumber").alias("line"), F.col("l_quantity").cast("int").alias("character"))
    e = edges(spark, d).where("kind = 'imports'")
    s = s.join(e.select(F.col("id").alias("edge_id"), F.substring("to_id", 2, 20).cast("long").alias("l_orderkey")), "l_orderkey")
    return graph.with_sites(e, s).select("id", "sites")


@query("SELECT e.id, e.kind, from_id, to_id, coalesce(a.name, 'unknown') AS from_name, coalesce(b.name, 'unknown') AS to_name FROM edges e LEFT JOIN nodes a ON a.id = from_id AND a.node_type <> 'module' LEFT JOIN nodes b ON b.id = to_id AND b.node_type <> 'module'")
def edges_with_names(spark, d):
    e = graph.with_names(edge_ends(spark, d), nodes(spark, d).where("node_type <> 'module'"))
    return e.select(edge_id().alias("id"), *e.columns)


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY id) AS r FROM edges WHERE kind <> 'calls'), g AS (SELECT DISTINCT from_id FROM r ORDER BY from_id LIMIT 10) SELECT id, from_id FROM r WHERE r <= 3 AND from_id IN (SELECT from_id FROM g)
""")
def edges_shown(spark, d):
    return graph.shown(edges(spark, d).where("kind <> 'calls'")).select("id", "from_id")


@query("SELECT id FROM edges WHERE kind = 'imports' AND from_id = 'c5' UNION ALL SELECT id FROM edges WHERE to_id = 'c5'")
def adjacency(spark, d):
    e = edges(spark, d)
    return graph.adjacency(e, "c5", "outgoing", "imports").select("id").unionByName(graph.adjacency(e, "c5", "incoming").select("id"))


@query("SELECT id FROM edges")
def edge_kind_unknown_means_all(spark, d):
    return graph.of_kinds(edges(spark, d), "nonsense").select("id")


@query("SELECT kind, count(*) AS n FROM edges WHERE from_id <> 'c5' AND to_id <> 'c5' AND from_id <> 'o1' AND to_id <> 'o1' GROUP BY kind")
def remove_file(spark, d):
    f = spark.range(1).select(F.lit("c5").alias("id"), F.lit("a.rs").alias("path"))
    s = spark.range(1).select(F.lit("o1").alias("id"), F.lit("a.rs").alias("path"))
    return graph.edge_counts(graph.remove_file(f, s, edges(spark, d), "a.rs")[2])


@query("""
WITH s AS (SELECT p_brand AS path, p_name AS name, p_partkey AS k, p_size AS sl FROM part) SELECT 'defines' AS kind, count(*) AS n FROM s UNION ALL
SELECT 'calls', count(*) FROM (SELECT DISTINCT a.k, b.k FROM lineitem JOIN s a ON a.k = l_partkey JOIN s b ON b.k = l_suppkey AND b.path = a.path)
""")
def graph_build(spark, d):
    s, c = part_facts(spark, d)
    return graph.edge_counts(graph.build(s.select("path").distinct(), s, c))


@query("""
WITH s AS (SELECT p_brand AS path, p_partkey AS k FROM part WHERE NOT (p_brand LIKE '%1' AND p_size % 2 = 1)) SELECT 'defines' AS kind, count(*) AS n FROM s UNION ALL
SELECT 'calls', count(*) FROM (SELECT DISTINCT a.k, b.k FROM lineitem JOIN s a ON a.k = l_partkey JOIN s b ON b.k = l_suppkey AND b.path = a.path)
""", views=False)
def graph_updates(spark, d):
    """The graph of before with every second symbol of some files gone, kept by the changes of these files."""
    s, c = part_facts(spark, d, "l_linenumber")
    c = materialize(c.withColumnRenamed("l_linenumber", "line").withColumn("character", F.lit(1)), "calls")
    root, files = scratch(spark, "graph"), s.select("path").distinct()
    graph_upkeep.create(files, s, c, root, buckets=8)
    some = F.col("path").like("%1")
    graph_upkeep.update(files.where(some), files, s.where(some & (F.col("sl") % 2 == 0)), c, root, "halved")
    drop(c)
    return graph.edge_counts(graph_upkeep.edges(spark, root))


@query("SELECT a.p_name || '_' || a.p_partkey AS caller, count(*) AS n, min(line) AS line FROM (SELECT DISTINCT l_partkey, l_suppkey, l_linenumber AS line FROM lineitem) JOIN part a ON a.p_partkey = l_partkey JOIN part b ON b.p_partkey = l_suppkey AND b.p_brand = a.p_brand GROUP BY 1")
def graph_build_sites(spark, d):
    s, c = part_facts(spark, d, "l_linenumber")
    c = materialize(c.withColumnRenamed("l_linenumber", "line").withColumn("character", F.lit(1)), "calls")
    e = graph.build(s.select("path").distinct(), s, c).where("kind = 'calls'")
    named = s.select(F.col("name").alias("caller"), values.graph_id("s", F.col("path"), F.col("name"), F.col("sl"), F.col("sc")).alias("from_id")).hint("merge")
    sites = graph.build_sites(s, c).join(e.select(F.col("id").alias("edge_id"), "from_id"), "edge_id").join(named, "from_id")
    return sites.groupBy("caller").agg(F.count("*").alias("n"), F.min("line").alias("line"))


@query("SELECT n_regionkey AS grp, n_nationkey AS id, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name, n_nationkey) AS INT) AS place FROM nation QUALIFY place <= 3", views=False)
def display_caps(spark, d):
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("grp"), F.col("n_nationkey").alias("id"), "n_name")
    top = paging.first_per_group(n, ["grp"], ["n_name", "id"], 3)
    from pyspark.sql import Window

    return top.withColumn("place", F.row_number().over(Window.partitionBy("grp").orderBy("n_name", "id")).cast("int")).select("grp", "id", "place")
