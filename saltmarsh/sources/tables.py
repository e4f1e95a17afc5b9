"""Tables of a folder of Parquet files, and the standing views over them: files, lines, edges, calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, doc_id, language, source, content, is_external): a file for each document."""
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select(path.alias("path"), "doc_id", F.col("lang").alias("language"), "source", F.col("text").alias("content"), (F.col("source") == "src0").alias("is_external"))


def lines(files_: DataFrame) -> DataFrame:
    """(path, doc_id, line_no, line): lines from 1, cut at line feeds."""
    rows = files_.select("path", "doc_id", F.posexplode(F.split("content", "\n")).alias("p", "line"))
    return rows.select("path", "doc_id", (F.col("p") + 1).alias("line_no"), "line")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, node_type, name): nations are modules, customers files, orders and parts symbols."""
    n = lambda t, p, k, kind, name: table(spark, sf_dir, t).select(F.concat(F.lit(p), F.col(k).cast("string")).alias("id"), F.lit(kind).alias("node_type"), name.alias("name"))
    out = n("nation", "n", "n_nationkey", "module", F.col("n_name"))
    out = out.unionByName(n("customer", "c", "c_custkey", "file", F.col("c_name")))
    out = out.unionByName(n("orders", "o", "o_orderkey", "symbol", F.concat(F.lit("order_"), F.col("o_orderkey").cast("string"))))
    return out.unionByName(n("part", "p", "p_partkey", "symbol", F.col("p_name")))


def edge_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, from_id, to_id): nations define customers, customers import orders, orders call parts."""
    c, o, li = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    key = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    d = c.select(F.lit("defines").alias("kind"), key("n", "c_nationkey").alias("from_id"), key("c", "c_custkey").alias("to_id"))
    i = o.select(F.lit("imports").alias("kind"), key("c", "o_custkey").alias("from_id"), key("o", "o_orderkey").alias("to_id"))
    # distinct as numbers, which are less than half of what the ids are
    k = li.select("l_orderkey", "l_partkey").distinct().select(F.lit("calls").alias("kind"), key("o", "l_orderkey").alias("from_id"), key("p", "l_partkey").alias("to_id"))
    return d.unionByName(i).unionByName(k)


def edge_id() -> Column:
    return F.concat_ws(">", "kind", "from_id", "to_id")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, kind, from_id, to_id) of edge_ends."""
    return edge_ends(spark, sf_dir).select(edge_id().alias("id"), "kind", "from_id", "to_id")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, kind, path, line, detail, sl, sc, ord): a call site for each line item."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.concat(F.lit("part_"), F.col("l_partkey").cast("string")).alias("name"), F.when(F.col("l_returnflag") == "A", "property").otherwise("function").alias("kind"), F.concat(F.lit("supp_"), F.col("l_suppkey").cast("string")).alias("path"), F.col("l_orderkey").alias("line"), F.when(F.col("l_linestatus") == "F", F.col("l_linestatus")).alias("detail"), F.col("l_linenumber").alias("sl"), F.col("l_quantity").cast("int").alias("sc"))


#: The same views for another engine.
SQL_VIEWS = r"""
files AS (SELECT source || '/' || lang || '/doc_' || doc_id || '.txt' AS path, doc_id, lang AS language, source, text AS content, source = 'src0' AS is_external FROM documents),
lines AS (SELECT path, doc_id, generate_subscripts(l, 1) AS line_no, unnest(l) AS line FROM (SELECT path, doc_id, string_split(content, chr(10)) AS l FROM files)),
nodes AS (SELECT 'n' || n_nationkey AS id, 'module' AS node_type, n_name AS name FROM nation UNION ALL SELECT 'c' || c_custkey, 'file', c_name FROM customer
    UNION ALL SELECT 'o' || o_orderkey, 'symbol', 'order_' || o_orderkey FROM orders UNION ALL SELECT 'p' || p_partkey, 'symbol', p_name FROM part),
edges AS (SELECT concat_ws('>', kind, from_id, to_id) AS id, kind, from_id, to_id FROM (
    SELECT 'defines' AS kind, 'n' || c_nationkey AS from_id, 'c' || c_custkey AS to_id FROM customer UNION ALL SELECT 'imports', 'c' || o_custkey, 'o' || o_orderkey FROM orders
    UNION ALL SELECT DISTINCT 'calls', 'o' || l_orderkey, 'p' || l_partkey FROM lineitem)),
calls AS (SELECT 'part_' || l_partkey AS name, CASE WHEN l_returnflag = 'A' THEN 'property' ELSE 'function' END AS kind, 'supp_' || l_suppkey AS path, l_orderkey AS line,
    CASE WHEN l_linestatus = 'F' THEN 'F' END AS detail, l_linenumber AS sl, CAST(l_quantity AS INT) AS sc FROM lineitem)
"""
