"""Queries over indexes: statistics, changes, upserts, deletes, streams in batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values
from ..operators import index, stores, texts
from ..sources import versions
from ..sources.tables import files, table
from ..sources.work import scratch
from ..streaming import events as streams
from .registry import query


@query("SELECT count(*) AS chunks, count(DISTINCT path) AS files, max(doc_id) AS last_indexed FROM (SELECT path, doc_id, unnest(range(0, greatest(1, (len(string_split(regexp_replace(content, chr(10) || '$', ''), chr(10))) + 9) // 10))) AS k, content FROM files) WHERE strlen(array_to_string(string_split(regexp_replace(content, chr(10) || '$', ''), chr(10))[k * 10 + 1:k * 10 + 10], chr(10))) >= 50")
def index_stats(spark, d):
    f = files(spark, d)
    return index.stats(texts.tumbling_chunks(f, 10).join(f.select("path", F.col("doc_id").alias("indexed_at")), "path"))


@query("""
WITH old AS (SELECT path, CASE WHEN doc_id % 3 = 0 THEN 'x' ELSE sha256(content)[1:32] END AS h FROM files WHERE doc_id % 5 <> 0 UNION ALL SELECT 'gone/' || n_name, 'x' FROM nation), now AS (SELECT path, sha256(content)[1:32] AS h FROM files)
SELECT coalesce(now.path, old.path) AS path, CASE WHEN now.path IS NULL THEN 'deleted' WHEN old.path IS NULL THEN 'new' WHEN now.h = old.h THEN 'unchanged' ELSE 'changed' END AS change FROM now FULL JOIN old ON now.path = old.path
""")
def changed_files(spark, d):
    f = files(spark, d)
    now = f.select("path", "doc_id", values.content_hash(F.col("content")).alias("content_hash"))
    old = now.where("doc_id % 5 <> 0").select("path", F.when(F.col("doc_id") % 3 == 0, "x").otherwise(F.col("content_hash")).alias("content_hash"))
    gone = table(spark, d, "nation").select(F.concat(F.lit("gone/"), "n_name").alias("path"), F.lit("x").alias("content_hash"))
    return index.changed(now.select("path", "content_hash"), old.unionByName(gone))


@query("""
WITH new AS (SELECT l_orderkey AS k, l_linenumber AS line, l_partkey AS v FROM lineitem WHERE l_returnflag = 'A'), f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY line DESC, v) AS r FROM new),
old AS (SELECT o_orderkey AS k, 0 AS line, o_custkey AS v FROM orders) SELECT k, line, v FROM f WHERE r = 1 UNION ALL SELECT k, line, v FROM old WHERE k NOT IN (SELECT k FROM new)
""", views=False)
def upsert_latest(spark, d):
    new = table(spark, d, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("v"))
    old = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.lit(0).alias("line"), F.col("o_custkey").alias("v"))
    return index.upsert(old, new, ["k"], "line")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT o_orderkey, 1, o_custkey FROM orders WHERE o_orderstatus = 'P'", views=False)
def replace_children(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    new = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.col("o_custkey").alias("l_partkey"))
    return index.replace_children(li, new, "l_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'O') UNION ALL SELECT o_orderkey, 1, o_custkey FROM orders WHERE o_orderstatus = 'P'", views=False)
def replace_children_cleared(spark, d):
    """Parents of status F are touched too; they have no new children and lose theirs."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.col("o_custkey").alias("l_partkey"), "o_orderstatus")
    return index.replace_children(li, o.where("o_orderstatus = 'P'").drop("o_orderstatus"), "l_orderkey", o.where("o_orderstatus <> 'O'").select("l_orderkey"))


def _kept_lines(spark, d) -> str:
    """A versioned table of lines by order: all of them, then a merge that renews the lines of some orders and clears others'."""
    path = scratch(spark, "lines")
    versions.replace(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), path, ["l_orderkey"])
    o = table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(0).alias("l_linenumber"), F.col("o_totalprice").alias("l_quantity"), "o_orderstatus")
    versions.merge(path, o.where("o_orderstatus <> 'F'").drop("o_orderstatus"), ["l_orderkey"], o.select("l_orderkey"))
    return path


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 300000) UNION ALL SELECT o_orderkey, 0, o_totalprice FROM orders WHERE o_totalprice > 300000 AND o_orderstatus <> 'F'", views=False)
def merged_version(spark, d):
    return versions.read(spark, _kept_lines(spark, d))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem", views=False)
def earlier_version(spark, d):
    """What a reader that resolved the version before still reads."""
    return versions.read(spark, _kept_lines(spark, d), 0)


@query("SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN label + 100 ELSE label END AS label, list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)) > 0.5 AS unit FROM embeddings WHERE vec_id % 10 <> 5", views=False)
def vector_upsert(spark, d):
    """Vectors of the right dimension merged into a versioned table: some renewed, some taken out."""
    path = scratch(spark, "vectors")
    e = table(spark, d, "embeddings").withColumn("embedding", values.with_dimension(F.col("embedding"), 64))
    versions.replace(e, path, ["vec_id"])
    versions.merge(path, e.where("vec_id % 10 = 0").withColumn("label", F.col("label") + 100), ["vec_id"], e.where("vec_id % 5 = 0").select("vec_id"))
    return versions.read(spark, path).select("vec_id", "label", (values.dot(F.col("embedding"), F.col("embedding")) > 0.5).alias("unit"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)", views=False)
def delete_file(spark, d):
    gone = table(spark, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return index.delete(table(spark, d, "orders").select("o_orderkey", "o_custkey"), gone, ["o_custkey"])


@query("SELECT 'orders' AS t, count(*) AS n FROM orders WHERE o_totalprice <= 400000 UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 400000)", views=False)
def delete_cascade(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_orderkey", "k")
    li = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "k")
    parent, child = index.delete_cascade(o, [li], F.col("o_totalprice") > 400000, "k")
    n = lambda df, t: df.agg(F.lit(t).alias("t"), F.count("*").alias("n"))
    return n(parent, "orders").unionByName(n(child, "lineitem"))


@query("SELECT path FROM files WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def repair_missing(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("segment_hash"))
    return index.missing_vectors(files(spark, d).select("path", F.col("doc_id").cast("string").alias("segment_hash")), v)


@query("WITH q AS (SELECT l_linenumber * 100 + CAST(l_quantity AS INT) AS pos, l_partkey AS k FROM lineitem WHERE l_quantity > 45) SELECT pos, k, CASE WHEN p_size > 10 THEN p_name END AS name FROM q LEFT JOIN part ON p_partkey = k", views=False)
def fetch_in_order(spark, d):
    q = table(spark, d, "lineitem").where("l_quantity > 45").select((F.col("l_linenumber") * 100 + F.col("l_quantity").cast("int")).alias("pos"), F.col("l_partkey").alias("k"))
    e = table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"))
    return index.fetch_in_order(q, e, "k").select("pos", "k", "name")


@query("SELECT n_name, (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY n_name) AS id FROM nation", views=False)
def allocate_ids(spark, d):
    return index.next_ids(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")), table(spark, d, "nation"), "n_name")


@query("SELECT DISTINCT c_mktsegment AS path FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey >= 1000 ORDER BY 1", views=False)
def join_distinct_paths(spark, d):
    e = table(spark, d, "customer").select(F.col("c_custkey").alias("segment_hash"), F.col("c_mktsegment").alias("path"))
    ids = table(spark, d, "orders").select(F.col("o_custkey").alias("segment_hash"), F.col("o_orderkey").alias("id"))
    return stores.paths_from_id(e, ids, 1000)


@query("""
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM e)
SELECT 'f' || user_id AS path, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, CAST(floor(epoch(max(ts) + INTERVAL 1 HOUR)) AS BIGINT) AS "end", count(*) AS n FROM s GROUP BY user_id, g
""", views=False)
def debounce_sessions(spark, d):
    e = table(spark, d, "events").select(F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("path"), F.col("ts").cast("timestamp").alias("ts"))
    return streams.debounced(e, "1 hour").select("path", F.unix_timestamp("start").alias("start"), F.unix_timestamp("end").alias("end"), "n")


@query("SELECT DISTINCT CAST(epoch(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01')) AS BIGINT) AS tick, 'f' || user_id AS path FROM events", views=False)
def microbatch_dedup(spark, d):
    e = table(spark, d, "events").select(F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("path"), F.col("ts").cast("timestamp").alias("ts"))
    return streams.microbatches(e, "6 hours").select(F.unix_timestamp("tick").alias("tick"), "path")


@query("SELECT 'f' || user_id AS path, CASE WHEN arg_max(event_type, ts) = 'error' THEN 'delete' ELSE 'upsert' END AS action FROM events GROUP BY user_id", views=False)
def route_changes(spark, d):
    e = table(spark, d, "events").select(F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("path"), "ts", F.when(F.col("event_type") == "error", "delete").otherwise("modify").alias("op"))
    return streams.routed(e)


@query("WITH l AS (SELECT user_id, arg_max(event_type, ts) AS t FROM events GROUP BY 1) SELECT 'f' || user_id AS uri, [t] AS items FROM l WHERE t <> 'view'", views=False)
def latest_state(spark, d):
    items = F.when(F.col("event_type") == "view", F.array().cast("array<string>")).otherwise(F.array("event_type"))
    e = table(spark, d, "events").select(F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("uri"), "ts", items.alias("items"))
    return streams.latest_state(e).select("uri", "items")


@query("WITH t AS (SELECT event_type, user_id, count(*) FILTER (value > 20) > count(*) FILTER (NOT value > 20) AS o FROM events GROUP BY ALL) SELECT event_type AS client, count(*) FILTER (o) AS open, count(*) FILTER (o) > 0 AS loading FROM t GROUP BY 1", views=False)
def progress_tokens(spark, d):
    e = table(spark, d, "events").where("value IS NOT NULL").select(F.col("event_type").alias("client"), F.col("user_id").alias("token"), F.when(F.col("value") > 20, "begin").otherwise("end").alias("kind"))
    return streams.open_tokens(e)


@query("SELECT 'f' || user_id AS path FROM events GROUP BY user_id HAVING count(*) % 2 = 1", views=False)
def cache_toggle(spark, d):
    return streams.toggled(table(spark, d, "events").select(F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("path")))
