"""Vector and hybrid search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import neighbours, search
from ..sources.tables import files, table
from .registry import query


def vectors(spark, d):
    """(id, embedding, kind)."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding"), F.when(F.col("label") != 5, F.col("label")).alias("kind"))


def facts(spark, d):
    """(id, path, code, symbol) of documents."""
    return files(spark, d).select(F.col("doc_id").alias("id"), "path", F.col("content").alias("code"), F.col("language").alias("symbol"))


def best(spark, d, k, prefix=None):
    """The k best of the documents with vectors, with their facts."""
    f = facts(spark, d)
    known = search.allowed(vectors(spark, d), search.filtered(f, prefix))
    return search.with_facts(search.top_k(search.score(known, one(spark, d)).drop("embedding"), k), f)


def one(spark, d, vec_id=0):
    return table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))


V = """v AS (SELECT doc_id AS id, path, embedding, CASE WHEN label <> 5 THEN label END AS kind, content AS code, language AS symbol, sha256(content) AS segment_hash FROM files JOIN embeddings ON vec_id = doc_id),
q AS (SELECT vec_id AS qid, embedding AS q FROM embeddings WHERE vec_id = 0),
scored AS (SELECT id, path, kind, code, symbol, segment_hash, qid, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 6) AS score FROM v, q)"""


@query(f"WITH {V} SELECT id, score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INT) AS rank FROM scored QUALIFY rank <= 10")
def vector_topk(spark, d):
    known = search.allowed(vectors(spark, d), facts(spark, d))
    return search.top_k(search.score(known, one(spark, d)), 10).select("id", "score", F.col("rank").cast("int").alias("rank"))


@query(f"WITH {V} SELECT id, path, score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INT) AS rank FROM scored WHERE path = 'src1' OR starts_with(path, 'src1/') QUALIFY rank <= 5")
def filtered_topk(spark, d):
    return best(spark, d, 5, "src1").select("id", "path", "score", F.col("rank").cast("int").alias("rank"))


@query("""
WITH q AS (SELECT label AS qid, min(vec_id) AS k FROM embeddings GROUP BY label), s AS (SELECT vec_id AS id, qid, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(x.embedding AS DOUBLE[])), 6) AS score FROM embeddings e, (SELECT qid, embedding FROM q JOIN embeddings ON vec_id = k) x)
SELECT id, qid, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INT) AS rank FROM s QUALIFY rank <= 10
""", views=False)
def batch_topk(spark, d):
    e = table(spark, d, "embeddings")
    q = e.groupBy(F.col("label").alias("qid")).agg(F.min_by("embedding", "vec_id").alias("q"))
    v = e.select(F.col("vec_id").alias("id"), "embedding")
    return search.top_k(search.score(v, q), 10).select("id", "qid", "score", F.col("rank").cast("int").alias("rank"))


@query(f"WITH {V}, t AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM scored QUALIFY rank <= 50) SELECT id, score FROM t WHERE score >= 0.1 AND kind IN (1, 2, 3) AND regexp_matches(path, '^[^/]*/(en|fr)/.*$')")
def topk_post_filter(spark, d):
    return search.post_filter(best(spark, d, 50), 0.1, [1, 2, 3], ["*/{en,fr}/**"]).select("id", "score")


HYBRID = f"""WITH {V}, t AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM scored QUALIFY rank <= 40), f AS (SELECT *, translate(code, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS c FROM t WHERE score >= 0.05),
h AS (SELECT *, round(score * 0.85 + (CAST(contains(c, 'the') OR contains(symbol, 'the') AS INT) + CAST(contains(c, 'tion') OR contains(symbol, 'tion') AS INT)) / 2.0 * 0.15, 6) AS hybrid FROM f),
s AS (SELECT *, row_number() OVER (PARTITION BY segment_hash ORDER BY rank) AS r1 FROM h QUALIFY r1 = 1), b AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY hybrid DESC, rank) AS r2 FROM s QUALIFY r2 = 1)
SELECT id, path, hybrid AS score, CAST(row_number() OVER (ORDER BY hybrid DESC, rank) AS INT) AS rank FROM b"""


@query(HYBRID)
def hybrid_search(spark, d):
    out = search.semantic_search(vectors(spark, d), one(spark, d), "the tion", 40, min_score=0.05, facts=facts(spark, d))
    return out.select("id", "path", "score", F.col("rank").cast("int").alias("rank"))


@query(f"WITH {V}, t AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM scored QUALIFY rank <= 100), g AS (SELECT id, score, rank, split_part(path, '/', 1) AS path FROM t) SELECT id, path, score FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, rank) AS r FROM g) WHERE r = 1")
def best_per_file(spark, d):
    t = best(spark, d, 100).withColumn("path", F.substring_index("path", "/", 1))
    return search.best_per_file(t).select("id", "path", "score")


@query("SELECT label, count(*) AS n, round(avg(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS norm FROM embeddings GROUP BY label", views=False)
def vector_norms(spark, d):
    from ..functions import values

    e = table(spark, d, "embeddings").withColumn("v", values.with_dimension(F.col("embedding"), 64))
    return e.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(values.dot(F.col("v"), F.col("v"))), 6).alias("norm"))


@query("SELECT doc_id, CAST(contains(translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'the') AS INT) + CAST(contains(translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'der') AS INT) AS hits FROM files")
def matched_terms(spark, d):
    t = text.query_terms(F.lit("THE der"))
    return files(spark, d).select("doc_id", F.size(text.matched_terms(t, F.col("content"), F.lit(""))).alias("hits"))


@query(f"WITH {V} SELECT id, score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INT) AS rank FROM scored WHERE id % 3 = 1 QUALIFY rank <= 20")
def allow_list_topk(spark, d):
    ids = facts(spark, d).where("id % 3 = 1").select("id")
    return search.top_k(search.score(search.allowed(vectors(spark, d), ids), one(spark, d)), 20).select("id", "score", F.col("rank").cast("int").alias("rank"))


@query("SELECT 'all' AS among, (SELECT count(*) FROM embeddings WHERE vec_id % 50 = 0) AS queries, true AS enough UNION ALL SELECT 'few', (SELECT count(*) FROM embeddings WHERE vec_id % 50 = 0), true", views=False)
def ann_recall(spark, d):
    """Whether a walk over the graphs finds at least 0.9 of what scoring everything does, also among one in a hundred."""
    e = table(spark, d, "embeddings")
    v = e.select(F.col("vec_id").alias("id"), "embedding")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    index, few = neighbours.build(v), v.where("id % 100 = 7").select("id")
    rows = []
    for among, ids in (("all", None), ("few", few)):
        found = neighbours.search(index, q, 10, allow=ids, exact=False)
        share = neighbours.recall(found, neighbours.search(index, q, 10, allow=ids, exact=True))
        rows.append(q.agg(F.lit(among).alias("among"), F.count("*").alias("queries"), F.lit(share >= 0.9).alias("enough")))
    return rows[0].unionByName(rows[1])


@query("""
WITH q AS (SELECT vec_id AS qid, embedding AS q FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT vec_id AS id, qid, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 4) AS score FROM embeddings, q WHERE vec_id % 60 = 7)
SELECT qid, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INT) AS rank FROM s QUALIFY rank <= 5
""", views=False)
def ann_allow_list(spark, d):
    """Among few allowed vectors the index answers exactly."""
    e = table(spark, d, "embeddings")
    v = e.select(F.col("vec_id").alias("id"), "embedding")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    return neighbours.search(neighbours.build(v), q, 5, allow=v.where("id % 60 = 7").select("id")).select("qid", F.round("score", 4).alias("score"), "rank")
