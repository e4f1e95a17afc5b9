"""Vector search, exact: filters, top-k for one or many queries, hybrid ranking, one result per segment or file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, text, values

MIN_K, MAX_K = 1, 1000
MIN_SCORE, MAX_RESULTS = 0.4, 5
#: Rows of queries that may be broadcast against the vectors.
MAX_QUERIES = 10_000


def clamp_k(k: int) -> int:
    return max(MIN_K, min(MAX_K, k))


def score(vectors: DataFrame, query: DataFrame, digits: int = 6) -> DataFrame:
    """vectors (id, embedding, ..) with the cosine to each query (qid, q), rounded so that equal scores tie everywhere."""
    n = query.limit(MAX_QUERIES + 1).count()
    if n > MAX_QUERIES:
        raise ValueError(f"more than {MAX_QUERIES} queries at once")
    return vectors.crossJoin(F.broadcast(query)).withColumn("score", F.round(values.cosine(F.col("embedding"), F.col("q")), digits)).drop("q")


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """The k best for each query, rank from 1; Spark keeps k rows a task before it shuffles."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= clamp_k(k))


def filtered(vectors: DataFrame, prefix: str | None = None) -> DataFrame:
    """The candidates a search may return: a path prefix counts before the k best are taken."""
    return vectors if not prefix else vectors.where(paths.has_prefix(F.col("path"), prefix))


def post_filter(results: DataFrame, min_score: float | None = None, kinds: list | None = None, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """What counts after the k best: score, kinds (null fails), globs. These shrink the answer."""
    out = results
    if min_score is not None:
        out = out.where(F.col("score") >= min_score)
    if kinds is not None:
        out = out.where(F.col("kind").isin(kinds))
    if include or exclude:
        out = out.where(paths.selected(F.col("path"), list(include), list(exclude)))
    return out


def rerank(results: DataFrame, query: str) -> DataFrame:
    """score becomes hybrid: mostly the vector's, and the share of the query's terms in the code or symbol."""
    terms = text.query_terms(F.lit(query))
    lex = text.lexical_score(terms, F.col("code"), F.col("symbol"))
    return results.withColumn("lexical", lex).withColumn("score", F.round(text.hybrid_score(F.col("score"), F.col("lexical")), 6))


def first_per_segment(results: DataFrame) -> DataFrame:
    w = Window.partitionBy("qid", "segment_hash").orderBy("rank")
    return results.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def best_per_file(results: DataFrame) -> DataFrame:
    w = Window.partitionBy("qid", "path").orderBy(F.desc("score"), "rank")
    return results.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def re_rank(results: DataFrame) -> DataFrame:
    """Ranks from 1 again, by score, then the old rank."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "rank")
    return results.withColumn("new_rank", F.row_number().over(w)).drop("rank").withColumnRenamed("new_rank", "rank")


def with_facts(results: DataFrame, facts: DataFrame) -> DataFrame:
    """The k best rows with their columns of facts (id, ..), among them a segment_hash by the text: read for these rows only."""
    out = results.join(facts, "id")
    return out if "segment_hash" in facts.columns else out.withColumn("segment_hash", F.sha2("code", 256))


def allowed(vectors: DataFrame, ids: DataFrame | None) -> DataFrame:
    """vectors whose id is in an allow-list (id); all of them without one."""
    return vectors if ids is None else vectors.join(ids.select("id"), "id", "left_semi")


def semantic_search(vectors: DataFrame, query: DataFrame, query_text: str, k: int = MAX_RESULTS, prefix: str | None = None, min_score: float = MIN_SCORE, include: list[str] = (), exclude: list[str] = (), per_file: bool = True, facts: DataFrame | None = None) -> DataFrame:
    """The whole pipeline: prefix, k best, minimum score, globs, hybrid order, one per segment and file, ranks.

    Without facts, vectors has all columns. With facts (id, path, code, symbol, ..), vectors (id, embedding) are scored
    alone: of facts only the ids are read before (and paths, where there is a prefix), the rest for the k best rows.
    """
    if facts is None:
        out = top_k(score(filtered(vectors, prefix), query), k)
    else:
        known = allowed(vectors.select("id", "embedding"), filtered(facts, prefix))
        out = with_facts(top_k(score(known, query).drop("embedding"), k), facts)
    out = post_filter(out, min_score, include=include, exclude=exclude)
    out = first_per_segment(rerank(out, query_text))
    return re_rank(best_per_file(out) if per_file else out)
