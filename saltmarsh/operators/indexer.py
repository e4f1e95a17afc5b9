"""The index as a whole: changed files in, chunks, vectors and hashes out. The batch and the stream call the same function."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text, values
from . import index, semantic, texts
from .lexer import LANGUAGES

CHUNK_COLUMNS = ["path", "start_line", "end_line", "code", "doc_comment", "symbol_name", "symbol_kind", "segment_hash"]


@dataclass
class Index:
    """chunks (CHUNK_COLUMNS, summary, tags), vectors (segment_hash, embedding), hashes (path, content_hash)."""

    chunks: DataFrame
    vectors: DataFrame
    hashes: DataFrame


def empty(spark) -> Index:
    return Index(
        spark.createDataFrame([], "path string, start_line int, end_line int, code string, doc_comment string, symbol_name string, symbol_kind string, segment_hash string, summary string, tags array<string>"),
        spark.createDataFrame([], "segment_hash string, embedding array<float>"),
        spark.createDataFrame([], "path string, content_hash string"),
    )


def chunk(files: DataFrame, max_lines: int = texts.MAX_LINES, overlap: int = texts.OVERLAP_BYTES) -> DataFrame:
    """Chunks at boundaries where the language has rules for symbols, of lines elsewhere (an unknown language too); each once."""
    files = files.withColumn("language", F.coalesce("language", F.lit("unknown")))
    known = LANGUAGES
    code = semantic.semantic_chunks(files.where(F.col("language").isin(known))).select(CHUNK_COLUMNS)
    other = texts.overlapping_chunks(files.where(~F.col("language").isin(known)), max_lines, overlap)
    none = F.lit(None).cast("string")
    other = other.withColumn("doc_comment", none).withColumn("symbol_name", none).withColumn("symbol_kind", F.lit("lines"))
    return code.unionByName(other.select(CHUNK_COLUMNS)).dropDuplicates(["segment_hash"])


def update(old: Index, files: DataFrame, provider: Callable | None = None, model: Callable[[str], str] | None = None, cached: DataFrame | None = None, max_mb: float = index.MAX_FILE_MB, gone: bool = True) -> Index:
    """The index of files (path, language, content): what is unchanged stays, what is new or changed is chunked, enriched and embedded.

    Files over max_mb lose their entries and are skipped. gone: files that aren't in files any more lose theirs too, with
    their hash, so that a file that comes back is indexed again. A file's hash is kept only with its chunks.
    """
    small = files.where(~index.too_large(F.octet_length("content"), max_mb))
    now = small.select("path", values.content_hash(F.col("content")).alias("content_hash"))
    change = index.changed(now, old.hashes)
    todo = change.where(F.col("change").isin("new", "changed")).select("path")
    drop = change.where(F.col("change").isin("changed", "deleted") if gone else F.col("change") == "changed").select("path")
    new = chunk(small.join(todo, "path", "left_semi"))
    none = new.sparkSession.createDataFrame([], "segment_hash string, summary string, tags array<string>")
    if model:
        new = semantic.enrich(new, cached if cached is not None else none, model)
    else:
        new = new.withColumn("summary", F.lit(None).cast("string")).withColumn("tags", F.lit(None).cast("array<string>"))
    whole = text.embedding_text(F.col("doc_comment"), F.col("summary"), F.col("tags"), F.col("code"))
    vectors = semantic.embed(new.select("segment_hash", whole.alias("text")), provider)
    left = index.delete(old.chunks, drop, ["path"])
    chunks = left.unionByName(new.select(left.columns))
    kept = old.vectors.join(left.select("segment_hash"), "segment_hash", "left_semi")
    hashes = index.delete(old.hashes, drop, ["path"]).unionByName(now.join(todo, "path", "left_semi"))
    return Index(chunks, kept.unionByName(vectors.join(kept.select("segment_hash"), "segment_hash", "left_anti")), hashes)


def repair(state: Index, provider: Callable | None = None) -> Index:
    """The index with vectors for chunks that lack one."""
    whole = text.embedding_text(F.col("doc_comment"), F.col("summary"), F.col("tags"), F.col("code"))
    todo = state.chunks.join(state.vectors.select("segment_hash"), "segment_hash", "left_anti")
    return Index(state.chunks, state.vectors.unionByName(semantic.embed(todo.select("segment_hash", whole.alias("text")), provider)), state.hashes)


def fits(state: Index, dim: int) -> bool:
    """Whether the stored vectors have this many dimensions; if not, the index has to be made anew."""
    return state.vectors.where(F.size("embedding") != dim).limit(1).count() == 0
