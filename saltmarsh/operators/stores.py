"""What the two stores answer by key: the graph's files and symbols, and the index's entries, vectors, hashes and descriptions.

Each is a filter or an equi-join over a stored table, so conditions and columns reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths


def by_key(rows: DataFrame, key: str, value) -> DataFrame:
    """The rows with this key: a file by its path, a symbol by its id, a file's symbols, a description or a hash by its key."""
    return rows.where(F.col(key) == value)


def exists(rows: DataFrame, key: str, value) -> bool:
    return by_key(rows, key, value).limit(1).count() > 0


def entries(entries_: DataFrame, hashes: DataFrame) -> DataFrame:
    """The entries (segment_hash, ..) of these hashes, each once however often it is asked for."""
    return entries_.join(hashes.select("segment_hash").distinct(), "segment_hash", "left_semi").select(entries_.columns)


def paths_from_id(entries_: DataFrame, ids: DataFrame, least: int) -> DataFrame:
    """(path): the distinct paths of entries whose vector has an id (segment_hash, id) from least on, in order."""
    return entries_.join(ids.where(F.col("id") >= least), "segment_hash").select("path").distinct().orderBy("path")


def ids_under(entries_: DataFrame, ids: DataFrame, prefix: str) -> DataFrame:
    """(id): the vectors of entries at or below a path, as an allow-list for a search."""
    return ids.join(entries_.where(paths.has_prefix(F.col("path"), prefix)).select("segment_hash"), "segment_hash", "left_semi").select("id")


def with_tags(rows: DataFrame, tags: Column | str = "tags") -> DataFrame:
    """rows with tags as they are stored: a JSON array."""
    return rows.withColumn("tags_json", F.to_json(F.col(tags) if isinstance(tags, str) else tags))


def read_tags(rows: DataFrame) -> DataFrame:
    """tags from their JSON; null where it is none."""
    return rows.withColumn("tags", F.from_json("tags_json", "array<string>"))
