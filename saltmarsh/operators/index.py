"""Keeping indexed tables: upserts, deletes, change detection, repair, statistics, atomic replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .paging import first_per_group

MAX_FILE_MB = 1.0


def latest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The newest row of each key; order is newest first and total."""
    return first_per_group(rows, keys, order)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """old with new's rows: inserted, or in place of rows with their key. new's later versions win; equal ones by all columns."""
    fresh = latest(new, keys, [F.desc(version), *[F.col(c).asc_nulls_first() for c in new.columns if c not in keys]])
    return old.join(fresh.select(keys), keys, "left_anti").select(old.columns).unionByName(fresh.select(old.columns))


def replace_children(children: DataFrame, new: DataFrame, parent: str, touched: DataFrame | None = None) -> DataFrame:
    """children with those of new's parents taken out and new put in; touched parents without new children lose theirs."""
    gone = new.select(parent) if touched is None else new.select(parent).unionByName(touched.select(parent))
    return children.join(gone.distinct(), parent, "left_anti").select(children.columns).unionByName(new)


def delete(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(keys).distinct(), keys, "left_anti").select(rows.columns)


def delete_cascade(parent: DataFrame, children: list[DataFrame], where, key: str) -> list[DataFrame]:
    """The parent without some rows, and each child without rows of these."""
    gone = parent.where(where).select(key)
    return [delete(t, gone, [key]) for t in (parent, *children)]


def put_state(state: DataFrame, key: str, value: str | None) -> DataFrame:
    """A key-value table with a key set, or without it where the value is None."""
    left = state.where(F.col("key") != key)
    return left if value is None else left.unionByName(state.sparkSession.range(1).select(F.lit(key).alias("key"), F.lit(value).alias("value")))


def changed(files: DataFrame, hashes: DataFrame) -> DataFrame:
    """files (path, content_hash) with change: new, changed or unchanged against hashes; deleted for paths that are gone."""
    old = hashes.select("path", F.col("content_hash").alias("old_hash"), F.lit(True).alias("was"))
    rows = files.select("path", "content_hash", F.lit(True).alias("is")).join(old, "path", "full_outer")
    kind = F.when(F.col("is").isNull(), "deleted").when(F.col("was").isNull(), "new").when(F.col("content_hash").eqNullSafe(F.col("old_hash")), "unchanged").otherwise("changed")
    return rows.select("path", kind.alias("change"))


def too_large(size_bytes, mb: float = MAX_FILE_MB):
    return size_bytes > F.lit(int(mb * 1024 * 1024))


def missing_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Paths whose chunks lack a vector, to index again."""
    return chunks.join(vectors.select("segment_hash"), "segment_hash", "left_anti").select("path").distinct()


def stats(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("chunks"), F.countDistinct("path").alias("files"), F.coalesce(F.max("indexed_at"), F.lit(0)).alias("last_indexed"))


def fetch_in_order(requests: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """requests (pos, key) with their entries: the requests' order, duplicates kept, null where there is none."""
    return requests.join(entries, key, "left_outer").orderBy("pos", key)


#: Keys that come to the driver to cut keys into ranges.
BOUNDS = 64


def next_ids(rows: DataFrame, new: DataFrame, key: str, id_col: str = "id") -> DataFrame:
    """new's keys with ids from the largest on, in the keys' order. Ids by hash need no order; this is for callers that want dense ones.

    Keys are numbered within ranges, cut at the BOUNDS keys of least hash; only the ranges' counts are ordered as a whole.
    """
    keys = new.select(key).where(F.col(key).isNotNull()).distinct()
    bounds = sorted(r[0] for r in keys.orderBy(F.xxhash64(key), key).limit(BOUNDS).collect())
    part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(key))) if bounds else F.lit(0)
    keys = keys.withColumn("_part", part)
    counts = keys.groupBy("_part").agg(F.count("*").alias("_n"))  # BOUNDS + 1 rows at most
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    top = rows.agg((F.coalesce(F.max(id_col), F.lit(-1)) + 1).alias("_base"))
    starts = counts.select("_part", before.alias("_before")).crossJoin(top).select("_part", (F.col("_before") + F.col("_base")).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    return keys.withColumn("_place", place).join(F.broadcast(starts), "_part").select(key, (F.col("_start") + F.col("_place") - 1).cast("long").alias(id_col))


def overwrite_atomically(df: DataFrame, path: str) -> None:
    """df in place of what is at path: written whole beside it first, then renamed.

    Between the two renames path is missing: load_or_empty() then reads the old table, beside it, so its readers always see
    one of the two, and a failure loses neither.
    """
    spark: SparkSession = df.sparkSession
    part, old = f"{path}.new", f"{path}.old"
    df.write.mode("overwrite").parquet(part)
    jvm = spark.sparkContext._jvm
    to = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = to(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(to(path)):
        fs.delete(to(old), True)
        fs.rename(to(path), to(old))
    fs.rename(to(part), to(path))
    fs.delete(to(old), True)


def reset(df: DataFrame, path: str) -> None:
    overwrite_atomically(df.limit(0), path)


def load_or_empty(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, str]:
    """(table, state): Ready, or an empty table and Empty where it can't be read, neither at path nor where a replacement put it aside."""
    from pyspark.errors import AnalysisException

    for at in (path, f"{path}.old"):
        try:
            return spark.read.schema(schema).parquet(at), "Ready"
        except AnalysisException:
            continue
    return spark.createDataFrame([], schema), "Empty"
