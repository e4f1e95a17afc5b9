"""Tables kept in versions: immutable files in buckets by hash of a key, and a manifest for each version.

A table is a folder with ``data/<commit>/bucket=<n>/*.parquet`` and ``versions/<number>/manifest.json``. A manifest names, for
each bucket that has rows, the commit whose files are the bucket's. A commit writes the buckets it touches as files of
its own, then puts its manifest in place by one rename that doesn't replace: of two writers that start from one version
one is refused (``Conflict``), and its files are left for ``expire``. Readers resolve the last manifest once and read the
files it names, which no later commit changes; so a reader sees one version as a whole, also while others are written.

merge() reads and writes only the buckets of the keys it touches; their rows meet the batch by bucket and key, and are
dealt out by bucket with a rebalancing exchange, which splits a bucket that is large. What a key is, a row's own key
(upsert) or its parent's (children replaced as a whole), is for the caller to say: rows of every touched key are taken
out, and the new ones put in, so a touched key without new rows is deleted.

Defined cases: null keys are keys like others; an empty batch commits nothing; a table that isn't there reads as None, and its first
commit makes it; rows given twice stay twice (callers take the latest first); columns are those of the first commit.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64
MANIFEST = "manifest.json"
#: Touched keys that are sent to every task; more are joined by an exchange.
FEW_KEYS = 100_000


class Conflict(RuntimeError):
    """Another writer has committed the version first."""


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _list(spark: SparkSession, path: str) -> list[str]:
    p, fs = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def _read_text(spark: SparkSession, path: str) -> str:
    p, fs = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    p, fs = _fs(spark, path)
    stream = fs.create(p, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the versions that are there, ascending."""
    return sorted(int(x) for x in _list(spark, f"{path}/versions") if x.isdigit())


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """The manifest of a version, or of the last one; None where there is none."""
    if version is None:
        known = versions(spark, path)
        if not known:
            return None
        version = known[-1]
    return json.loads(_read_text(spark, f"{path}/versions/{version}/{MANIFEST}"))


def read(spark: SparkSession, path: str, version: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
    """The table as of a version, or of the last one; buckets: these alone."""
    found = manifest(spark, path, version)
    return None if found is None else _rows(spark, path, found, buckets).drop("bucket")


def _rows(spark: SparkSession, path: str, found: dict, buckets: list[int] | None = None) -> DataFrame:
    schema = StructType.fromJson(found["schema"])
    wanted = [f"{path}/data/{commit}/bucket={b}" for b, commit in found["files"].items() if buckets is None or int(b) in buckets]
    if not wanted:
        return spark.createDataFrame([], schema).withColumn("bucket", F.lit(None).cast("int"))
    rows = spark.read.schema(schema).parquet(*wanted)
    return rows.withColumn("bucket", bucket_of([F.col(f"`{k}`") for k in found["keys"]], found["buckets"]))


def bucket_of(keys: list[Column], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _commit(spark: SparkSession, path: str, before: dict | None, files: dict, schema: StructType, keys: list[str], buckets: int, commit: str, note: dict) -> int:
    """Puts the next manifest in place, or raises Conflict where its number has been taken."""
    number = before["version"] + 1 if before else 0
    body = {"version": number, "commit": commit, "keys": keys, "buckets": buckets, "files": files, "schema": json.loads(schema.json()), "at": time.time(), "note": {**(before or {}).get("note", {}), **note}}
    part, to = f"{path}/pending/{commit}", f"{path}/versions/{number}"
    _write_text(spark, f"{part}/{MANIFEST}", json.dumps(body))
    jvm = spark.sparkContext._jvm
    parent, fs = _fs(spark, f"{path}/versions")
    fs.mkdirs(parent)
    source, target = jvm.org.apache.hadoop.fs.Path(part), jvm.org.apache.hadoop.fs.Path(to)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(source), fs.makeQualified(target), spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as e:
        if not fs.exists(target):
            raise
        raise Conflict(f"version {number} of {path} is another writer's") from e
    # a file system that moves a folder into one that is there has not replaced it: what stands there says whose it is
    if json.loads(_read_text(spark, f"{to}/{MANIFEST}"))["commit"] != commit:
        raise Conflict(f"version {number} of {path} is another writer's")
    return number


def _written(spark: SparkSession, rows: DataFrame, path: str, commit: str) -> dict:
    """Writes rows (.., bucket) as a commit's files; {bucket: commit} of those that have rows."""
    rows.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{path}/data/{commit}")
    return {x.removeprefix("bucket="): commit for x in _list(spark, f"{path}/data/{commit}") if x.startswith("bucket=")}


def replace(rows: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS, note: dict | None = None) -> int:
    """A version that holds rows alone; its number."""
    spark, commit = rows.sparkSession, uuid.uuid4().hex
    before = manifest(spark, path)
    files = _written(spark, rows.withColumn("bucket", bucket_of([F.col(f"`{k}`") for k in keys], buckets)), path, commit)
    return _commit(spark, path, before, files, rows.schema, keys, buckets, commit, note or {})


def merge(path: str, new: DataFrame, keys: list[str], touched: DataFrame | None = None, buckets: int = BUCKETS, retries: int = 0, note: dict | None = None) -> int | None:
    """A version in which the rows of all touched keys are those of new; its number, None where nothing is touched.

    touched (keys): the keys whose rows go, those of new among them anyway. Only buckets of touched keys are read or written.
    """
    spark = new.sparkSession
    for attempt in range(retries + 1):
        before = manifest(spark, path)
        if before and before["keys"] != keys:
            raise ValueError(f"{path} is kept by {before['keys']}")
        n = before["buckets"] if before else buckets
        schema = StructType.fromJson(before["schema"]) if before else new.schema
        bucket = bucket_of([F.col(f"`{k}`") for k in keys], n)
        fresh = new.select([f.name for f in schema]).withColumn("bucket", bucket)
        gone = fresh.select(*keys, "bucket")
        if touched is not None:
            typed = touched.select(*[F.col(f"`{k}`").cast(schema[k].dataType).alias(k) for k in keys])
            gone = gone.unionByName(typed.withColumn("bucket", bucket))
        gone = gone.distinct().persist()
        try:
            counts = {r["bucket"]: r["n"] for r in gone.groupBy("bucket").agg(F.count("*").alias("n")).collect()}  # a row for each bucket at most
            if not counts:
                return None
            commit = uuid.uuid4().hex
            if before:
                left = F.broadcast(gone) if sum(counts.values()) <= FEW_KEYS else gone
                old = _rows(spark, path, before, sorted(counts)).alias("o")
                same = [F.col(f"o.{k}").eqNullSafe(F.col(f"g.{k}")) for k in [*keys, "bucket"]]
                fresh = old.join(left.alias("g"), same, "left_anti").unionByName(fresh)
            made = _written(spark, fresh, path, commit)
            files = {b: c for b, c in (before["files"] if before else {}).items() if int(b) not in counts} | made
            return _commit(spark, path, before, files, schema, keys, n, commit, note or {})
        except Conflict:
            if attempt == retries:
                raise
        finally:
            gone.unpersist()
    return None


def expire(spark: SparkSession, path: str, keep: int = 2, grace: float = 3600.0) -> list[str]:
    """Deletes all but the last keep versions, and files that none of these name; the commits whose files went.

    Files of writers that haven't committed look alike: those changed within grace seconds stay.
    """
    known = versions(spark, path)
    kept = [manifest(spark, path, v) for v in known[-keep:]]
    named = {c for m in kept for c in m["files"].values()}
    for v in known[:-keep]:
        p, fs = _fs(spark, f"{path}/versions/{v}")
        fs.delete(p, True)
    gone = []
    for commit in _list(spark, f"{path}/data"):
        p, fs = _fs(spark, f"{path}/data/{commit}")
        if commit not in named and (time.time() - fs.getFileStatus(p).getModificationTime() / 1000 >= grace):
            fs.delete(p, True)
            gone.append(commit)
    return gone
