"""What the training-data operators share: scratch tables, Arrow batches, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.work import drop, drop_scratch, materialize, scratch, shared_dir  # noqa: F401

#: Rows of a batch that Python workers get; long texts make larger batches dear.
BATCH_ROWS = 400
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, most: int = BATCH_BYTES) -> None:
    """Batches of so many rows, and of so many bytes at most: very long texts come a few at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What workers keep between tasks; Spark hands a worker from one operator to the next.
_KEPT: list[dict] = []


def kept(cache: dict) -> dict:
    """Registers a module's cache, so that other operators' tasks can let go of it."""
    _KEPT.append(cache)
    return cache


def release(but: dict | None = None) -> None:
    """Called where a task starts: empties what other operators have left in this worker's memory."""
    held = [c for c in _KEPT if c and c is not but]
    for cache in held:
        cache.clear()
    if held:
        gc.collect()
    trim()


def trim() -> None:
    """What allocators keep of freed memory goes back to the system; an executor's workers share its limit."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches, text: str | None = None, rows: int = BATCH_ROWS, most: int = BATCH_BYTES):
    """Record batches cut to so many rows, and to about so many bytes of one column, inside the task: no session setting."""
    for b in batches:
        at = 0
        if text is not None and len(b):
            ends = np.cumsum(pc.binary_length(b.column(b.schema.get_field_index(text))).fill_null(0).to_numpy())
        while at < len(b):
            n = min(rows, len(b) - at)
            if text is not None:
                before = int(ends[at - 1]) if at else 0
                n = max(1, min(n, int(np.searchsorted(ends, before + most, "right")) - at))
            yield b.slice(at, n)
            at += n


def row_key(text_col: str = "text") -> list:
    """[doc_id, t], what a row of (doc_id, text) is known by, never null: a null doc_id is 0 and counts in the text's hash."""
    doc_id = F.col("doc_id").cast("long")
    t = F.when(doc_id.isNull(), F.xxhash64(text_col, F.lit("no doc_id"))).otherwise(F.xxhash64(text_col))
    return [F.coalesce(doc_id, F.lit(0)).cast("long").alias("doc_id"), t.alias("t")]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the undirected edges (src, dst), component the smallest node reachable.

    Alternates large-star and small-star steps; each is one minimum by key (partial aggregation) and one join back. The
    minima of the large star are written first, so both sides of its join are plain exchanges, and AQE splits the one in
    which a hub has many neighbours. A round's edges are written to the shared folder, so a lost executor costs a reread,
    never a recomputation, and the tables of the round before are deleted. Ends when all edges are those of stars around
    the smallest nodes, after about log(diameter) rounds.

    Defined cases: an edge of a node with itself, and a null end, say nothing; repeated edges count once; no edges give
    no rows. More than rounds rounds (a diameter beyond 2**rounds) are an error.
    """
    e = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("src <> dst").select("u", "v").distinct()
    e = materialize(e, "edges")
    for _ in range(rounds):
        # a star: no node hangs below two others, and none below a node that hangs itself
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(e.select("v", F.lit(0), F.lit(1)))
        if not ends.groupBy("x").agg(F.sum("below").alias("n"), F.max("above").alias("above")).where("n > 1 OR n = 1 AND above = 1").limit(1).count():
            break
        # large-star: every neighbour above u hangs itself below u's smallest neighbour
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")), "minima")
        big = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        big = materialize(big.distinct(), "edges")
        drop(e, low)
        # small-star: the lower neighbours of u, and u, hang below the smallest of them
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = materialize(small.where("u <> v").distinct(), "edges")
        drop(big)
    else:
        raise RuntimeError(f"not done after {rounds} rounds")
    out = e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.groupBy("v").agg(F.first("v").alias("component")).select(F.col("v").alias("node"), "component")
    )
    out.scratch_path = e.scratch_path
    return out
