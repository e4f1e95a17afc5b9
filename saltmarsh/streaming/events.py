"""File changes, diagnostics and tool calls as streams, kept as tables by micro-batches.

Every operator here is a function of DataFrames, so the same code runs on a batch; sinks go through foreachBatch with
writes by key, so a repeated batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import index
from ..sources import versions

DEBOUNCE, TICK, QUEUE = "2 seconds", "5 seconds", 1000
EVENTS = "path string, ts timestamp, op string"


def file_events(spark: SparkSession, folder: str, per_trigger: int = QUEUE) -> DataFrame:
    """A stream of (path, ts, op) from JSON files; at most so many files each time, which is the back-pressure."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_trigger).json(folder)


def wanted(events: DataFrame, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """Events of files that the index covers; filtered before any state is kept."""
    return events.where(paths.selected(F.col("path"), list(include), list(exclude)))


def debounced(events: DataFrame, gap: str = DEBOUNCE, late: str = "10 seconds") -> DataFrame:
    """(path, start, end, n): bursts of events of a file, closed after a gap.

    Write the result before filtering on its window: predicates on a session window may be pushed below its merge.
    """
    e = events.withWatermark("ts", late) if events.isStreaming else events
    g = e.groupBy(F.session_window("ts", gap).alias("w"), "path").agg(F.count("*").alias("n"))
    return g.select("path", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def microbatches(events: DataFrame, tick: str = TICK) -> DataFrame:
    """(tick, path): the distinct files of each tick."""
    return events.select(F.window("ts", tick)["start"].alias("tick"), "path").distinct()


def routed(events: DataFrame) -> DataFrame:
    """(path, action): what the last event of a file asks for: delete, or upsert."""
    last = index.latest(events, ["path"], [F.desc("ts"), F.desc("op")])
    return last.select("path", F.when(F.col("op") == "delete", "delete").otherwise("upsert").alias("action"))


def latest_state(diagnostics: DataFrame) -> DataFrame:
    """(uri, ts, items): the last list of each uri; an empty one clears it."""
    return index.latest(diagnostics, ["uri"], [F.desc("ts")]).where(F.size("items") > 0)


def open_tokens(progress: DataFrame) -> DataFrame:
    """(client, open, loading) of progress (client, token, kind): tokens begun and not ended."""
    t = progress.groupBy("client", "token").agg((F.count_if(F.col("kind") == "begin") > F.count_if(F.col("kind") == "end")).alias("is_open"))
    return t.groupBy("client").agg(F.count_if("is_open").alias("open")).withColumn("loading", F.col("open") > 0)


def toggled(events: DataFrame) -> DataFrame:
    """Paths of which a cache holds the content after events: each one puts it in or takes it out."""
    return events.groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") % 2 == 1).select("path")


def keep_index(stream: DataFrame, table_path: str, read: Callable[[DataFrame], DataFrame], checkpoint: str, key: str = "path"):
    """Runs until the stream's files are read: each batch's files are read again by read(), replaced in or deleted from the table.

    The table is one of ``sources.versions``: a batch rewrites only the buckets of its files, as one version that readers see
    whole or not at all. A version says which batch it is, so a batch that is given again after a failure changes nothing.
    """
    name = f"batch of {checkpoint}"

    def apply(batch: DataFrame, number: int) -> None:
        found = versions.manifest(batch.sparkSession, table_path)
        if found and found["note"].get(name, -1) >= number:
            return
        todo = routed(batch).persist()
        try:
            new = read(todo.where("action = 'upsert'").select(key))
            versions.merge(table_path, new, [key], todo.select(key), note={name: number})
        finally:
            todo.unpersist()

    q = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def running_counters(calls: DataFrame) -> DataFrame:
    """(tool, total, success, failure), for complete or update mode."""
    ok = F.coalesce(F.col("success"), F.lit(False))
    return calls.groupBy("tool").agg(F.count("*").alias("total"), F.sum(ok.cast("int")).alias("success"), F.sum((~ok).cast("int")).alias("failure"))
