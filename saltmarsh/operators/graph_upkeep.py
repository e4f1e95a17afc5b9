"""The code graph kept by deltas: a changed file costs its own facts and the calls into it, not a new build.

Facts (files, symbols, calls) and edges are tables of ``sources.versions``. Calls are kept twice, by the file they are in
and by the file they go to, so that both kinds of calls that a change concerns are found by bucket. An edge is held with the
number of its derivations (a file's symbol; a call with its caller and what it calls), and a call site likewise. An update
joins the calls that touch a changed file with the symbols before and after it, subtracts the ones from the others, and
merges the sums: what has no derivation left goes, whatever the order of changes.

Edges are committed before facts, under the batch's name: an update that fails in between is given again with the same
name, finds the edges done, and only brings the facts up. Defined cases: a touched file without facts is removed; facts of
files that aren't touched are an error of the caller and are left out; repeated facts count as often as they are given, and show as one edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values
from ..sources import versions
from ..sources.work import drop, materialize
from .graph import call_edges

SYMBOLS = ["path", "name", "kind", "sl", "sc"]
CALLS = ["path", "caller", "to_path", "name", "line", "character"]


def _parts(root: str) -> dict[str, tuple[str, list[str]]]:
    """Table -> (its folder, its key)."""
    keys = {"files": ["path"], "symbols": ["path"], "calls": ["path"], "calls_into": ["to_path"], "edges": ["id"], "sites": ["edge_id", "line", "character"]}
    return {k: (f"{root}/{k}", key) for k, key in keys.items()}


def _derived(files: DataFrame, symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """(id, kind, from_id, to_id, line, character) of each derivation; places only of calls."""
    s, c = call_edges(symbols, calls)
    none = F.lit(None).cast("int")
    d = s.join(files.select("path").distinct(), "path").select(F.lit("defines").alias("kind"), values.graph_id("f", F.col("path")).alias("from_id"), F.col("sym_id").alias("to_id"), none.alias("line"), none.alias("character"))
    out = d.unionByName(c.select(F.col("edge_kind").alias("kind"), "from_id", "to_id", F.col("line").cast("int").alias("line"), F.col("character").cast("int").alias("character")))
    return out.select(values.graph_id("e", F.col("kind"), F.col("from_id"), F.col("to_id")).alias("id"), "*")


def create(files: DataFrame, symbols: DataFrame, calls: DataFrame, root: str, buckets: int = versions.BUCKETS) -> None:
    """The tables of a graph, from all facts: files (path), symbols (SYMBOLS), calls (CALLS)."""
    symbols, calls = symbols.select(SYMBOLS), calls.select(CALLS)
    found = materialize(_derived(files, symbols, calls), "derived")
    edges = found.groupBy("id", "kind", "from_id", "to_id").agg(F.count("*").alias("n"))
    sites = found.where("line IS NOT NULL").groupBy(F.col("id").alias("edge_id"), "line", "character").agg(F.count("*").alias("n"))
    for name, df in {"edges": edges, "sites": sites, "files": files.select("path"), "symbols": symbols, "calls": calls, "calls_into": calls}.items():
        path, keys = _parts(root)[name]
        versions.replace(df, path, keys, buckets)
    drop(found)


def _of(spark: SparkSession, root: str, table: str, keys: DataFrame) -> DataFrame:
    """Rows of a table whose key is one of keys (key): only buckets of these are read."""
    path, key = _parts(root)[table]
    n = versions.manifest(spark, path)["buckets"]
    named = keys.toDF(*key)
    wanted = [r[0] for r in named.select(versions.bucket_of([F.col(k) for k in key], n)).distinct().collect()]  # at most a number for each bucket
    return versions.read(spark, path, buckets=wanted).join(named.distinct(), key, "left_semi")


def update(touched: DataFrame, files: DataFrame, symbols: DataFrame, calls: DataFrame, root: str, batch: str) -> None:
    """Brings the graph to the touched paths' facts as they are now; paths without facts go."""
    spark = touched.sparkSession
    parts, touched = _parts(root), materialize(touched.select("path").distinct(), "touched")
    only = lambda df: df.join(touched, "path", "left_semi")
    files, symbols, calls = only(files.select("path")), only(symbols.select(SYMBOLS)), only(calls.select(CALLS))
    if versions.manifest(spark, parts["edges"][0])["note"].get("batch") != batch:
        delta = _deltas(spark, root, touched, files, symbols, calls)
        for name, keys in (("sites", ["edge_id", "line", "character"]), ("edges", ["id", "kind", "from_id", "to_id"])):
            path, key = parts[name]
            steps = delta.where("line IS NOT NULL").withColumnRenamed("id", "edge_id") if name == "sites" else delta
            steps = materialize(steps.groupBy(keys).agg(F.sum("n").alias("n")).where("n <> 0"), "steps")
            if versions.manifest(spark, path)["note"].get("batch") == batch:
                continue
            old = _of(spark, root, name, steps.select(key))
            now = old.select(*keys, "n").unionByName(steps).groupBy(keys).agg(F.sum("n").alias("n")).where("n > 0")
            if versions.merge(path, now, key, steps.select(key), note={"batch": batch}) is None and name == "edges":
                versions.merge(path, now, key, spark.createDataFrame([("",)], "id string"), note={"batch": batch})
            drop(steps)
        drop(delta)
    # calls into other files move with the file they are in: those of before are taken out by their own key
    before = materialize(_of(spark, root, "calls", touched), "before")
    targets = before.select("to_path").union(calls.select("to_path")).distinct()
    stay = _of(spark, root, "calls_into", targets).join(touched, "path", "left_anti")
    versions.merge(parts["calls_into"][0], stay.select(CALLS).unionByName(calls), ["to_path"], targets)
    for name, df in (("files", files), ("symbols", symbols), ("calls", calls)):
        versions.merge(parts[name][0], df, ["path"], touched)
    drop(before, touched)


def _deltas(spark: SparkSession, root: str, touched: DataFrame, files: DataFrame, symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """Derivations with n: 1 for what holds now, -1 for what held; only calls from or into touched files, and their ends."""
    into = _of(spark, root, "calls_into", touched).join(touched, "path", "left_anti").select(CALLS)
    old_calls = materialize(_of(spark, root, "calls", touched).select(CALLS).unionByName(into), "old_calls")
    new_calls = materialize(calls.unionByName(into), "new_calls")
    both = old_calls.unionByName(new_calls)
    ends = both.select("path").union(both.select("to_path")).union(touched).distinct()
    old_symbols = materialize(_of(spark, root, "symbols", ends).select(SYMBOLS), "old_symbols")
    new_symbols = old_symbols.join(touched, "path", "left_anti").select(SYMBOLS).unionByName(symbols)
    old_files = _of(spark, root, "files", touched)
    # symbols of other files are ends of calls only: no file here defines them
    gone = _derived(old_files, old_symbols, old_calls).withColumn("n", F.lit(-1).cast("long"))
    made = _derived(files, new_symbols, new_calls).withColumn("n", F.lit(1).cast("long"))
    out = materialize(gone.unionByName(made), "deltas")
    drop(old_calls, new_calls, old_symbols)
    return out


def edges(spark: SparkSession, root: str) -> DataFrame:
    """The edges as graph.build() gives them."""
    e = versions.read(spark, _parts(root)["edges"][0])
    return e.select("kind", "from_id", "to_id", "id", F.lit("high").alias("confidence"), F.lit("lsp").alias("provenance"))


def sites(spark: SparkSession, root: str) -> DataFrame:
    """The call sites as graph.build_sites() gives them."""
    return versions.read(spark, _parts(root)["sites"][0]).select("edge_id", "line", "character")
