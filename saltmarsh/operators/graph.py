"""The code graph: statistics, modules, bounded breadth-first search, impact and context, building and removal.

A breadth-first search joins its frontier, never the whole of what it has seen, with the edges; each level is written to
the shared folder, so it is reached once and lineage stays short. Depth is bounded, so is the number of jobs. Edges are
read once a level: pass a stored table, not a view that is dear to derive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, values
from ..sources.work import materialize
from .paging import first_per_group

KINDS = ("defines", "imports", "calls")


def stats(files: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: files, symbols, edges."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(files, "files").crossJoin(n(symbols, "symbols")).crossJoin(n(edges, "edges"))


def modules(files: DataFrame, symbols: DataFrame, scope: str = "", include_external: bool = False) -> DataFrame:
    """(module, files, symbols): files by their first two folders; symbols count where the module has a file."""
    kept = files.where(F.col("path").startswith(scope))
    kept = kept if include_external else kept.where(~F.col("is_external"))
    f = kept.groupBy(paths.module_path(F.col("path")).alias("module")).agg(F.count("*").alias("files"))
    s = symbols.groupBy(paths.module_path(F.col("path")).alias("module")).agg(F.count("*").alias("symbols"))
    return f.join(s, "module", "left_outer").select("module", "files", F.coalesce("symbols", F.lit(0)).alias("symbols"))


def top_symbols(symbols: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """Symbols by incoming calls, the most called first, then by id."""
    n = edges.where("kind = 'calls'").groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("calls"))
    return symbols.join(n, "id", "left_outer").select("id", "name", F.coalesce("calls", F.lit(0)).alias("calls")).orderBy(F.desc("calls"), "id").limit(limit)


def edge_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("kind").agg(F.count("*").alias("n"))


def of_kinds(edges: DataFrame, kind: str | None) -> DataFrame:
    """Edges of a kind; a kind that isn't one means all."""
    return edges.where(F.col("kind") == kind) if kind in KINDS else edges


def bfs(edges: DataFrame, starts: DataFrame, direction: str, depth: int) -> DataFrame:
    """(id, depth): what is reached from starts (id) within depth steps, each at its least depth; starts at 0."""
    out = edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    back = edges.select(F.col("to_id").alias("a"), F.col("from_id").alias("b"))
    arcs = {"outgoing": out, "incoming": back, "both": out.unionByName(back)}[direction]
    seen = starts.select("id").distinct().withColumn("depth", F.lit(0))
    if depth < 1:
        return seen
    frontier = seen = materialize(seen, "level")
    for d in range(1, depth + 1):
        step = frontier.join(arcs, frontier["id"] == arcs["a"]).select(F.col("b").alias("id")).distinct()
        frontier = materialize(step.join(seen, "id", "left_anti").withColumn("depth", F.lit(d)), "level")
        seen = seen.unionByName(frontier)
    return seen


def impact(edges: DataFrame, starts: DataFrame, depth: int, kind: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): what depends on starts, and every incoming edge of these nodes, those at the border included."""
    some = of_kinds(edges, kind)
    nodes = bfs(some, starts, "incoming", depth)
    return nodes, some.join(nodes.select(F.col("id").alias("to_id")), "to_id", "left_semi").dropDuplicates(["id"])


def context(edges: DataFrame, starts: DataFrame, depth: int, kind: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): what is around starts in both directions, and every edge that touches these nodes."""
    some = of_kinds(edges, kind)
    nodes = bfs(some, starts, "both", depth)
    touch = lambda c: some.join(nodes.select(F.col("id").alias(c)), c, "left_semi")
    return nodes, touch("to_id").unionByName(touch("from_id")).dropDuplicates(["id"])


def limited(nodes: DataFrame, edges: DataFrame, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """Nodes up to limit, nearest first; edges up to twice that."""
    return nodes.orderBy("depth", "id").limit(limit), edges.orderBy("id").limit(2 * limit)


def resolve(nodes: DataFrame, query: str) -> DataFrame:
    """The nodes a query means, by the first way that finds any: a file of this path, symbols by prefix, symbols by part."""
    name = F.col("name")
    is_path = F.lit("/" in query or "." in query)
    tier = F.when(is_path & (F.col("node_type") == "file") & (name == query), 0).when((F.col("node_type") == "symbol") & F.lower(name).startswith(query.lower()), 1).when((F.col("node_type") == "symbol") & name.ilike(f"%{query}%"), 2)
    rows = nodes.withColumn("tier", tier).where("tier IS NOT NULL")
    best = rows.agg(F.min("tier").alias("best"))
    return rows.crossJoin(F.broadcast(best)).where("tier = best").drop("best")


def adjacency(edges: DataFrame, node: str, direction: str, kind: str | None = None) -> DataFrame:
    return of_kinds(edges, kind).where(F.col("from_id" if direction == "outgoing" else "to_id") == node)


def with_names(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with their ends' names, unknown where there is no such node; an id that follows from the rest need not go through the joins."""
    n = nodes.select("id", "name")
    out = edges
    for end in ("from", "to"):
        out = out.join(n.select(F.col("id").alias(f"{end}_id"), F.col("name").alias(f"{end}_name")), f"{end}_id", "left_outer")
    return out.select(*(["id"] if "id" in edges.columns else []), "kind", "from_id", "to_id", F.coalesce("from_name", F.lit("unknown")).alias("from_name"), F.coalesce("to_name", F.lit("unknown")).alias("to_name"))


def with_sites(edges: DataFrame, sites: DataFrame) -> DataFrame:
    """Edges with their call sites (line, character), sorted; none is an empty array."""
    s = sites.groupBy("edge_id").agg(F.sort_array(F.collect_list(F.struct("line", "character"))).alias("sites"))
    out = edges.join(s, edges["id"] == s["edge_id"], "left_outer").drop("edge_id")
    return out.withColumn("sites", F.coalesce("sites", F.array().cast("array<struct<line:int,character:int>>")))


def shown(edges: DataFrame, groups: int = 10, each: int = 3) -> DataFrame:
    """At most each edges of each of the first groups of nodes."""
    w = Window.orderBy("from_id")
    rows = first_per_group(edges, ["from_id"], ["id"], each)
    few = rows.select("from_id").distinct().orderBy("from_id").limit(groups).withColumn("group", F.row_number().over(w))
    return rows.join(F.broadcast(few), "from_id")


def call_edges(symbols: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """symbols with sym_id, and calls with the ids of the caller and of what it calls.

    Symbols are never broadcast: as Parquet they are a fraction of what they are in memory, which Spark's limit doesn't see.
    """
    s = symbols.withColumn("sym_id", values.graph_id("s", F.col("path"), F.col("name"), F.col("sl"), F.col("sc")))
    caller = s.where(F.col("kind").isin("function", "method")).select(F.col("path").alias("cp"), F.col("name").alias("cn"), F.col("sym_id").alias("from_id")).hint("merge")
    callee = s.select(F.col("path").alias("tp"), F.col("name").alias("tn"), F.col("sym_id").alias("to_id")).hint("merge")
    c = calls.join(caller, (calls["path"] == F.col("cp")) & (calls["caller"] == F.col("cn"))).join(callee, (calls["to_path"] == F.col("tp")) & (calls["name"] == F.col("tn")))
    return s, c.withColumn("edge_kind", F.lit("calls"))


def build(files: DataFrame, symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """Edges from facts: files define their symbols; functions and methods call what their calls name."""
    s, c = call_edges(symbols, calls)
    d = s.join(files.select("path"), "path").select(F.lit("defines").alias("kind"), values.graph_id("f", F.col("path")).alias("from_id"), F.col("sym_id").alias("to_id"))
    out = d.unionByName(c.select(F.col("edge_kind").alias("kind"), "from_id", "to_id")).distinct().withColumn("id", values.graph_id("e", F.col("kind"), F.col("from_id"), F.col("to_id")))
    return out.withColumn("confidence", F.lit("high")).withColumn("provenance", F.lit("lsp"))


def build_sites(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """(edge_id, line, character): where the calls (.., line, character) of build()'s edges stand, each place once."""
    _, c = call_edges(symbols, calls)
    return c.select(values.graph_id("e", F.col("edge_kind"), F.col("from_id"), F.col("to_id")).alias("edge_id"), "line", "character").distinct()


def remove_file(files: DataFrame, symbols: DataFrame, edges: DataFrame, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files, symbols and edges without a file, its symbols, and the edges at either."""
    gone = symbols.where(F.col("path") == path).select("id").unionByName(files.where(F.col("path") == path).select("id"))
    left = edges.join(gone.select(F.col("id").alias("from_id")), "from_id", "left_anti").join(gone.select(F.col("id").alias("to_id")), "to_id", "left_anti")
    return files.where(F.col("path") != path), symbols.where(F.col("path") != path), left.select(edges.columns)
