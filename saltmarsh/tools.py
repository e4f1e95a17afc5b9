"""The query API: one method per tool, over tables of facts; every answer is a DataFrame.

A Workspace holds DataFrames, of which a method uses those it needs:

files(path, content, language, is_external) · symbols(id, path, name, kind, sl, sc, el, ec, depth, container_name, ord,
rule_id) · identifiers(path, name, sl, sc, el, ec) · references(query_id, path, sl, sc, el, ec) ·
definitions(query_id, path, sl, sc, el, ec) · matches(path, rule_id, name, sl, sc, el, ec) · calls(query_id, direction,
path, line, name, kind, detail, sl, sc, ord) · hovers(path, line, character, markdown) ·
diagnostics(path, severity, message) · nodes(id, node_type, name) · edges(id, kind, from_id, to_id) ·
vectors(id, path, segment_hash, embedding, code, symbol, kind) · implementations(query_id, path, sl, sc, el, ec)

query_id names a symbol by its id. Language servers and parsers fill these tables; nothing here talks to one.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import paths, ranges, text, values
from .operators import graph, paging, positions, references, search, symbols, texts, usage
from .sources.work import materialize

# The tools, the presets that enable some, and those that no preset enables.
TOOLS = ["documentSymbol", "goToDefinition", "getSymbolDefinition", "findReferences", "hover", "findSymbol", "goToImplementation", "callHierarchy", "findReferencedSymbols", "findIdentifier", "listFiles", "readSourceCode", "health", "getDiagnostics", "initialSetup", "semanticSearch", "codemap"]
OPT_IN = ["semanticSearch", "codemap"]
PRESETS = {
    "minimal": ["goToDefinition", "findReferences", "hover", "getDiagnostics"],
    "standard": ["goToDefinition", "getSymbolDefinition", "findReferences", "hover", "getDiagnostics", "findSymbol", "documentSymbol", "callHierarchy", "findReferencedSymbols", "health", "initialSetup"],
    "full": [t for t in TOOLS if t not in OPT_IN],
}


def enabled_tools(preset: str = "standard", enable: list[str] = (), disable: list[str] = ()) -> list[str]:
    """What a preset and lists enable; a disabled tool stays disabled."""
    return usage.enabled(TOOLS, [*PRESETS[preset], *enable], list(disable))


#: Lines of a definition's source, at most.
MAX_SOURCE_LINES = 100
#: Rows of a page that are sent to all tasks, at most.
MAX_BESIDE = 10_000


@dataclass
class Workspace:
    files: DataFrame | None = None
    symbols: DataFrame | None = None
    identifiers: DataFrame | None = None
    references: DataFrame | None = None
    definitions: DataFrame | None = None
    matches: DataFrame | None = None
    calls: DataFrame | None = None
    hovers: DataFrame | None = None
    diagnostics: DataFrame | None = None
    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    vectors: DataFrame | None = None
    state: str = "Ready"
    implementations: DataFrame | None = None

    def _at(self, path: str, line: int, character: int) -> DataFrame:
        spark = self.symbols.sparkSession
        return spark.range(1).select(F.lit(0).alias("idx"), F.lit(path).alias("path"), F.lit(line).alias("line"), F.lit(character).alias("character"))

    def _selected(self, path: str, line: int, character: int) -> DataFrame:
        """The one symbol at a position (container, else nearest), with its id."""
        hit = positions.containers(self._at(path, line, character), self.symbols.where(F.col("path") == path), few=True).where("found <> 'none'").select("path", "name", "sl", "sc", "el", "ec")
        return self.symbols.join(F.broadcast(hit), ["path", "name", "sl", "sc", "el", "ec"]).orderBy("ord").limit(1)

    def _lines(self, keys: DataFrame, before: int, after: int, order: tuple[str, ...] = ("path", "sl", "sc")) -> DataFrame:
        """keys (path, sl, ..) with snippet: the lines around sl, read for a page's rows only."""
        src = self.files.select("path", F.split("content", "\n").alias("_l"))
        out = keys.join(src, "path", "left_outer")
        start = F.greatest(F.col("sl") - before, F.lit(1))
        return out.withColumn("snippet", F.array_join(F.slice("_l", start, F.greatest(F.col("sl") + after - start + 1, F.lit(0))), "\n")).drop("_l").orderBy(*order)

    def list_files(self, limit: int = paging.LIMIT, offset: int = 0) -> DataFrame:
        return paging.page(self.files.select("path"), ["path"], limit, offset)

    def read_source_code(self, path: str, *coordinates: int | None) -> DataFrame:
        return self.files.where(F.col("path") == path).select("path", texts.read_source(F.col("content"), *coordinates).alias("source"))

    def document_symbol(self, path: str, include_locals: bool = False, include_children: bool = False, limit: int = paging.LIMIT, offset: int = 0, context_lines: int = 1) -> DataFrame:
        rows = self.symbols.where(F.col("path") == path)
        rows = symbols.top_level(rows, include_locals)
        rows = rows if include_children else symbols.without_children(rows)
        return self._lines(paging.page(rows, ["sl", "sc", "name"], limit, offset), context_lines, context_lines)

    def find_symbol(self, query: str, exact: bool = False, limit: int = paging.LIMIT, offset: int = 0, context_lines: int = 1) -> DataFrame:
        rows = symbols.dedup(symbols.find(symbols.in_workspace(self.symbols, self.files), query, exact), ["path", "sl", "sc"])
        return self._lines(paging.page(rows, ["name", "kind"], limit, offset), context_lines, context_lines, ("name", "kind"))

    def get_symbol_definition(self, name: str, path: str) -> DataFrame:
        rows = self.symbols.where((F.col("name") == name) & (F.col("path") == path))
        src = self.files.select("path", F.split("content", "\n").alias("_l"))
        return rows.join(src, "path").withColumn("source", F.array_join(F.slice("_l", F.col("sl"), F.col("el") - F.col("sl") + 1), "\n")).drop("_l").orderBy("sl", "sc")

    def find_identifier(self, path: str, name: str, line: int | None = None, character: int | None = None, limit: int = paging.LIMIT, offset: int = 0) -> DataFrame:
        rows = self.identifiers.where((F.col("path") == path) & (F.col("name") == name))
        if line is not None and character is not None:
            at = self.identifiers.sparkSession.range(1).select(F.lit(0).alias("idx"), F.lit(path).alias("path"), F.lit(line).alias("line"), F.lit(character).alias("character"))
            return positions.identifiers_at(at, rows)
        return paging.page(rows, ["sl", "sc"], limit, offset)

    def selected_identifier(self, path: str, line: int, character: int) -> DataFrame:
        """(name, found): the identifier at a position or on its line, else the first word of its hover, else unknown."""
        at = self._at(path, line, character)
        hit = positions.identifiers_at(at, self.identifiers.where(F.col("path") == path)).select(F.when(F.col("tier") < 2, F.col("name")).alias("own"))
        out = hit
        if self.hovers is not None:
            words = self.hovers.where((F.col("path") == path) & (F.col("line") == line) & (F.col("character") == character))
            word = words.select(F.nullif(F.regexp_extract("markdown", r"[\p{L}\p{N}_]+", 0), F.lit("")).alias("word")).limit(1)
            out = hit.join(word, how="left_outer")
        else:
            out = hit.withColumn("word", F.lit(None).cast("string"))
        found = F.when(F.col("own").isNotNull(), "identifier").when(F.col("word").isNotNull(), "hover").otherwise("none")
        return out.select(F.coalesce("own", "word", F.lit("unknown")).alias("name"), found.alias("found"))

    def _beside(self, page: DataFrame) -> Workspace:
        """The files and symbols of a page's paths alone: the page is broadcast, which has few rows, never the tables."""
        here = F.broadcast(page.select("path").distinct())
        return replace(self, files=self.files.join(here, "path", "left_semi"), symbols=self.symbols.join(here, "path", "left_semi"))

    def _definition_source(self, rows: DataFrame) -> DataFrame:
        """rows (path, sl, sc, el, external, ..) with source: the symbol that stands there, else the definition with lines around it."""
        bounds = self.symbols.groupBy("path", "sl", "sc").agg(F.min("el").alias("_end"))
        src = self.files.select("path", F.split("content", "\n").alias("_l"))
        out = rows.join(bounds, ["path", "sl", "sc"], "left_outer").join(src, "path", "left_outer")
        start = F.when(F.col("_end").isNotNull(), F.col("sl")).otherwise(F.greatest(F.col("sl") - 3, F.lit(1)))
        last = F.coalesce("_end", F.col("el") + 10)
        most = F.least(F.greatest(last - start + 1, F.lit(0)), F.lit(MAX_SOURCE_LINES))
        return out.withColumn("source", F.array_join(F.slice("_l", start, most), "\n")).drop("_l", "_end")

    def go_to_definition(self, path: str, line: int, character: int, limit: int = paging.LIMIT, offset: int = 0) -> DataFrame:
        """Definitions of what stands at a position: inside first, larger first; each with the symbol found at its place, the lines around it and its source."""
        chosen = self._selected(path, line, character).select(F.col("id").alias("query_id"))
        d = self.definitions.join(F.broadcast(chosen), "query_id")
        span = ranges.span(*(F.col(c) for c in positions.RANGE))
        d = d.withColumn("external", paths.is_external_path(F.col("path"))).withColumn("span", span)
        page = paging.page(d, [F.col("external"), F.desc("span"), "path", "sl", "sc"], limit, offset)
        page = materialize(page.withColumn("id", F.concat_ws(":", "path", *positions.RANGE)), "page")
        at = self._beside(page) if limit <= MAX_BESIDE else self
        named = positions.definitions_to_symbols(page.select("id", "path", F.col("sl").alias("line"), F.col("sc").alias("character")), at.symbols.select("path", "name", "sl", "sc"))
        return at._lines(at._definition_source(page.join(named.select("id", "name", "exact").distinct(), "id").drop("id")), 1, 1)

    def definition_with_context(self, path: str, line: int, character: int, limit: int = paging.LIMIT, offset: int = 0) -> dict[str, DataFrame]:
        """selected: the identifier asked for; definitions with source and uses; siblings: the first exports beside the first definition."""
        d = self.go_to_definition(path, line, character, limit, offset)
        n = self.usage_counts() if self.references is not None else None
        d = d.join(F.broadcast(n.where(F.col("query_id").isin([r[0] for r in d.select("query_id").distinct().limit(1).collect()]))), "query_id", "left_outer") if n is not None else d
        first = d.orderBy("external", F.desc("span"), "path", "sl", "sc").limit(1).select("path", F.col("name").alias("_own"))
        rows = self.symbols.join(F.broadcast(first), "path").where(~F.col("name").eqNullSafe(F.col("_own"))).drop("_own")
        return {"selected": self.selected_identifier(path, line, character), "definitions": d, "siblings": symbols.siblings(symbols.related(rows, ""))}

    def go_to_implementation(self, path: str, line: int, character: int) -> DataFrame:
        """Where what stands at a position is implemented: every location, by path and place, with the identifier asked for."""
        chosen = F.broadcast(self._selected(path, line, character).select(F.col("id").alias("query_id")))
        rows = self.implementations.join(chosen, "query_id")
        name = self.selected_identifier(path, line, character).select(F.col("name").alias("selected"))
        return rows.crossJoin(F.broadcast(name)).orderBy("path", "sl", "sc")

    def find_references(self, symbol: str, path: str | None = None, detail: bool = False, file_limit: int = 10, limit: int | None = None, offset: int = 0, context_lines: int = 1) -> dict[str, DataFrame]:
        """candidates (chosen and alternates), counts by class, files by usage, and with detail a page of references."""
        known = self.symbols.withColumnRenamed("sl", "line").withColumnRenamed("sc", "character")
        cands = symbols.candidates(known, symbol, path)
        chosen = F.broadcast(cands.where("place = 1").select(F.col("id").alias("query_id")))
        own = self.definitions.join(chosen, "query_id")
        refs = self.references.join(chosen, "query_id").join(self.files.select("path"), "path", "left_semi")
        refs = self._lines(refs, 0, 0).withColumnRenamed("snippet", "line_text")
        classified = references.classify(refs, own)
        out = {"candidates": cands, "counts": references.class_counts(classified), "files": references.files_by_usage(classified, file_limit)}
        if detail:
            rows = classified.orderBy("path", "sl", "sc") if limit is None else paging.page(classified, ["path", "sl", "sc"], limit, offset)
            out["references"] = self._lines(rows, context_lines, context_lines)
        return out

    def find_referenced_symbols(self, path: str, line: int, character: int, full_scan: bool = False, externals: bool = False) -> DataFrame:
        chosen = self._selected(path, line, character)
        inside = positions.references_inside(self.matches.where(F.col("path") == path), chosen.select("path", "name", *positions.RANGE), full_scan)
        where = self.symbols.select(F.col("name"), F.col("id").alias("query_id")).join(self.definitions.select("query_id", "path", F.col("sl").alias("line")), "query_id").select(F.col("name").alias("query_id"), "path", "line")
        out = references.referenced_symbols(inside.select("name", F.col("name").alias("query_id")).distinct(), where, self.files)
        return (out if externals else out.where("status <> 'external'")).orderBy("path", "line")

    def call_hierarchy(self, path: str, line: int, character: int, direction: str, externals: bool = False) -> DataFrame:
        chosen = F.broadcast(self._selected(path, line, character).select(F.col("id").alias("query_id")))
        rows = self.calls.join(chosen, "query_id").where(F.col("direction") == direction)
        rows = references.mark_external(references.merge_calls(references.callable_only(rows)), self.files)
        rows = references.dedup_outgoing(rows) if direction == "outgoing" else rows
        return (rows if externals else references.internal(rows)).orderBy("path", "line")

    def hover(self, requests: str) -> DataFrame:
        """Answers of a JSON array of {path, line, character}, in its order, null where there is none."""
        spark = self.hovers.sparkSession
        rows = spark.range(1).select(F.posexplode(values.hover_requests(F.lit(requests))).alias("idx", "r")).select("idx", "r.*")
        out = rows.join(self.hovers, ["path", "line", "character"], "left_outer")
        return out.select("idx", "path", "line", "character", text.truncate_signature(text.hover_signature(F.col("markdown"), F.lit(""))).alias("signature"), text.hover_text(F.col("markdown")).alias("text")).orderBy("idx")

    def get_diagnostics(self, path: str | None = None) -> DataFrame:
        rows = self.diagnostics if path is None else self.diagnostics.where(F.col("path") == path)
        return references.severity_counts(rows, ["error", "warning", "information", "hint"])

    def semantic_search(self, embedding: list[float], query: str, limit: int = search.MAX_RESULTS, path: str | None = None, file_pattern: list[str] = (), exclude: list[str] = (), min_score: float = search.MIN_SCORE, per_file: bool = False, rerank: bool = True, context_lines: int | None = 15) -> DataFrame:
        q = self.vectors.sparkSession.createDataFrame([(0, [float(x) for x in embedding])], "qid int, q array<float>")
        facts = self.vectors.drop("embedding")
        known = search.allowed(self.vectors.select("id", "embedding"), search.filtered(facts, path) if path else None)
        out = search.with_facts(search.top_k(search.score(known, q).drop("embedding"), limit), facts)
        out = search.post_filter(out, max(min_score, search.MIN_SCORE), None, file_pattern, exclude)
        out = search.first_per_segment(search.rerank(out, query) if rerank else out)
        out = search.re_rank(search.best_per_file(out) if per_file else out)
        return out.withColumn("code", text.truncate_lines(F.col("code"), context_lines)).orderBy("rank")

    def codemap(self, mode: str, target: str | None = None, edge_type: str | None = None, depth: int = 2, limit: int = 50, scope: str = "", externals: bool = False) -> dict[str, DataFrame]:
        """overview: stats, modules, symbols. impact, context: nodes and edges with names around what the target means."""
        if mode == "overview":
            s = self.nodes.where("node_type = 'symbol'").select("id", "name")
            return {"stats": graph.stats(self.files, s, self.edges), "modules": graph.modules(self.files, self.symbols, scope, externals).orderBy("module").limit(limit), "symbols": graph.top_symbols(s, self.edges, limit)}
        starts = graph.resolve(self.nodes, target).orderBy("name", "id").limit(1).select("id")
        nodes, edges = (graph.impact if mode == "impact" else graph.context)(self.edges, starts, depth, edge_type)
        nodes, edges = graph.limited(nodes, edges, limit)
        return {"nodes": nodes, "edges": graph.with_names(edges, self.nodes)}

    def health(self) -> DataFrame:
        """(state, files, symbols, languages) of the workspace."""
        f = self.files.agg(F.count("*").alias("files"), F.sort_array(F.collect_set("language")).alias("languages"))
        return f.crossJoin(self.symbols.agg(F.count("*").alias("symbols"))).withColumn("state", F.lit(self.state))

    def related_symbols(self, path: str, line: int, character: int) -> DataFrame:
        """The first exports beside the symbol at a position, without builders' names."""
        one = F.broadcast(self._selected(path, line, character).select("path", F.col("name").alias("_own")))
        rows = self.symbols.join(one, "path").where(F.col("name") != F.col("_own"))
        return symbols.siblings(symbols.related(rows.drop("_own"), ""))

    def usage_counts(self) -> DataFrame:
        """(query_id, uses): references less the definition itself."""
        n = self.references.groupBy("query_id").agg(F.count("*").alias("n"))
        return n.select("query_id", references.usage_without_definition(F.col("n")).alias("uses"))

    def ranked_usage(self) -> DataFrame:
        w = Window.orderBy(F.desc("uses"), "query_id")
        return self.usage_counts().orderBy(F.desc("uses"), "query_id").limit(paging.LIMIT).withColumn("place", F.row_number().over(w))
