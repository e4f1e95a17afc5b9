"""Symbols: search with match kinds, deduplication, candidates in rank order, trees as adjacency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths, text, values
from .paging import first_per_group


def find(symbols: DataFrame, query: str, exact: bool = False) -> DataFrame:
    """symbols with match_kind and match_score; without a query all, with kind none; exact leaves exact matches only."""
    kind = text.match_kind(F.col("name"), query)
    out = symbols.withColumn("match_kind", kind)
    if query:
        out = out.where(F.col("match_kind") == "exact" if exact else F.col("match_kind") != "none")
    return out.withColumn("match_score", text.match_score(F.col("match_kind")))


def dedup(symbols: DataFrame, tie: list[str]) -> DataFrame:
    """One symbol for each name and base kind: a declaration before a re-export, then the first by tie."""
    base = F.replace(F.col("kind"), F.lit(" (re-export)"), F.lit(""))
    rows = symbols.withColumn("base_kind", base).withColumn("is_reexport", F.contains(F.col("kind"), F.lit("re-export")))
    return first_per_group(rows, ["name", "base_kind"], ["is_reexport", *tie])


def in_workspace(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """symbols whose path is a file of the workspace; all of them where the workspace is empty."""
    if not files.limit(1).count():
        return symbols
    return symbols.join(files.select("path"), "path", "left_semi")


def candidate_score(preferred: str | None):
    """Path asked for, inside or outside, match, kind, container; the larger the better."""
    kind = F.col("match_kind")
    return (
        (F.when(F.col("path") == preferred, 10_000).otherwise(0) if preferred else F.lit(0))
        + F.when(paths.is_in_node_modules(F.col("path")), -2_000).otherwise(2_000)
        + F.when(kind == "exact", 1_000).when(kind == "prefix", 800).when(kind == "substring", 600).when(kind == "fuzzy", 400).otherwise(0)
        + values.kind_weight(F.col("kind"))
        + F.when(F.col("container_name").isNotNull(), 100).otherwise(0)
    )



def candidates(symbols: DataFrame, query: str, preferred: str | None = None, alternates: int = 5, tie: str | None = None) -> DataFrame:
    """The chosen candidate (place 1) and alternates. Exact matches if any, else fuzzy ones; of these exact names if any, of these the path asked for if any.

    tie: a column that decides between candidates which are equal in all that counts.
    """
    order = [F.desc("score"), F.desc("scaled"), "line", "character", F.desc("path"), *([tie] if tie else [])]
    rows = find(symbols, query).withColumn("score", candidate_score(preferred)).withColumn("scaled", (F.col("match_score") * 1000).cast("int"))
    tier = F.when((F.col("match_kind") == "exact") & (F.col("name") == query) & (F.col("path") == F.lit(preferred)), 0).when((F.col("match_kind") == "exact") & (F.col("name") == query), 1).when(F.col("match_kind") == "exact", 2).otherwise(3)
    rows = rows.withColumn("tier", tier)
    best = rows.agg(F.min("tier").alias("best"))  # one row
    rows = rows.crossJoin(F.broadcast(best)).where(F.col("tier") == F.col("best"))
    top = rows.orderBy(*order).limit(1 + alternates)
    from pyspark.sql import Window

    return top.withColumn("place", F.row_number().over(Window.orderBy(*order))).drop("best", "scaled")


def top_level(symbols: DataFrame, include_locals: bool = False) -> DataFrame:
    return symbols if include_locals else symbols.where(F.col("container_name").isNull())


def without_children(symbols: DataFrame) -> DataFrame:
    return symbols.where(F.col("depth") == 0)


def flattened(symbols: DataFrame, post_order: bool = True) -> DataFrame:
    """A forest of symbols (path, id, sl, sc, el, ec) as a list, by ends (children before parents) or by starts."""
    order = [F.col("el"), F.col("ec"), F.col("sl").desc(), F.col("sc").desc()] if post_order else [F.col("sl"), F.col("sc"), F.col("el").desc(), F.col("ec").desc()]
    from pyspark.sql import Window

    return symbols.withColumn("place", F.row_number().over(Window.partitionBy("path").orderBy(*order, "id")))


def siblings(symbols: DataFrame, limit: int = 5) -> DataFrame:
    """The first few exports of each file, without builders' names."""
    return first_per_group(symbols.where(~text.is_builder_symbol(F.col("name"))), ["path"], ["ord"], limit)


def related(symbols: DataFrame, selected: str) -> DataFrame:
    return symbols.where(~F.col("rule_id").isin("local-variable", "all-identifiers") & (F.col("name") != selected))


def definition_order(external, span, path, line, char, ord_):
    return [external.asc(), span.desc(), path.asc(), line.asc(), char.asc(), ord_.asc()]


def overload_implementations(lines: DataFrame, within: int = 10) -> DataFrame:
    """(path, line_no, implementation): for each signature, the next line that is neither skipped nor a signature."""
    from pyspark.sql import Window

    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(1, within)
    real = F.when(~text.is_skippable_line(F.col("line")) & ~text.is_overload_signature(F.col("line")), F.col("line_no"))
    out = lines.withColumn("implementation", F.first(real, ignorenulls=True).over(w))
    return out.where(text.is_overload_signature(F.col("line"))).select("path", "line_no", "implementation")
