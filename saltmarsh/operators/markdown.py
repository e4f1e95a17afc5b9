"""Results as Markdown, one text per result; lists are built by ordered aggregation, not on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _list(df: DataFrame, order: list[str], line) -> DataFrame:
    rows = df.agg(F.sort_array(F.collect_list(F.struct(*order, line.alias("_line")))).alias("l"))
    return rows.select(F.array_join(F.transform("l", lambda x: x["_line"]), "\n").alias("markdown"))


def references_summary(by_file: DataFrame) -> DataFrame:
    """For a page of (path, count): a line for each file, the most used first."""
    ranked = by_file.withColumn("_n", -F.col("count"))
    return _list(ranked, ["_n", "path"], F.format_string("- `%s`: %d", F.col("path"), F.col("count")))


def symbols_list(symbols: DataFrame) -> DataFrame:
    return _list(symbols, ["path", "line", "name"], F.format_string("- **%s** (%s) `%s:%d`", F.col("name"), F.col("kind"), F.col("path"), F.col("line")))


def diagnostics_report(counts: DataFrame) -> DataFrame:
    return _list(counts.where("path IS NOT NULL"), ["path"], F.format_string("- `%s`: %d errors, %d warnings", F.col("path"), F.col("error"), F.col("warning")))


def graph_report(edges: DataFrame) -> DataFrame:
    return _list(edges, ["from_name", "kind", "to_name"], F.format_string("- %s --%s--> %s", F.col("from_name"), F.col("kind"), F.col("to_name")))
