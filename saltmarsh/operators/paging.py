"""Ordering, pages, ranks and per-group caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LIMIT, OFFSET = 200, 0


def page(df: DataFrame, order: list, limit: int = LIMIT, offset: int = OFFSET) -> DataFrame:
    """Rows offset .. offset + limit of a total order; a limited sort, never a sort of all rows to one task."""
    return df.orderBy(*order).offset(offset).limit(limit) if offset else df.orderBy(*order).limit(limit)


def truncated(total: Column, limit: int = LIMIT, offset: int = OFFSET) -> Column:
    """Whether rows are left after the page; false where the page begins past the end."""
    return F.least(F.lit(offset + limit).cast("long"), total.cast("long")) < total


def page_info(df: DataFrame, limit: int = LIMIT, offset: int = OFFSET) -> DataFrame:
    t = df.agg(F.count("*").alias("total"))
    return t.select("total", F.lit(offset).alias("offset"), F.lit(limit).alias("limit"), F.greatest(F.lit(0), F.least(F.lit(limit), F.col("total") - offset)).cast("long").alias("returned"), truncated(F.col("total"), limit, offset).alias("truncated"))


def first_per_group(df: DataFrame, keys: list, order: list, n: int = 1) -> DataFrame:
    """The first n rows of each group; Spark keeps n rows a task before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def ranked(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """1-based places in a total order; for results that are already few (a page, a top-k)."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def context_windows(lines: DataFrame, before: int, after: int, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """(keys, line_no, context): each line with its neighbours, cut at the file's ends."""
    w = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(-before, after)
    return lines.select(*keys, "line_no", F.array_join(F.collect_list("line").over(w), "\n").alias("context"))
