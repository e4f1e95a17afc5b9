"""Ranges of a numeric key for dealing out rows in order with one exchange, and running totals over ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bounds that come to the driver, whatever the table's size; each range is cut evenly into as many as the partitions need.
QUANTILES = 128


def _tree(k: Column, bounds: list[int], sub: int, lo: int = 0) -> Column:
    if len(bounds) == 2:
        a, b = bounds
        within = F.floor((k.cast("double") - a) / max(1, b - a) * sub)
        return F.lit(lo * sub).cast("long") + F.greatest(F.lit(0), F.least(F.lit(sub - 1), within))
    mid = len(bounds) // 2
    return F.when(k < bounds[mid], _tree(k, bounds[: mid + 1], sub, lo)).otherwise(_tree(k, bounds[mid:], sub, lo + mid))


def range_of(df: DataFrame, key: str, per_partition: int = 16) -> Column:
    """The number of the range that a row's key is in, ascending with the key; null keys are in a last range of their own."""
    bounds = sorted({int(x) for x in df.stat.approxQuantile(key, [k / QUANTILES for k in range(QUANTILES + 1)], 0.5 / QUANTILES)})
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sub = max(1, -(-per_partition * parts // max(1, len(bounds) - 1)))
    k = F.col(key).cast("long")
    tree = _tree(k, bounds, sub) if len(bounds) > 1 else F.lit(0).cast("long")
    return F.when(k.isNull(), F.lit(len(bounds) * sub).cast("long")).otherwise(tree)


def running_totals(sums: DataFrame, part: str, step: str, value: str) -> DataFrame:
    """(part, step, before): the sum of value over all rows before, by part, then step. Only one row per part is ordered globally."""
    parts = sums.groupBy(part).agg(F.sum(value).alias("_n"))
    parts = parts.select(part, F.coalesce(F.sum("_n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    within = F.coalesce(F.sum(value).over(Window.partitionBy(part).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sums.withColumn("_within", within).join(parts, part).select(part, step, (F.col("_base") + F.col("_within")).cast("long").alias("before"))
