"""Rows dealt to tasks by their number: partitions that go by bytes hold too many where rows are small or compress well."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows of a task, on average.
TASK_ROWS = 500_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df by hash of keys, in a task for every TASK_ROWS of rows (a number the caller knows), or as Spark finds best where these are few.

    Sides of a join that are dealt by the same rows and keys meet without another exchange.
    """
    if rows <= TASK_ROWS:
        return df.repartition(*keys)
    return df.repartition(max(-(-rows // TASK_ROWS), df.sparkSession.sparkContext.defaultParallelism), *keys)
