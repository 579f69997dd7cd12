"""Rows dealt out to tasks before work that takes long for each."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows of a task beyond which more tasks are made.
ROWS = 10_000


def spread(df: DataFrame, rows: int = ROWS) -> DataFrame:
    """The rows of a stored table dealt out evenly, about ``rows`` to a task and a task for each core at least.

    A row group of Parquet is read by one task, and a small file by one, however long the work on its rows takes.
    The rows are counted first, which reads no column.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(tasks)
