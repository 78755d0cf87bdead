"""Rows dealt so that a task's share does not grow with the table."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows that a task sorts or groups at once.
ROWS = 1_000_000


def spread(df: DataFrame, by: list[str], rows_a_task: int = ROWS) -> DataFrame:
    """df dealt by the keys `by`, about `rows_a_task` rows a task; df itself where the session's shuffle partitions suffice.

    Counts df once, which for a column of a Parquet table reads its footers only. Every key must have few rows."""
    parts = -(-df.count() // rows_a_task)
    return df if parts <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(parts, *by)


def dealt(df: DataFrame, rows_a_task: int = ROWS) -> DataFrame:
    """df in equal parts of at most about `rows_a_task` rows, however its files are cut; df itself if it has no more rows than that.

    For rows of numbers or texts without keys. Each part is sorted by all columns, so that reruns see the same rows in the same order."""
    parts = -(-df.count() // rows_a_task)
    return df if parts <= 1 else df.repartition(max(parts, df.sparkSession.sparkContext.defaultParallelism)).sortWithinPartitions(*df.columns)
