"""Broadcasts behind a check of their size, and rows dealt to tasks before they multiply."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a table of a few narrow columns is handed to every task.
FEW_ROWS = 200_000


def checked_broadcast(df: DataFrame, rows: int = FEW_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows; else as it is, for the optimizer to place."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def dealt(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in as many partitions as leave each about ``rows`` rows: for rows that the next step multiplies, since a file may be read by one task."""
    return df.repartition(max(1, -(-df.count() // rows)))
