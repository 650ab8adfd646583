"""Broadcasts behind a check of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def broadcast_below(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows, else as it is: the planner then shuffles.

    ``df`` should be cheap to count: a table, or something written by ``durable``.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
