"""Broadcast only what is known to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT_BYTES = 64 << 20


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate; no job runs."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def broadcast_if_small(df: DataFrame, limit: int = LIMIT_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its plan is estimated below ``limit``; else a shuffled join stays possible."""
    return F.broadcast(df) if plan_bytes(df) <= limit else df
