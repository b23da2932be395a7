"""Broadcasts and repartitions that depend on a measured size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 2_000_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when ``df`` has at most ``max_rows`` rows, else leave the join to Spark.

    The count stops at ``max_rows + 1`` rows. Meant for settled tables of narrow rows (keys and
    numbers), where counting is a footer read and the row bound is also a byte bound.
    """
    small = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if small else df


def planned_bytes(df: DataFrame) -> int:
    """Spark's own upper estimate of a plan's output, from file sizes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread_if_small(df: DataFrame, bytes_per_core: int = 128 * 1024 * 1024) -> DataFrame:
    """Spread rows over all cores when there is less than one scan split of input per core.

    Input of one file may come as one split and leave every other core idle under costly work.
    Above the bound the scan has splits enough and the rows stay where they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if planned_bytes(df) < cores * bytes_per_core else df
