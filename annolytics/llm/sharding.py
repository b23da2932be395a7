"""Contiguous shards of near-equal bytes."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolytics.llm.prefix import running_sums
from annolytics.session import settle

#: Bytes counted for each row besides its text.
ROW_OVERHEAD = 16


def byte_size(text: Column) -> Column:
    """UTF-8 bytes of a text (a null has none) and a fixed share per row."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + ROW_OVERHEAD


def assign_shards(df: DataFrame, order: Sequence[str], size: str, n_shards: int) -> DataFrame:
    """Add ``shard`` and ``slot`` to every row of ``df``.

    The rows, sorted by ``order``, are laid end to end by their ``size``; shard k takes those
    whose middle lies in the k-th of ``n_shards`` equal stretches. Shards are contiguous, their
    sizes differ from the mean by at most half of the two rows at their ends, and ``slot``
    numbers a shard's rows from 0 without gaps. Totals per range partition give every
    row its global position, so no task sees more than its own range.

    ``size`` must be a positive long. Nulls come first in the order. Equal rows are
    interchangeable; rows that tie in ``order`` but differ are kept apart by their remaining columns, which must be of types that can be sorted. A
    row longer than a stretch leaves the shards it spans empty. An empty table gives an empty table. Columns
    named ``shard`` or ``slot`` are replaced. Pass narrow rows (ids and sizes): all columns are shuffled. The
    first slots that are broadcast are ``n_shards`` rows.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    keys = [F.col(f"`{c}`").alias(f"_key{i}") for i, c in enumerate([*order, *(c for c in df.columns if c not in order)])]
    rest = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_rest")
    rows = settle(df.select(rest, F.col(f"`{size}`").cast("bigint").alias("_size"), *keys, F.monotonically_increasing_id().alias("_row")), "shard-rows")
    names = [f"_key{i}" for i in range(len(keys))]
    placed = settle(running_sums(rows, None, [*names, "_row"], "_size", "shard-sums").drop(*names), "shard-placed")
    total = placed.agg(F.sum("_size")).first()[0] or 1
    # Decimals: at some petabytes the products would leave 64 bits.
    span = F.expr(f"cast((cast(before as decimal(20,0)) * 2 + _size) * {n_shards} div {2 * total} as int)")
    cut = placed.withColumn("shard", span)
    firsts = cut.groupBy("shard").agg(F.min("position").alias("_first"))
    numbered = cut.join(F.broadcast(firsts), "shard")
    kept = [F.col("_rest")[c].alias(c) for c in df.columns if c not in ("shard", "slot")]
    return numbered.select(*kept, "shard", (F.col("position") - F.col("_first")).alias("slot"))


def write_shards(df: DataFrame, assigned: DataFrame, key: str, path: str) -> None:
    """Write the rows of ``df`` as one folder per shard below ``path``, in slot order.

    ``assigned`` holds ``(key, shard, slot)`` with a unique ``key``. The rows of a shard are
    dealt out by ranges of slots, so that a shard is written by as many tasks as it has data for.
    """
    rows = df.join(assigned.select(key, "shard", "slot"), key)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(n, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_path(path: str, shard: int) -> str:
    return os.path.join(path, f"shard={shard}")
