"""Positions within groups without sorting a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annolytics.plans.sizing import broadcast_if_small
from annolytics.session import settle

BLOCK = 100_000


def blocked_positions(
    df: DataFrame, keys: Sequence[str], order_col: str, name: str = "position", block: int = BLOCK
) -> DataFrame:
    """Add the 0-based position of each row in its group, ordered by an integer column.

    ``order_col`` must be unique within a group. Rows are cut into blocks ``order_col div block``,
    so one block holds at most ``block`` rows of a group however many the group has. A count per
    block and a running sum over the (few) blocks give each block its offset; only the rows of
    one block are ever sorted together.
    """
    keys = list(keys)
    cut = df.withColumn("_block", F.floor(F.col(order_col) / F.lit(block)).cast("bigint"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(*keys, "_block")
        .agg(F.count("*").alias("_n"))
        .select(*keys, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(order_col)
    return (
        cut.withColumn("_rank", F.row_number().over(inside) - 1)
        .join(offsets, [*keys, "_block"])
        .withColumn(name, (F.col("_offset") + F.col("_rank")).cast("bigint"))
        .drop("_block", "_offset", "_rank")
    )


def ranged_positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "position") -> DataFrame:
    """Add the 0-based position of each row in its group, ordered by columns of any type.

    Rows are dealt out by range of group and order, stored, and ranked within each group's part of a range. Only
    groups that lie in several ranges need offsets, and there are at most as many of them as ranges.
    Rows that tie in ``order`` get different positions.
    """
    keys, order = list(keys), list(order)
    dealt = settle(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*keys)
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spread = counts.withColumns({"_parts": F.count("*").over(group), "_offset": F.sum("_n").over(before)})
    offsets = settle(spread.where("_parts > 1 AND _offset > 0").select(*keys, "_part", "_offset"), "range-offsets")
    inside = Window.partitionBy(*keys, "_part").orderBy(*order)
    ranked = dealt.withColumn("_rank", F.row_number().over(inside) - 1)
    joined = ranked.join(broadcast_if_small(offsets), [*keys, "_part"], "left")
    return joined.select(*df.columns, (F.col("_rank") + F.coalesce("_offset", F.lit(0))).cast("bigint").alias(name))
