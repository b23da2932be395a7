"""Running sums over all rows of a sorted table, or of each of its groups, without a single-task sort."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annolytics.session import settle


def partitions_for(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _local_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums before each row within its run of equal groups of this partition, carried over batches.

    A sorted partition has each group in one run; runs are numbered so that equal groups of
    other partitions can be told apart.
    """
    group, size_sum, count, run = None, 0, 0, -1
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        groups = batch.column("_group")
        size = batch.column("_amount").to_numpy()
        same = np.zeros(n, dtype=bool)
        if n > 1:
            same[1:] = pc.equal(groups.slice(1), groups.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        same[0] = groups[0].as_py() == group
        start = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
        before, index = np.cumsum(size) - size, np.arange(n)
        # Rows that go on with the run of the last batch add what it had; the others start afresh.
        carried = np.logical_and.accumulate(same)
        sums = np.where(carried, before + size_sum, before - before[start])
        counts = np.where(carried, index + count, index - start)
        runs = run + np.cumsum(~same)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(runs), pa.array(sums), pa.array(counts)],
            [*batch.schema.names, "_run", "_sum", "_count"],
        )
        group, run = groups[n - 1].as_py(), int(runs[-1])
        size_sum, count = int(sums[-1] + size[-1]), int(counts[-1]) + 1


def running_sums(df: DataFrame, group: str | None, order: Sequence[str], size: str, label: str) -> DataFrame:
    """Add ``before`` (sum of ``size`` of the earlier rows of the group) and ``position`` (their number).

    Rows are dealt out by range of ``(group, order)``, so one group, or the whole table, is
    spread over as many tasks as it needs. Each task streams over its sorted rows and keeps
    only running totals; the totals per partition and group are summed up in order, and
    joined back. A null group is a group. ``order`` must name every row apart, or rows that tie
    must be interchangeable. ``size`` must be a long without nulls.
    """
    spark = df.sparkSession
    key = F.lit("") if group is None else F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    keyed = df.select("*", key.alias("_group"), F.col(size).alias("_amount"))
    dealt = keyed.repartitionByRange(partitions_for(spark), "_group", *order).sortWithinPartitions("_group", *order)
    fields = [*dealt.schema.fields, *(T.StructField(c, T.LongType()) for c in ("_run", "_sum", "_count"))]
    local = dealt.mapInArrow(_local_sums, T.StructType(fields)).withColumn("_part", F.spark_partition_id().cast("bigint"))
    local = settle(local, label)
    totals = local.groupBy("_group", "_part", "_run").agg(F.sum("_amount").alias("s"), F.count("*").alias("n"))
    earlier = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_part",
        "_run",
        F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("_s"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_n"),
    )
    joined = local.join(settle(offsets, f"{label}-offsets"), ["_part", "_run"])
    return joined.select(
        *df.columns, (F.col("_sum") + F.col("_s")).alias("before"), (F.col("_count") + F.col("_n")).alias("position")
    )
