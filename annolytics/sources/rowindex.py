"""Row numbers: contiguous, 0-based, in file order, without a sort.

Every file split numbers its own rows; the counts per split, summed in path order, give each
split its first number. Only the list of splits is ever sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annolytics.plans.sizing import broadcast_if_small
from annolytics.session import settle


def _offsets(counted: DataFrame, *split: str) -> DataFrame:
    """The number of rows before each split. One row per split, settled so it is computed once."""
    before = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("_n").over(before), F.lit(0))
    return broadcast_if_small(settle(counted.withColumn("_offset", first).drop("_n"), "splits"))


def pin_splits(spark: SparkSession) -> None:
    """Keep later scans of this session cutting files as this one does.

    How files are cut depends on the number of cores, which changes when executors come and go.
    """
    key = "spark.sql.files.minPartitionNum"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, spark.sparkContext.defaultParallelism)


def _kept(df: DataFrame, file_col: str | None) -> list[str | Column]:
    return [*df.columns, *([F.col("_file").alias(file_col)] if file_col else [])]


def with_row_index(df: DataFrame, file_col: str | None = None) -> DataFrame:
    """Add ``row_index`` to a file scan of any format, and with ``file_col`` the address of each row's file.

    ``df`` comes straight from a reader. ``monotonically_increasing_id`` counts up within a split,
    so its distance from the split's first id is the row's place there. Both passes must cut the
    files alike: the cut is pinned, and a row whose split the first pass did not see is an error.
    """
    pin_splits(df.sparkSession)
    split: dict[str, Column] = {
        "_file": F.col("_metadata.file_path"),
        "_start": F.col("_metadata.file_block_start"),
        "_id": F.monotonically_increasing_id(),
    }
    base = df.withColumns(split)
    counted = base.groupBy("_file", "_start").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    known = F.coalesce("_offset", F.raise_error(F.lit("files were cut differently than when counted")).cast("bigint"))
    return (
        base.join(_offsets(counted, "_file", "_start"), ["_file", "_start"], "left")
        .select((known + F.col("_id") - F.col("_first")).cast("bigint").alias("row_index"), *_kept(df, file_col))
    )


def with_row_index_parquet(df: DataFrame, file_col: str | None = None) -> DataFrame:
    """Add ``row_index`` to a Parquet scan, whose rows know their place in the file, and with ``file_col`` its address.

    The first pass counts rows per file and reads no column.
    """
    base = df.withColumns({"_file": F.col("_metadata.file_path"), "_place": F.col("_metadata.row_index")})
    counted = df.select(F.col("_metadata.file_path").alias("_file")).groupBy("_file").agg(F.count("*").alias("_n"))
    return base.join(_offsets(counted, "_file"), "_file").select(
        (F.col("_offset") + F.col("_place")).cast("bigint").alias("row_index"), *_kept(df, file_col)
    )


def ingest(df: DataFrame, path: str, parquet: bool = False) -> None:
    """Number a dataset and store it. Later queries read the stored table only.

    Tasks write runs of consecutive numbers, so ranges of row_index skip row groups and files.
    """
    (with_row_index_parquet(df) if parquet else with_row_index(df)).write.mode("overwrite").parquet(path)
