"""Tables laid out for joins on row_index that move no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame


def save_bucketed(df: DataFrame, name: str, path: str, buckets: int, key: str = "row_index") -> DataFrame:
    """Store ``df`` as table ``name``, hashed on ``key`` into ``buckets`` sorted files.

    A dataset and its model annotations stored with the same number of buckets are joined bucket
    by bucket, so pre-labelling or looking up rows never shuffles their texts. About a gigabyte
    per bucket is a good size. Not for a key one value of which holds much of the table: bucket
    tables keyed by row, which hold each row once.
    """
    (
        df.repartition(buckets, key)
        .write.bucketBy(buckets, key)
        .sortBy(key)
        .option("path", path)
        .mode("overwrite")
        .saveAsTable(name)
    )
    return df.sparkSession.table(name)
