"""Progress kept up to date while submissions stream in.

For every dataset row of a project, the stream's state knows who has annotated it, an entry each. What a batch adds,
new annotations and newly annotated rows, is committed to a store as counts, so that progress per project, user and row is
read without looking at annotations. Repeated, late and replayed submissions add nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from annolytics.streaming.store import FAN_IN, ProjectStore

PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COUNTS = ("project_progress", "user_progress", "row_progress")


def first_met(submissions: DataFrame) -> DataFrame:
    """The annotations of a stream that are new, ``(project_id, row_index, user_id)``, and with no user_id the rows that are newly annotated.

    Both are entries of one state, which is dealt out by all three columns: a row with many annotators lies in many tasks.
    """
    keyed = submissions.where("project_id IS NOT NULL AND row_index IS NOT NULL AND user_id IS NOT NULL")
    entry = F.explode(F.array(F.col("user_id"), F.lit(None).cast("string"))).alias("user_id")
    return keyed.select("project_id", "row_index", entry).dropDuplicates(["project_id", "row_index", "user_id"])


def progress_counts(new: DataFrame) -> dict[str, DataFrame]:
    """What the entries of first_met add to each table of counts."""
    one, made = F.lit(1).cast("bigint"), new.where("user_id IS NOT NULL")
    is_row = F.col("user_id").isNull().cast("bigint")
    return {
        "project_progress": new.select("project_id", is_row.alias("annotated_rows"), (1 - is_row).alias("total_annotations")),
        "user_progress": made.select("project_id", "user_id", one.alias("annotated_rows")),
        "row_progress": made.select("project_id", "row_index", one.alias("n_annotations")),
    }


def live_progress(submissions: DataFrame, root: str, checkpoint: str, available_now: bool = False, fan_in: int = FAN_IN) -> StreamingQuery:
    """Start keeping progress of a stream of submissions ``(project_id, row_index, user_id, ...)`` in the store at ``root``.

    All counts of a batch are one commit, and a batch that is run again, as after a lost driver, is committed once. Counts belong to
    their checkpoint: a stream that begins anew needs a new store. Projects deleted from the store are not counted again.
    """
    spark = submissions.sparkSession
    store = ProjectStore(spark, root, fan_in)
    new = first_met(submissions)

    def add(batch: DataFrame, batch_id: int) -> None:
        stored = batch.persist()
        try:
            store.upsert(progress_counts(stored), stream=checkpoint, batch=batch_id)
        finally:
            stored.unpersist()
        for table in COUNTS:
            store.compact(table)

    writer = new.writeStream.outputMode("append").foreachBatch(add).option("checkpointLocation", checkpoint)
    # A query keeps the settings it was started with.
    before = spark.conf.get(PROVIDER_KEY, None)
    spark.conf.set(PROVIDER_KEY, PROVIDER)
    try:
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        spark.conf.unset(PROVIDER_KEY) if before is None else spark.conf.set(PROVIDER_KEY, before)


def read_progress(spark: SparkSession, root: str, me: str) -> DataFrame:
    """Per project, as operators.status.progress gives it from annotations: rows annotated, by ``me``, and annotations."""
    store = ProjectStore(spark, root)
    snapshot = store.snapshot()
    mine = store.read("user_progress", snapshot).where(F.col("user_id") == me).select("project_id", F.col("annotated_rows").alias("annotated_by_me"))
    joined = store.read("project_progress", snapshot).join(mine, "project_id", "left")
    return joined.select("project_id", "annotated_rows", F.coalesce("annotated_by_me", F.lit(0)).cast("bigint").alias("annotated_by_me"), "total_annotations")
