"""Writing annotations: upserts, model upserts, deletes and the label shown for a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolytics.plans.sizing import broadcast_if_small
from annolytics.session import settle

KEY = ["project_id", "row_index", "user_id"]
ML_KEY = ["project_id", "row_index"]

# Rows per storage block. A table is partitioned by project and row block, so one very large
# project spans many partitions and a merge rewrites only the blocks it touches.
ROW_BLOCK = 1_000_000
PARTITIONS = ["project_id", "row_block"]


def _states(submissions: DataFrame) -> DataFrame:
    """A submission as an upsert state: its time as the first one, and itself as the last."""
    return submissions.select(*KEY, F.col("ts").alias("created_at"), F.struct("ts", "event_id", "data").alias("last"))


def fold_submissions(submissions: DataFrame) -> DataFrame:
    """Upsert states per key; folding parts of a stream and then the parts is the same.

    ``submissions`` has ``project_id, row_index, user_id, data, ts`` and ``event_id``, which
    orders submissions of the same moment.
    """
    return merge_states(_states(submissions))


def merge_states(states: DataFrame) -> DataFrame:
    """First time and last submission per key. Both commute, so late data is safe.

    The last submission is one maximum, by time and event: its time need not be kept twice, so
    it crosses the shuffle once.
    """
    return states.groupBy(*KEY).agg(F.min("created_at").alias("created_at"), F.max("last").alias("last"))


def state_rows(states: DataFrame) -> DataFrame:
    """The annotation rows of merged states."""
    return states.select(*KEY, "created_at", F.col("last.ts").alias("updated_at"), F.col("last.data").alias("data"))


def annotation_upsert(submissions: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """The annotation table after the submissions: the first time is kept, the rest replaced.

    Old rows and submissions meet in one aggregate, so the merge costs one shuffle.
    """
    states = _states(submissions)
    if current is not None:
        # An old row comes ahead of every submission of the same moment.
        last = F.struct(F.col("updated_at").alias("ts"), F.lit(-1).cast("bigint").alias("event_id"), "data")
        states = current.select(*KEY, "created_at", last.alias("last")).unionByName(states)
    return state_rows(merge_states(states))


def ml_upsert(submissions: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """The model annotation table after the submissions: replaced whole, both times reset.

    ``submissions`` has ``project_id, row_index, annotator, data, ts`` and ``event_id``.
    """
    times = [F.col("ts").alias("created_at"), F.col("ts").alias("updated_at")]
    states = submissions.select(*ML_KEY, F.struct("ts", "event_id", "annotator", "data", *times).alias("last"))
    if current is not None:
        order = [F.col("updated_at").alias("ts"), F.lit(-1).cast("bigint").alias("event_id")]
        old = current.select(*ML_KEY, F.struct(*order, "annotator", "data", "created_at", "updated_at").alias("last"))
        states = old.unionByName(states)
    kept = [F.col(f"last.{c}").alias(c) for c in ("annotator", "data", "created_at", "updated_at")]
    return states.groupBy(*ML_KEY).agg(F.max("last").alias("last")).select(*ML_KEY, *kept)


def write_annotations(annotations: DataFrame, path: str) -> None:
    """Store an annotation table, partitioned by project and row block.

    Tasks take ranges of (project, row, user), so a file holds few neighbouring rows and a filter
    on row_index skips the others; a row with very many annotations still spans several tasks.
    """
    blocked = annotations.withColumn("row_block", F.floor(F.col("row_index") / ROW_BLOCK).cast("int"))
    (
        blocked.repartitionByRange(*KEY)
        .sortWithinPartitions(*KEY)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*PARTITIONS)
        .parquet(path)
    )


def read_annotations(spark, path: str) -> DataFrame:
    schema = (
        "row_index bigint, user_id string, created_at timestamp_ntz, updated_at timestamp_ntz, data string, "
        "project_id string, row_block int"
    )
    return spark.read.schema(schema).parquet(path)


def merge_into_table(submissions: DataFrame, path: str) -> None:
    """Upsert submissions into a stored table, rewriting only the partitions they touch.

    The merged partitions are written to the scratch folder first: the table is being read, and
    a lost executor must not find it half replaced. Partitions are replaced one by one; a store
    (streaming/store.py) commits a merge at once.
    """
    stored = read_annotations(submissions.sparkSession, path)
    block = F.floor(F.col("row_index") / ROW_BLOCK).cast("int").alias("row_block")
    # A row for each partition that is rewritten. Partitions it does not name are not opened.
    touched = settle(submissions.select("project_id", block).distinct(), "touched")
    current = stored.join(broadcast_if_small(touched), PARTITIONS, "left_semi").drop("row_block")
    write_annotations(settle(annotation_upsert(submissions, current), "merge"), path)


def cascade_delete(tables: dict[str, DataFrame], project_ids: DataFrame) -> dict[str, DataFrame]:
    """Every table, keyed by ``project_id``, without the rows of the given projects."""
    gone = project_ids.select("project_id").distinct()
    return {name: df.join(gone, "project_id", "left_anti") for name, df in tables.items()}


def effective_label(rows: DataFrame, annotations: DataFrame, ml_annotations: DataFrame, user_id: str) -> DataFrame:
    """The label shown for each row: the user's own, else the model's, else none."""
    own = annotations.where(F.col("user_id") == user_id).select("row_index", F.col("data").alias("_own"))
    model = ml_annotations.select("row_index", F.col("data").alias("_model"))
    return (
        rows.select("row_index")
        .join(own, "row_index", "left")
        .join(model, "row_index", "left")
        .select(
            "row_index",
            F.coalesce("_own", "_model").alias("data"),
            F.when(F.col("_own").isNotNull(), "human").when(F.col("_model").isNotNull(), "model").otherwise("none").alias("source"),
        )
    )
