"""Pre-labelling that goes on where it was stopped.

The rows to label are written once, as files of a bounded number of rows, and are then asked about batch by batch: each asks the model and stores
the answers, and the labels of several batches are committed together. A job that dies keeps all answers of finished batches, and begins again with the batch it was at.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolytics.functions.literals import timestamp_literal
from annolytics.operators.browse import distinct_rows
from annolytics.operators.prefill import ATTEMPT, Calls, ColumnModel, PythonModel, prefill_summary, rows_to_prefill, run_model
from annolytics.streaming.store import ProjectStore

#: Rows of a file of work, and files of a batch: what is asked again at most if a job dies.
FILE_ROWS = 1000
BATCH_FILES = 32
#: Batches whose labels, stored as answers by then, are committed to the store together.
COMMIT_BATCHES = 16


def _is_written(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def run_prefill_job(
    dataset: DataFrame,
    store: ProjectStore,
    model: ColumnModel | PythonModel,
    project_id: str,
    annotator: str,
    now: datetime,
    job: str,
    subset: DataFrame | None = None,
    columns: Sequence[str] | None = None,
    calls: Calls = Calls(),
    file_rows: int = FILE_ROWS,
    batch_files: int = BATCH_FILES,
) -> DataFrame:
    """Label a project's rows that have no model label, into the store; the summary of prefill_summary.

    ``job`` is a folder of this run alone, on storage that all executors share: called again with it, the run goes on. Rows are chosen once, when it begins.
    A model's labels are in the store at every COMMIT_BATCHES batches, and when the job ends or fails; those of a job that was killed, when it is called again.
    A row is asked once, or up to ``calls.attempts`` times where the model fails; only the rows of the batch that a job
    died in are asked again, unless their answers were stored already. A row that got a label elsewhere meanwhile gets the later of the two.
    """
    spark = dataset.sparkSession
    inputs = list(columns or [c for c in dataset.columns if c != "row_index"])
    todo = f"{job}/todo"
    if not _is_written(spark, todo):
        labelled = store.read("ml_annotations").where(F.col("project_id") == project_id)
        chosen = rows_to_prefill(dataset, labelled, subset).select("row_index", *inputs)
        chosen.write.mode("overwrite").option("maxRecordsPerFile", file_rows).parquet(todo)
    schema = dataset.select("row_index", *inputs).schema
    batches = _dealt(spark, job, batch_files)

    def answer(batch: list[str], batch_id: int) -> None:
        answers = f"{job}/answered/batch={batch_id}"
        if not _is_written(spark, answers):
            run_model(spark.read.schema(schema).parquet(*batch), model, inputs, calls).write.mode("overwrite").parquet(answers)

    def commit(batch_ids: Sequence[int]) -> None:
        made = _answers(spark, job, batch_ids).where("data IS NOT NULL")
        labels = made.select(
            F.lit(project_id).alias("project_id"), "row_index", F.lit(annotator).alias("annotator"), "data",
            timestamp_literal(now).alias("ts"), F.col("batch").alias("event_id"),
        )
        store.upsert({"ml_annotations": labels}, stream=job, batch=batch_ids[-1])
        store.compact("ml_annotations")

    first, answered = store.snapshot().batches.get(job, -1) + 1, []
    try:
        for batch_id in range(first, len(batches)):
            answer(batches[batch_id], batch_id)
            answered.append(batch_id)
            if len(answered) == COMMIT_BATCHES:
                done, answered = answered, []
                commit(done)
    finally:
        if answered:
            commit(answered)
    targets = dataset if subset is None else distinct_rows(subset)
    return prefill_summary(targets, answers_of(spark, job))


def _dealt(spark: SparkSession, job: str, batch_files: int) -> list[list[str]]:
    """The files of work of each batch, by name. How many make a batch is settled when the job begins."""
    sizes = f"{job}/batches"
    if not _is_written(spark, sizes):
        spark.createDataFrame([(batch_files,)], "files int").coalesce(1).write.mode("overwrite").json(sizes)
    size = spark.read.schema("files int").json(sizes).first()["files"]
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{job}/todo")
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    names = sorted(name for status in found if (name := status.getPath().getName()).endswith(".parquet"))
    return [[f"{job}/todo/{name}" for name in names[at : at + size]] for at in range(0, len(names), size)]


def _answers(spark: SparkSession, job: str, batch_ids: Sequence[int]) -> DataFrame:
    """``(row_index, data, batch)`` of some batches."""
    folders = [f"{job}/answered/batch={batch_id}" for batch_id in batch_ids]
    return spark.read.schema(f"{ATTEMPT}, batch bigint").option("basePath", f"{job}/answered").parquet(*folders)


def answers_of(spark: SparkSession, job: str) -> DataFrame:
    """``(row_index, data, ok)`` of all rows a job has asked about so far."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{job}/answered")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        found = spark.createDataFrame([], ATTEMPT)
    else:
        found = spark.read.schema(ATTEMPT).option("basePath", f"{job}/answered").parquet(f"{job}/answered/batch=*").drop("batch")
    return found.withColumn("ok", F.col("data").isNotNull())
