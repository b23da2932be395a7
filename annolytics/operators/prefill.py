"""Pre-labelling rows with a model.

A model is either a column expression giving the annotation as JSON text (it stays in the JVM),
or a Python function from a row to an annotation. Both give null for a row they fail on.
"""

from __future__ import annotations

import json
import signal
import threading
import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annolytics.functions.literals import timestamp_literal
from annolytics.functions.text import NEGATIVE_WORDS, POSITIVE_WORDS, lexicon_sentiment, pick_text
from annolytics.operators.browse import distinct_rows
from annolytics.plans.sizing import spread_if_small
from annolytics.session import settle

ColumnModel = Column
PythonModel = Callable[[dict], dict | None]

ATTEMPT = "row_index bigint, data string"
# What a model may take for one row.
TIMEOUT_SECONDS = 15.0


class Calls(NamedTuple):
    """How a Python model is called: up to ``at_once`` rows of a task side by side, and up to ``attempts`` times for a row on which it
    raises or takes too long, after pauses of ``pause_seconds`` that double. An answer of none is an answer.
    """

    timeout_seconds: float = TIMEOUT_SECONDS
    at_once: int = 1
    attempts: int = 1
    pause_seconds: float = 0.5


def lexicon_model(
    schema: T.StructType, positive: Sequence[str] = POSITIVE_WORDS, negative: Sequence[str] = NEGATIVE_WORDS
) -> ColumnModel:
    """The built-in sentiment model as a column: ``{"sentiment": ...}`` of a row's text."""
    fields = T.StructType([f for f in schema.fields if f.name != "row_index"])
    sentiment = lexicon_sentiment(pick_text(fields), positive, negative)
    return F.to_json(F.struct(sentiment.alias("sentiment")))


def rows_to_prefill(dataset: DataFrame, ml_annotations: DataFrame, subset: DataFrame | None = None) -> DataFrame:
    """Rows without a model label, of all rows or of the given indices."""
    targets = dataset if subset is None else dataset.join(distinct_rows(subset), "row_index", "left_semi")
    return targets.join(distinct_rows(ml_annotations), "row_index", "left_anti")


def _give_up(signum, frame):
    raise TimeoutError("the model took too long")


def _by_alarm(model: PythonModel, row: dict, timeout_seconds: float) -> dict | None:
    """Call a model in the worker's main thread, and interrupt it by an alarm."""
    before = signal.signal(signal.SIGALRM, _give_up)
    signal.setitimer(signal.ITIMER_REAL, timeout_seconds)
    try:
        return model(row)
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def _by_thread(model: PythonModel, row: dict, timeout_seconds: float) -> dict | None:
    """Call a model in a thread of its own, which is left behind if it takes too long."""
    found: list = []

    def ask() -> None:
        try:
            found.append((model(row), None))
        except Exception as error:  # noqa: BLE001 - handed on below
            found.append((None, error))

    thread = threading.Thread(target=ask, daemon=True)
    thread.start()
    thread.join(timeout_seconds)
    if not found:
        raise TimeoutError("the model took too long")
    answer, error = found[0]
    if error is not None:
        raise error
    return answer


def _call(model: PythonModel, row: dict, calls: Calls) -> str | None:
    """The model's answer as JSON text; null if it has none, or fails or takes too long at every attempt."""
    for attempt in range(calls.attempts):
        if attempt:
            time.sleep(calls.pause_seconds * 2 ** (attempt - 1))
        try:
            annotation = (_by_alarm if calls.at_once == 1 else _by_thread)(model, row, calls.timeout_seconds)
            return None if annotation is None else json.dumps(annotation)
        except Exception:  # noqa: BLE001 - whatever a model raises counts as a failed attempt
            continue
    return None


def _plain(value):
    """Missing numbers as None."""
    return None if isinstance(value, float) and value != value else value


def run_model(
    rows: DataFrame,
    model: ColumnModel | PythonModel,
    columns: Sequence[str] | None = None,
    calls: Calls = Calls(),
) -> DataFrame:
    """``(row_index, data)`` for every row, ``data`` null where the model failed.

    A model sees only ``columns`` of each row. A Python model gets them as Python values, lists
    and structs included, from Arrow batches, and is called as ``calls`` says; a row on which it
    takes too long counts as failed.
    """
    inputs = list(columns or [c for c in rows.columns if c != "row_index"])
    rows = spread_if_small(rows.select("row_index", *inputs))
    if isinstance(model, Column):
        return rows.select("row_index", model.alias("data"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows_in = [{name: _plain(value) for name, value in row.items()} for row in batch.select(inputs).to_pylist()]
            if calls.at_once == 1:
                data = [_call(model, row, calls) for row in rows_in]
            else:
                with ThreadPoolExecutor(calls.at_once) as pool:
                    data = list(pool.map(lambda row: _call(model, row, calls), rows_in))
            yield pa.RecordBatch.from_arrays([batch.column("row_index"), pa.array(data, pa.string())], ["row_index", "data"])

    return rows.mapInArrow(predict, ATTEMPT)


def prefill_batch(
    dataset: DataFrame,
    ml_annotations: DataFrame,
    model: ColumnModel | PythonModel,
    project_id: str,
    annotator: str,
    now: datetime,
    subset: DataFrame | None = None,
    enabled: bool = True,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """One row per attempt: the new model annotation, or ``ok = false`` for a failed row.

    Rows that have a label are skipped. Rows with ``ok`` are the ones to store.
    """
    todo = rows_to_prefill(dataset, ml_annotations, subset)
    if not enabled:
        todo = todo.where(F.lit(False))
    made = F.when(F.col("data").isNotNull(), timestamp_literal(now))
    return run_model(todo, model, columns).select(
        F.lit(project_id).alias("project_id"),
        "row_index",
        F.lit(annotator).alias("annotator"),
        "data",
        made.alias("created_at"),
        made.alias("updated_at"),
        F.col("data").isNotNull().alias("ok"),
    )


def prefill_summary(targets: DataFrame, attempts: DataFrame, enabled: bool = True) -> DataFrame:
    """``total`` (skipped rows included), ``succeeded`` and ``failed``, in one aggregate."""
    if not enabled:
        targets, attempts = targets.where(F.lit(False)), attempts.where(F.lit(False))
    kinds = targets.select(F.lit("target").alias("kind")).unionByName(
        attempts.select(F.when(F.col("ok"), "ok").otherwise("failed").alias("kind"))
    )
    return kinds.agg(
        F.count_if(F.col("kind") == "target").alias("total"),
        F.count_if(F.col("kind") == "ok").alias("succeeded"),
        F.count_if(F.col("kind") == "failed").alias("failed"),
    )


def run_prefill(
    dataset: DataFrame,
    ml_path: str,
    model: ColumnModel | PythonModel,
    project_id: str,
    annotator: str,
    now: datetime,
    subset: DataFrame | None = None,
    enabled: bool = True,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Pre-label a project's rows into its stored model annotations, and sum up what happened.

    The attempts are written once before they are used, so no row is sent to the model twice.
    """
    spark = dataset.sparkSession
    stored = spark.read.parquet(ml_path)
    labelled = stored.where(F.col("project_id") == project_id)
    attempts = settle(
        prefill_batch(dataset, labelled, model, project_id, annotator, now, subset, enabled, columns), "attempts"
    )
    _add_labels(attempts.where("ok").select(*stored.columns), ml_path)
    targets = dataset if subset is None else distinct_rows(subset)
    return prefill_summary(targets, attempts, enabled)


def prefill_lookup(
    requests: DataFrame,
    dataset: DataFrame,
    ml_annotations: DataFrame,
    model: ColumnModel | PythonModel,
    annotator: str,
    enabled: bool = True,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Requested rows with their stored model label, or a label computed now.

    ``(row_index, data, annotator, source)`` with source ``stored``, ``computed`` or ``none``, for
    every requested row, also one that the dataset lacks. Each missing row is computed once,
    however often it is requested. ``stored_lookup`` keeps what it computes.
    """
    wanted = distinct_rows(requests)
    if not enabled:
        nothing = F.lit(None).cast("string")
        return wanted.select("row_index", nothing.alias("data"), nothing.alias("annotator"), F.lit("none").alias("source"))
    stored = ml_annotations.join(wanted, "row_index", "left_semi").select(
        "row_index", "data", "annotator", F.lit("stored").alias("source")
    )
    fresh = run_model(rows_to_prefill(dataset, ml_annotations, requests), model, columns).where("data IS NOT NULL")
    computed = fresh.select("row_index", "data", F.lit(annotator).alias("annotator"), F.lit("computed").alias("source"))
    known = stored.unionByName(computed)
    return wanted.join(known, "row_index", "left").select("row_index", "data", "annotator", F.coalesce("source", F.lit("none")).alias("source"))


def stored_lookup(
    requests: DataFrame,
    dataset: DataFrame,
    ml_path: str,
    model: ColumnModel | PythonModel,
    project_id: str,
    annotator: str,
    now: datetime,
    enabled: bool = True,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """``prefill_lookup`` over a project's stored model annotations, to which what it computes is added.

    The answer is stored before it is used, so the model is asked once, and a second call finds
    what the first has computed.
    """
    spark = dataset.sparkSession
    stored = spark.read.parquet(ml_path)
    labelled = stored.where(F.col("project_id") == project_id)
    answer = settle(prefill_lookup(requests, dataset, labelled, model, annotator, enabled, columns), "lookup")
    made = timestamp_literal(now)
    fresh = answer.where(F.col("source") == "computed").select(
        F.lit(project_id).alias("project_id"), "row_index", "annotator", "data", made.alias("created_at"), made.alias("updated_at")
    )
    _add_labels(fresh.select(*stored.columns), ml_path)
    return answer


def _add_labels(labels: DataFrame, ml_path: str) -> None:
    """Add labels of rows that have none. A row that another run has labelled meanwhile keeps that label."""
    stored = labels.sparkSession.read.parquet(ml_path)
    new = labels.join(stored.select("project_id", "row_index"), ["project_id", "row_index"], "left_anti")
    settle(new, "labels").write.mode("append").parquet(ml_path)
