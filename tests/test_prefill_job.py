"""Pre-labelling jobs that are stopped and called again."""

import json
import os
import time
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from annolytics.operators.prefill import Calls, run_model
from annolytics.streaming.prefill_job import answers_of, run_prefill_job
from annolytics.streaming.store import ProjectStore
from tests.test_writes import START


@pytest.fixture
def data(spark):
    return spark.range(60).select(F.col("id").alias("row_index"), (F.col("id") * 2).alias("n")).repartition(3)


def counted(folder, fails=lambda n: False, dies=lambda n: False):
    """A model that leaves a file for each call."""

    def model(row):
        with open(f"{folder}/{row['n']}-{uuid.uuid4().hex}", "w"):
            pass
        if dies(row["n"]):
            raise SystemExit("lost")
        if fails(row["n"]):
            raise ValueError("no answer")
        return {"half": row["n"] // 2}

    return model


def calls_of(folder):
    return Counter(int(name.split("-")[0]) for name in os.listdir(folder))


def labels(store):
    return {r.row_index: json.loads(r.data)["half"] for r in store.read("ml_annotations").where("annotator = 'm'").collect()}


def job_of(spark, tmp_path, data, model, now, **more):
    store = ProjectStore(spark, str(tmp_path / "store"))
    summary = run_prefill_job(data, store, model, "p", "m", now, str(tmp_path / "job"), file_rows=5, batch_files=2, **more).first()
    return store, tuple(summary)


def test_each_row_is_asked_once(spark, tmp_path, data, now):
    (tmp_path / "calls").mkdir()
    model = counted(tmp_path / "calls", fails=lambda n: n % 20 == 0)
    old = spark.createDataFrame([("p", 3, "old", "{}", START, 0), ("q", 4, "old", "{}", START, 0)], "project_id string, row_index bigint, annotator string, data string, ts timestamp_ntz, event_id bigint")
    ProjectStore(spark, str(tmp_path / "store")).upsert({"ml_annotations": old})
    for _ in range(2):
        store, summary = job_of(spark, tmp_path, data, model, now)
        assert summary == (60, 53, 6)
        assert labels(store) == {i: i for i in range(60) if i % 10 and i != 3}
    assert calls_of(tmp_path / "calls") == {2 * i: 1 for i in range(60) if i != 3}
    assert answers_of(spark, str(tmp_path / "job")).where("NOT ok").count() == 6


def test_a_job_that_dies_goes_on(spark, tmp_path, data, now):
    folder, flag = tmp_path / "calls", tmp_path / "flag"
    folder.mkdir()
    flag.touch()
    model = counted(folder, dies=lambda n: os.path.exists(flag) and len(os.listdir(folder)) > 25)
    with pytest.raises(Exception):
        job_of(spark, tmp_path, data, model, now)
    kept = labels(ProjectStore(spark, str(tmp_path / "store")))
    assert 0 < len(kept) < 60
    flag.unlink()
    asked = calls_of(folder)
    store, summary = job_of(spark, tmp_path, data, model, now)
    assert labels(store) == {i: i for i in range(60)} and summary == (60, 60, 0)
    again = calls_of(folder)
    # Rows of finished batches are not asked again, and no more than one batch of others.
    assert all(again[2 * i] == asked[2 * i] for i in kept)
    assert sum(again.values()) <= 60 + sum(n for v, n in asked.items() if v // 2 not in kept)
    assert sum(asked[v] > 0 and again[v] > asked[v] for v in asked) <= 10


def test_answers_that_were_stored_are_not_asked_for_again(spark, tmp_path, data, now, monkeypatch):
    folder = tmp_path / "calls"
    folder.mkdir()
    upsert = ProjectStore.upsert
    monkeypatch.setattr(ProjectStore, "upsert", lambda *a, **k: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(Exception, match="killed"):
        job_of(spark, tmp_path, data, counted(folder), now)
    monkeypatch.setattr(ProjectStore, "upsert", upsert)
    store, summary = job_of(spark, tmp_path, data, counted(folder), now)
    assert summary == (60, 60, 0) and set(calls_of(folder).values()) == {1} and len(labels(store)) == 60


def test_calls_side_by_side_with_attempts(spark, tmp_path):
    folder = tmp_path / "calls"
    folder.mkdir()

    def model(row):
        name = f"{folder}/{row['n']}"
        before = os.path.exists(name)
        open(name, "w").close()
        if row["n"] == 7:
            time.sleep(30)
        if not before:
            raise ValueError("first time")
        time.sleep(0.2)
        return {"n": row["n"]} if row["n"] != 3 else None

    rows = spark.range(16).select(F.col("id").alias("row_index"), F.col("id").alias("n")).coalesce(1)
    once = {r.row_index: r.data for r in run_model(rows.where("n = 1"), model, calls=Calls(at_once=2)).collect()}
    assert once == {1: None}
    got = {r.row_index: r.data for r in run_model(rows, model, calls=Calls(timeout_seconds=1.5, at_once=8, attempts=3, pause_seconds=0.05)).collect()}
    assert got == {i: None if i in (3, 7) else json.dumps({"n": i}) for i in range(16)}


def test_labels_of_many_batches_are_committed_together(spark, tmp_path, data, now, monkeypatch):
    """Six batches are one commit besides their answers; a later call with another size of batches goes on with the first."""
    folder, commits = tmp_path / "calls", []
    folder.mkdir()
    upsert = ProjectStore.upsert
    monkeypatch.setattr(ProjectStore, "upsert", lambda self, tables, **k: (commits.append(k["batch"]), upsert(self, tables, **k)))
    store, summary = job_of(spark, tmp_path, data, counted(folder), now)
    assert commits == [5] and summary == (60, 60, 0) and labels(store) == {i: i for i in range(60)}
    run_prefill_job(data, store, counted(folder), "p", "m", now, str(tmp_path / "job"), file_rows=5, batch_files=1)
    assert commits == [5] and set(calls_of(folder).values()) == {1}
