"""Commits to a store: all or nothing, none lost, folders few."""

from concurrent.futures import ThreadPoolExecutor
from datetime import timedelta
from pathlib import Path

import pytest

from annolytics.sources import snapshots
from annolytics.sources.snapshots import commit, latest_snapshot
from annolytics.streaming.store import ProjectStore
from tests.test_writes import START, SUBMISSION, as_table, by_hand, submissions


def frames(spark, rows, parts):
    return [(rows[i::parts], spark.createDataFrame(rows[i::parts], SUBMISSION)) for i in range(parts)]


def test_folders_grow_with_the_logarithm(spark, tmp_path):
    rows, store = submissions(200, seed=2), ProjectStore(spark, str(tmp_path), fan_in=3)
    done = []
    for part, df in frames(spark, rows, 14):
        store.upsert({"annotations": df})
        store.compact("annotations")
        done += part
    held = store.snapshot().of("annotations")
    # 14 is 112 in base 3.
    assert [s.tier for s in held] == [2, 1, 0, 0]
    assert [s.first for s in held] == sorted(s.first for s in held)
    assert as_table(store.read("annotations")) == by_hand(rows)


def test_a_reader_sees_one_snapshot(spark, tmp_path):
    first, second = submissions(60, seed=3), [(*r[:5], r[5] + 1000) for r in submissions(60, seed=4)]
    store = ProjectStore(spark, str(tmp_path), fan_in=2)
    store.upsert({"annotations": spark.createDataFrame(first, SUBMISSION)})
    before = store.snapshot()
    old = store.read("annotations", before)
    store.upsert({"annotations": spark.createDataFrame(second, SUBMISSION)})
    assert store.compact("annotations") == 1
    store.delete_projects(spark.createDataFrame([("p0",)], "project_id string"))
    assert as_table(old) == by_hand(first) == as_table(store.read("annotations", before))
    assert as_table(store.read("annotations")) == {k: v for k, v in by_hand(first + second).items() if k[0] != "p0"}


def test_merges_at_once_lose_nothing(spark, tmp_path):
    rows = submissions(160, seed=5)
    store = ProjectStore(spark, str(tmp_path), fan_in=3)

    def one(part):
        store.upsert({"annotations": part[1]})
        store.compact("annotations")

    with ThreadPoolExecutor(6) as pool:
        list(pool.map(one, frames(spark, rows, 8)))
    assert as_table(store.read("annotations")) == by_hand(rows)
    covered = store.snapshot().of("annotations")
    assert all(a.last < b.first for a, b in zip(covered, covered[1:]))


def test_a_job_that_dies_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    rows = submissions(60, seed=6)
    store = ProjectStore(spark, str(tmp_path), fan_in=2)
    store.upsert({"annotations": spark.createDataFrame(rows, SUBMISSION)})
    monkeypatch.setattr(snapshots, "_publish", lambda *a: (_ for _ in ()).throw(OSError("killed")))
    for act in (
        lambda: store.upsert({"annotations": spark.createDataFrame(submissions(9, seed=7), SUBMISSION)}),
        lambda: store.delete_projects(spark.createDataFrame([("p0",)], "project_id string")),
    ):
        with pytest.raises(OSError, match="killed"):
            act()
    monkeypatch.undo()
    assert len(list(Path(tmp_path, "data").iterdir())) == 3
    assert as_table(store.read("annotations")) == by_hand(rows) and store.snapshot().version == 1


def test_deletes_hold_through_merges_and_end_with_new_rows(spark, tmp_path):
    early = submissions(60, seed=8)
    store = ProjectStore(spark, str(tmp_path), fan_in=2)
    later = [("p0", 1, "u1", "{}", START + timedelta(days=3), 7000), ("p1", 1, "u1", "{}", START + timedelta(days=3), 7001)]
    store.upsert({"annotations": spark.createDataFrame(early, SUBMISSION)})
    store.delete_projects(spark.createDataFrame([("p0",), ("p0",), ("none",)], "project_id string"))
    store.upsert({"annotations": spark.createDataFrame(later, SUBMISSION)})
    want = by_hand([r for r in early if r[0] != "p0"] + later)
    assert as_table(store.read("annotations")) == want
    store.compact("annotations")
    assert as_table(store.read("annotations")) == want
    # The deletion has nothing left to delete.
    assert [s.table for s in store.snapshot().segments] == ["annotations"]
    store.delete_projects(spark.createDataFrame([("p1",)], "project_id string"))
    assert {r.project_id for r in store.read("annotations").collect()} == {r[0] for r in want} - {"p1"}


def test_all_tables_of_a_delete_go_at_once(spark, tmp_path):
    store = ProjectStore(spark, str(tmp_path))
    people = spark.createDataFrame([("p1", "a", "annotator", START, 1), ("p2", "a", "annotator", START, 1), ("p2", "a", "project_admin", START, 2)], "project_id string, user_id string, role string, ts timestamp_ntz, event_id bigint")
    named = spark.createDataFrame([("p1", "one", "t", START, 1), ("p2", "two", None, START, 1)], "project_id string, name string, tags string, ts timestamp_ntz, event_id bigint")
    store.upsert({"permissions": people, "projects": named, "annotations": spark.createDataFrame([("p1", 0, "a", "{}", START, 1)], SUBMISSION)})
    assert store.snapshot().version == 1
    store.delete_projects(spark.createDataFrame([("p1",)], "project_id string"))
    assert store.snapshot().version == 2
    assert [tuple(r) for r in store.read("permissions").collect()] == [("p2", "a", "project_admin")]
    assert [tuple(r) for r in store.read("projects").collect()] == [("p2", "two", None)]
    assert store.read("annotations").count() == store.read("ml_annotations").count() == 0


def test_a_replayed_batch_is_committed_once(spark, tmp_path):
    rows = spark.createDataFrame(submissions(20, seed=9), SUBMISSION)
    store = ProjectStore(spark, str(tmp_path))
    for batch in (0, 0, 1, 0, 1):
        store.upsert({"annotations": rows}, stream="s", batch=batch)
    assert len(store.snapshot().segments) == 2 and store.snapshot().batches == {"s": 1}


def test_only_one_commit_takes_a_number(spark, tmp_path):
    root = str(tmp_path)
    calls = []

    def change(base):
        calls.append(base.version)
        if len(calls) == 1:
            commit(spark, root, lambda b: b._replace(batches={"other": 1}))
        return base._replace(batches={**base.batches, "mine": 1})

    assert commit(spark, root, change).version == 2 and calls == [0, 1]
    assert latest_snapshot(spark, root).batches == {"other": 1, "mine": 1}
