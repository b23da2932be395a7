import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from annolytics.operators import annotations as an
from annolytics.operators import browse, checks, prefill, projects
from annolytics.operators.filters import FilterExpr
from annolytics.streaming.submissions import read_log, stream_upsert

SUBMISSION = "project_id string, row_index bigint, user_id string, data string, ts timestamp_ntz, event_id bigint"
START = datetime(2024, 1, 1)


def submissions(count=300, seed=2):
    """A third of all submissions are for one row by one user; moments repeat."""
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        key = ("p0", 1, "hot") if i % 3 == 0 else (f"p{rng.randrange(3)}", rng.randrange(5), f"u{rng.randrange(4)}")
        rows.append((*key, f'{{"n":{i}}}', START + timedelta(minutes=rng.randrange(40)), i))
    return rows


def by_hand(rows):
    table = {}
    for p, r, u, data, ts, event in sorted(rows, key=lambda s: (s[4], s[5])):
        first = table[(p, r, u)][0] if (p, r, u) in table else ts
        table[(p, r, u)] = (first, ts, data)
    return table


def as_table(df):
    return {(r["project_id"], r["row_index"], r["user_id"]): (r["created_at"], r["updated_at"], r["data"]) for r in df.collect()}


def test_upsert_keeps_the_first_time(spark):
    rows = submissions()
    assert as_table(an.annotation_upsert(spark.createDataFrame(rows, SUBMISSION))) == by_hand(rows)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_upsert_in_parts_in_any_order(spark, seed):
    rows = sorted(submissions(seed=seed), key=lambda s: (s[4], s[5]))
    table = an.annotation_upsert(spark.createDataFrame(rows[:150], SUBMISSION))
    again = an.annotation_upsert(spark.createDataFrame(random.Random(seed).sample(rows[150:], 150), SUBMISSION), table)
    assert as_table(again) == by_hand(rows)
    assert as_table(an.annotation_upsert(spark.createDataFrame(rows, SUBMISSION), again)) == by_hand(rows)


def test_merge_rewrites_only_touched_partitions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(an, "ROW_BLOCK", 3)
    path = tmp_path / "table"
    rows = sorted(submissions(), key=lambda s: (s[4], s[5]))
    an.write_annotations(an.annotation_upsert(spark.createDataFrame(rows, SUBMISSION)), str(path))
    files = {p: set(p.glob("*.parquet")) for p in path.glob("project_id=*/row_block=*")}
    later = [("p1", 4, "u9", "{}", START + timedelta(days=1), 900), ("p7", 0, "u1", "{}", START, 901)]
    an.merge_into_table(spark.createDataFrame(later, SUBMISSION), str(path))
    assert as_table(an.read_annotations(spark, str(path))) == by_hand(rows + later)
    changed = {p.relative_to(path).as_posix() for p, before in files.items() if set(p.glob("*.parquet")) != before}
    assert changed == {"project_id=p1/row_block=1"}


def test_stream_equals_batch_and_replays(spark, tmp_path):
    rows = submissions(400, seed=9)
    source, log = str(tmp_path / "in"), str(tmp_path / "log")
    df = spark.createDataFrame(rows, SUBMISSION).repartition(5)
    df.write.parquet(source)

    def run(checkpoint):
        stream = spark.readStream.schema(SUBMISSION).option("maxFilesPerTrigger", 2).parquet(source)
        stream_upsert(stream, log, str(tmp_path / checkpoint), available_now=True).awaitTermination()

    run("c1")
    assert as_table(read_log(spark, log)) == by_hand(rows)
    run("c2")  # a replay from the start, under other names
    assert as_table(read_log(spark, log)) == by_hand(rows)
    more = [("p0", 1, "hot", '{"late":1}', START - timedelta(days=1), 5000), ("p0", 1, "hot", '{"new":1}', START + timedelta(days=9), 5001)]
    spark.createDataFrame(more, SUBMISSION).write.mode("append").parquet(source)
    run("c2")
    assert as_table(read_log(spark, log)) == by_hand(rows + more)


def test_ml_upsert_resets_both_times(spark):
    old = spark.createDataFrame(
        [("p", 0, "m", "{}", START, START), ("p", 1, "m", "{}", START, START)],
        "project_id string, row_index bigint, annotator string, data string, created_at timestamp_ntz, updated_at timestamp_ntz",
    )
    later = START + timedelta(days=1)
    new = spark.createDataFrame([("p", 1, "m2", '{"a":1}', later, 1)], "project_id string, row_index bigint, annotator string, data string, ts timestamp_ntz, event_id bigint")
    got = {r["row_index"]: r for r in an.ml_upsert(new, old).collect()}
    assert got[0]["created_at"] == START
    assert (got[1]["annotator"], got[1]["created_at"], got[1]["updated_at"]) == ("m2", later, later)


def test_deletes_and_patches(spark):
    projects_df = spark.createDataFrame(
        [("p1", "One", "red", "a", ""), ("p2", "Two", "blue", "b", "")], "project_id string, name string, color string, tags string, instructions string"
    )
    left = an.cascade_delete({"projects": projects_df, "notes": projects_df.select("project_id")}, projects_df.where("project_id = 'p1'"))
    assert [df.count() for df in left.values()] == [1, 1]
    patches = spark.createDataFrame([("p1", "New", None, ""), ("p2", " ", "black", "c")], "project_id string, name string, color string, tags string")
    got = {r["project_id"]: tuple(r)[1:4] for r in projects.project_patch(projects_df, patches).select("project_id", "name", "color", "tags").collect()}
    assert got == {"p1": ("New", "red", ""), "p2": ("Two", "blue", "b")}


def test_visibility(spark):
    tables = (
        spark.createDataFrame([("p1", "One"), ("p2", "Two")], "project_id string, name string"),
        spark.createDataFrame([("bob", "p1", "project_admin"), ("eve", "p2", "annotator")], "user_id string, project_id string, role string"),
        spark.createDataFrame([("alice", "system_admin"), ("bob", "annotator"), ("eve", "annotator")], "user_id string, global_role string"),
    )
    seen = lambda u: sorted((r["project_id"], r["role"]) for r in projects.projects_visible(*tables, u).collect())
    assert seen("alice") == [("p1", None), ("p2", None)]
    assert seen("bob") == [("p1", "project_admin")]
    assert seen("nobody") == []
    assert projects.search_projects(tables[0].withColumn("tags", F.lit(None).cast("string")), "ON").count() == 1


# --- pre-labelling ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(0, "good"), (1, "bad"), (2, "boom"), (3, ""), (4, "great"), (5, "awful")]
    ml = spark.createDataFrame([(0, '{"sentiment":"stored"}', "old")], "row_index bigint, data string, annotator string")
    return spark.createDataFrame(rows, "row_index bigint, text string"), ml


def _flaky():
    def model(row):
        if row["text"] == "boom":
            raise RuntimeError("no answer")
        return {"length": len(row["text"])} if row["text"] else None

    return model


flaky = _flaky()


def test_failures_store_nothing(texts, now):
    data, ml = texts
    attempts = prefill.prefill_batch(data, ml, flaky, "p", "flaky", now)
    assert {r["row_index"]: r["data"] for r in attempts.collect()} == {1: '{"length": 3}', 2: None, 3: None, 4: '{"length": 5}', 5: '{"length": 5}'}
    assert tuple(prefill.prefill_summary(data, attempts).first()) == (6, 3, 2)
    assert tuple(prefill.prefill_summary(data, attempts, enabled=False).first()) == (0, 0, 0)
    assert prefill.prefill_batch(data, ml, flaky, "p", "flaky", now, enabled=False).count() == 0


def test_subset_and_lookup(spark, texts, now):
    data, ml = texts
    wanted = spark.createDataFrame([(0,), (1,), (1,), (2,)], "row_index bigint")
    assert sorted(r["row_index"] for r in prefill.prefill_batch(data, ml, flaky, "p", "m", now, subset=wanted).collect()) == [1, 2]
    got = {r["row_index"]: (r["data"], r["annotator"], r["source"]) for r in prefill.prefill_lookup(wanted, data, ml, flaky, "m").collect()}
    assert got == {0: ('{"sentiment":"stored"}', "old", "stored"), 1: ('{"length": 3}', "m", "computed"), 2: (None, None, "none")}
    assert {r["data"] for r in prefill.prefill_lookup(wanted, data, ml, flaky, "m", enabled=False).collect()} == {None}


def test_stored_prefill_calls_the_model_once_per_row(spark, texts, now, tmp_path):
    data, _ = texts
    path = str(tmp_path / "ml")
    schema = "project_id string, row_index bigint, annotator string, data string, created_at timestamp_ntz, updated_at timestamp_ntz"
    spark.createDataFrame([("p", 0, "old", "{}", START, START), ("other", 1, "old", "{}", START, START)], schema).write.parquet(path)
    calls = spark.sparkContext.accumulator(0)

    def counting(row, model=flaky):
        calls.add(1)
        return model(row)

    assert tuple(prefill.run_prefill(data, path, counting, "p", "m", now).first()) == (6, 3, 2)
    assert calls.value == 5
    stored = {(r["project_id"], r["row_index"]): r["annotator"] for r in spark.read.parquet(path).collect()}
    assert stored == {("p", 0): "old", ("other", 1): "old", ("p", 1): "m", ("p", 4): "m", ("p", 5): "m"}
    assert tuple(prefill.run_prefill(data, path, counting, "p", "m", now).first()) == (6, 0, 2)


def test_python_models_get_plain_nested_values(spark):
    schema = "row_index bigint, scores array<double>, meta struct<a: int, b: array<string>>, n double"
    data = spark.createDataFrame([(1, [1.0, 2.5], (3, ["x"]), float("nan")), (2, None, None, 1.0)], schema)
    got = {r["row_index"]: json.loads(r["data"]) for r in prefill.run_model(data, lambda row: row).collect()}
    assert got[1] == {"scores": [1.0, 2.5], "meta": {"a": 3, "b": ["x"]}, "n": None} and got[2] == {"scores": None, "meta": None, "n": 1.0}


def test_a_model_that_hangs_fails_its_row(texts):
    data, _ = texts

    def slow(row):
        if row["text"] == "boom":
            while True:
                pass
        return {"ok": 1}

    got = {r["row_index"]: r["data"] for r in prefill.run_model(data, slow, calls=prefill.Calls(timeout_seconds=0.5)).collect()}
    assert sum(v is None for v in got.values()) == 1 and len(got) == 6


def test_lookup_answers_every_request_and_stores_what_it_computes(spark, texts, now, tmp_path):
    data, _ = texts
    path = str(tmp_path / "ml")
    schema = "project_id string, row_index bigint, annotator string, data string, created_at timestamp_ntz, updated_at timestamp_ntz"
    spark.createDataFrame([("p", 0, "old", "{}", START, START)], schema).write.parquet(path)
    wanted = spark.createDataFrame([(0,), (1,), (2,), (77,)], "row_index bigint")
    look = lambda: {r["row_index"]: r["source"] for r in prefill.stored_lookup(wanted, data, path, flaky, "p", "m", now).collect()}
    assert look() == {0: "stored", 1: "computed", 2: "none", 77: "none"}
    assert look() == {0: "stored", 1: "stored", 2: "none", 77: "none"}
    assert spark.read.parquet(path).count() == 2


def test_null_labels_hide_values_and_bytes_show_addresses(spark, now):
    data = spark.createDataFrame([(0, "base", bytearray(b"\x00\x81")), (1, "base", None)], "row_index bigint, label string, raw binary")
    ann = an.annotation_upsert(spark.createDataFrame([("p", 0, "u", '{"label":null}', START, 1)], SUBMISSION))
    page = {r["row_index"]: r["preview"] for r in browse.browse_rows(data, ann, [], "u", now, dataset_id="d").collect()}
    assert page[0] == {"label": None, "raw": "/api/v1/datasets/d/rows/0/columns/raw"} and page[1]["label"] == "base"


def test_column_model(texts, now):
    data, ml = texts
    model = prefill.lexicon_model(data.schema)
    got = {r["row_index"]: r["data"] for r in prefill.prefill_batch(data, ml, model, "p", "lexicon", now).collect()}
    assert got[4] == '{"sentiment":"positive"}'
    assert got[5] == '{"sentiment":"negative"}'


# --- the label loop, end to end ----------------------------------------------------------------


def test_annotate_then_browse(spark, now):
    data = spark.range(25).selectExpr("id AS row_index", "concat('text ', id) AS text", "'src' AS source")
    rows = [
        ("p", 3, "alice", '{"sentiment":"positive","text":"shadowed"}', START, 1), ("p", 3, "bob", '{"sentiment":"negative"}', START + timedelta(1), 2),
        ("p", 9, "bob", '{"tags":["a","b"],"rating":4}', START, 3),
    ]
    ann = an.annotation_upsert(spark.createDataFrame(rows, SUBMISSION))
    shown = browse.browse_rows(data, ann, [], "alice", now, 1, 10)
    page = {r["row_index"]: r for r in shown.withColumn("keys", F.map_keys("preview")).collect()}
    assert sorted(page) == list(range(10))
    assert {r["total"] for r in page.values()} == {25}
    assert page[3]["preview"] == {"text": "shadowed", "source": "src", "sentiment": "negative"}
    assert page[3]["keys"] == ["text", "source", "sentiment"]
    assert [a["author_id"] for a in page[3]["annotations"]] == ["alice", "bob"]
    assert (page[3]["by_me"], page[3]["by_any"], page[3]["annotators"]) == (True, True, ["alice", "bob"])
    assert page[9]["preview"]["tags"] == '["a","b"]'
    assert (page[9]["by_me"], page[9]["by_any"]) == (False, True)
    assert (page[0]["by_me"], page[0]["by_any"], page[0]["annotators"], page[0]["annotations"]) == (False, False, [], None)
    unlabelled = browse.browse_rows(data, ann, [FilterExpr("annotations.count", "=", "0")], "alice", now).collect()
    assert {r["row_index"] for r in unlabelled} == set(range(25)) - {3, 9}
    mine = browse.browse_rows(data, ann, [FilterExpr("annotations.annotated_by", "=", "me")], "alice", now)
    assert [r["row_index"] for r in mine.collect()] == [3]
    assert browse.browse_rows(data, ann, [FilterExpr("row_index", ">", "99")], "alice", now).count() == 0


def test_checks(spark):
    ann = spark.createDataFrame([("p", 0, "a"), ("p", 0, "a"), ("p", 50, "ghost"), ("p", -1, "a")], "project_id string, row_index bigint, user_id string")
    assert [r["n"] for r in checks.duplicate_keys(ann, an.KEY).collect()] == [2]
    users = spark.createDataFrame([("a", "annotator"), ("b", "owner"), ("c", None)], "user_id string, global_role string")
    assert [r["row_index"] for r in checks.orphans(ann, users, "user_id").collect()] == [50]
    assert sorted(r["user_id"] for r in checks.bad_values(users, "global_role", checks.GLOBAL_ROLES).collect()) == ["b", "c"]
    projects_df = spark.createDataFrame([("p", "d")], "project_id string, dataset_id string")
    catalog = spark.createDataFrame([("d", 10)], "dataset_id string, num_rows bigint")
    assert sorted(r["row_index"] for r in checks.rows_out_of_range(ann, projects_df, catalog).collect()) == [-1, 50]
