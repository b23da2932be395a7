"""Hot groups: results stay whole and equal to brute force when one group holds most rows."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from annolytics.operators import annotations, browse, ordering
from annolytics.operators.checks import orphans
from annolytics.operators.status import annotations_per_row, progress, progress_by_user, row_annotators, row_flags, row_status
from annolytics.operators.prefill import rows_to_prefill
from annolytics.operators.projects import role_map
from annolytics.plans.ranking import blocked_positions
from annolytics.plans.sizing import broadcast_if_small
from annolytics.sources.tables import save_bucketed


NOW = datetime(2024, 1, 31)


@pytest.fixture(scope="module")
def skewed(spark):
    """Row 7 has a third of all annotations, user u1 has annotated nearly every row."""
    rng = random.Random(5)
    pairs = {(7, f"u{i}") for i in range(400)} | {(r, "u1") for r in range(390)}
    pairs |= {(rng.randrange(400), f"u{rng.randrange(60)}") for _ in range(400)}
    rows = [("p0", r, u, f'{{"n":{r}}}') for r, u in sorted(pairs)]
    df = spark.createDataFrame(rows, "project_id string, row_index bigint, user_id string, data string")
    when = F.lit("2024-01-02 03:04:05").cast("timestamp_ntz")
    return pairs, df.withColumns({"created_at": when, "updated_at": when}).cache()


def test_one_row_per_row_whatever_its_annotations(skewed, spark):
    """Row 7 has hundreds of annotators and is one row like any other, in status, lists and pages."""
    pairs, df = skewed
    by_row = {}
    for row, user in sorted(pairs):
        by_row.setdefault(row, []).append(user)
    status = row_status(df, "u1").collect()
    assert len(status) == len(by_row) and {r["row_index"]: r["annotators"] for r in status} == by_row
    assert all(r["by_me"] == ((r["row_index"], "u1") in pairs) for r in status)
    lists = {r["row_index"]: [a["author_id"] for a in r["annotations"]] for r in annotations_per_row(df).collect()}
    assert lists == by_row
    flags = {r["row_index"]: (r["by_me"], r["n_annotators"]) for r in row_flags(df, "u1").collect()}
    assert flags == {row: ((row, "u1") in pairs, len(users)) for row, users in by_row.items()}
    dataset = spark.range(400).selectExpr("id AS row_index", "id AS x")
    page = browse.browse_rows(dataset, df, [], "u1", NOW, page=1, per_page=50).collect()
    assert sorted(r["row_index"] for r in page) == list(range(50))
    assert {r["row_index"]: r["annotators"] for r in page} == {i: by_row.get(i, []) for i in range(50)}
    found = browse.page_annotations(df, browse.page_keys(dataset, 1, 50)).collect()
    assert sorted((r["row_index"], r["author_id"]) for r in found) == sorted(p for p in pairs if p[0] < 50)


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_annotators_of_a_hot_row_are_placed_by_many_tasks(spark, skewed, ranges):
    pairs, df = skewed
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    try:
        got = row_annotators(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    by_row = {}
    for row, user in sorted(pairs):
        by_row.setdefault(row, []).append(user)
    want = {(row, user, i) for row, users in by_row.items() for i, user in enumerate(users)}
    assert {(r["row_index"], r["author_id"], r["position"]) for r in got} == want and len(got) == len(want)


def test_role_map_of_a_busy_user(spark):
    users = spark.createDataFrame([("a",), ("b",), ("c",)], "user_id string")
    perms = spark.createDataFrame([("a", f"p{i}", "annotator") for i in range(3000)] + [("b", "p1", "project_admin")], "user_id string, project_id string, role string")
    rows = {r["user_id"]: r["project_roles"] for r in role_map(users, perms).collect()}
    assert rows == {"a": {f"p{i}": "annotator" for i in range(3000)}, "b": {"p1": "project_admin"}, "c": None}


def test_positions_in_a_hot_group(spark):
    rng = random.Random(3)
    ids = rng.sample(range(5000), 1500)
    rows = [("hot" if i % 3 else f"c{i % 7}", i) for i in ids] + [("hot", -5)]
    got = blocked_positions(spark.createDataFrame(rows, "clip string, at bigint"), ["clip"], "at", block=64).collect()
    by_clip = {}
    for clip, at in sorted(rows):
        by_clip.setdefault(clip, []).append(at)
    assert {(r["clip"], r["at"]): r["position"] for r in got} == {(c, at): p for c, ats in by_clip.items() for p, at in enumerate(ats)}


def brute_queue(spark, users, pairs, salt, n, k):
    """All users times all rows, which the operator never builds."""
    order = ordering.user_row_order(
        spark.range(n).withColumnRenamed("id", "row_index").crossJoin(users), F.col("user_id"), F.lit(salt), n
    ).collect()
    free = {}
    for r in order:
        if (r["row_index"], r["user_id"]) not in pairs:
            free.setdefault(r["user_id"], []).append((r["order_position"], r["row_index"]))
    return {(u, i + 1): row for u, rows in free.items() for i, (_, row) in enumerate(sorted(rows)[:k])}


@pytest.mark.parametrize(("n", "k"), [(400, 5), (400, 30), (391, 3)])
def test_label_queue_against_brute_force(spark, skewed, monkeypatch, n, k):
    monkeypatch.setattr(ordering, "CANDIDATE_BLOCK", 32)
    pairs, df = skewed
    users = spark.createDataFrame([(f"u{i}",) for i in range(80)] + [("newcomer",)], "user_id string")
    got = ordering.label_queue(users, df, F.lit("salt"), n, k).collect()
    assert {(r["user_id"], r["queue_no"]): r["row_index"] for r in got} == brute_queue(spark, users, pairs, "salt", n, k)
    assert len(got) == len({(r["user_id"], r["row_index"]) for r in got})


def test_next_row_when_all_is_done(spark):
    users = spark.createDataFrame([("done",), ("new",)], "user_id string")
    ann = spark.createDataFrame([(i, "done") for i in range(4)], "row_index bigint, user_id string")
    got = {r["user_id"]: r["row_index"] for r in ordering.next_row(users, ann, F.lit("s"), 4).collect()}
    assert got["done"] is None
    assert got["new"] in range(4)
    assert ordering.next_row(users, ann, F.lit("s"), 0).where("row_index IS NOT NULL").count() == 0


def test_order_properties(spark):
    rows = spark.range(500).withColumnRenamed("id", "row_index")

    def order(user, salt):
        got = ordering.user_row_order(rows.repartition(3), F.lit(user), F.lit(salt), 500).collect()
        return {r["row_index"]: r["order_position"] for r in got}

    first = order("alice", "s1")
    assert sorted(first.values()) == list(range(500))
    assert first == order("alice", "s1")
    assert first != order("bob", "s1")
    assert first != order("alice", "s2")


def test_navigation_walks_the_whole_order(spark):
    n = 60
    at = spark.range(n).select(F.lit("u").alias("user_id"), F.col("id").alias("row_index"))
    moves = {r["row_index"]: r for r in ordering.navigate(at, F.lit("s"), n).collect()}
    row = next(i for i, r in moves.items() if r["prev_row"] is None)
    walked = [row]
    while moves[row]["next_row"] is not None:
        assert moves[moves[row]["next_row"]]["prev_row"] == row
        row = moves[row]["next_row"]
        walked.append(row)
    assert sorted(walked) == list(range(n))
    outside = spark.createDataFrame([("u", 60), ("u", -1)], "user_id string, row_index bigint")
    assert all(r["prev_row"] is None and r["next_row"] is None for r in ordering.navigate(outside, F.lit("s"), n).collect())


@pytest.mark.parametrize("page", [1, 2, 7, 33, 34, 35, 90])
def test_pages_at_any_depth(spark, monkeypatch, page):
    monkeypatch.setattr(browse, "BLOCK", 100)
    rng = random.Random(1)
    indices = sorted(rng.sample(range(100_000), 330) + list(range(200_000, 200_010)))
    df = spark.createDataFrame([(i,) for i in rng.sample(indices, len(indices))], "row_index bigint")
    got = browse.page_keys(df, page, 10)
    want = indices[(page - 1) * 10 : page * 10]
    assert sorted(r[0] for r in got.rows.collect()) == want
    assert (got.low, got.high, got.total) == ((want[0], want[-1], 340) if want else (None, None, 0))
    assert [r[0] for r in browse.browse_page(df, page, 10).collect()] == want


def test_pages_start_at_one_and_have_any_size(spark):
    rows = spark.range(3000).withColumnRenamed("id", "row_index")
    assert browse.page_keys(rows, 1, 10**7).rows.count() == 3000
    for page in (0, -1):
        with pytest.raises(ValueError):
            browse.page_keys(rows, page)
    assert browse.page_keys(rows.where("row_index < 0")).total == 0


def test_page_opens_only_its_row_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(annotations, "ROW_BLOCK", 100)
    monkeypatch.setattr(browse, "ROW_BLOCK", 100)
    stamp = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    rows = spark.range(1000).select(
        F.lit("p").alias("project_id"), F.col("id").alias("row_index"), F.lit("u").alias("user_id"), stamp.alias("created_at"), stamp.alias("updated_at"), F.lit("{}").alias("data")
    )
    annotations.write_annotations(rows, str(tmp_path / "t"))
    page = browse.page_keys(spark.range(1000).withColumnRenamed("id", "row_index"), 5, 50)
    found = browse.rows_at(annotations.read_annotations(spark, str(tmp_path / "t")), page)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "row_block" in plan.split("PartitionFilters")[1].split("]")[0]
    assert found.count() == 50


def test_queue_never_joins_annotations_by_user_alone(spark):
    rows = spark.range(2000).select(F.when(F.col("id") < 1500, "busy").otherwise(F.concat(F.lit("u"), F.col("id") % 7)).alias("user_id"), "id")
    rows = rows.select("user_id", (F.col("id") % 1600).alias("row_index"))
    users = rows.select("user_id").distinct()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        queue = ordering.label_queue(users, rows, F.lit("s"), 1600, 5)
        joins = [line for line in queue._jdf.queryExecution().optimizedPlan().toString().splitlines() if "LeftAnti" in line]
        assert joins and all("_position" in line for line in joins)
        got = {(r["user_id"], r["queue_no"]): r["row_index"] for r in queue.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    done = {(r["user_id"], r["row_index"]) for r in rows.collect()}
    assert len(got) == 8 * 5 and not {(u, row) for (u, _), row in got.items()} & done


def test_progress_against_counting(skewed):
    pairs, df = skewed
    row = progress(df, "u1").collect()[0]
    assert row["annotated_rows"] == len({r for r, _ in pairs})
    assert row["annotated_by_me"] == len({r for r, u in pairs if u == "u1"})
    assert row["total_annotations"] == len(pairs)
    by_user = {r["user_id"]: r["annotated_by_me"] for r in progress_by_user(df).collect()}
    assert sum(by_user.values()) == len(pairs)


def test_orphans_of_a_hot_parent(spark, skewed):
    pairs, df = skewed
    users = spark.createDataFrame([("u1",), ("u2",)], "user_id string")
    got = orphans(df, users, "user_id")
    assert got.count() == sum(u not in ("u1", "u2") for _, u in pairs)


def test_broadcast_depends_on_the_count(spark):
    df = spark.range(100)
    hinted = lambda d: "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()
    assert hinted(broadcast_if_small(df, 100))
    assert not hinted(broadcast_if_small(df, 99))


def test_no_pairs_and_no_single_partition_windows(spark, skewed):
    """The queue's plan has no cross join, and windows only by user."""
    _, df = skewed
    users = df.select("user_id").distinct()
    plan = ordering.label_queue(users, df, F.lit("s"), 400, 3)._jdf.queryExecution().executedPlan().toString()
    for costly in ("CartesianProduct", "BroadcastNestedLoopJoin", "SinglePartition"):
        assert costly not in plan
    assert "WindowGroupLimit" in plan


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    rows = spark.range(2000).selectExpr("id AS row_index", "concat('text ', id) AS text")
    data = save_bucketed(rows, "docs_bucketed", str(tmp_path / "docs"), 8)
    labels = save_bucketed(rows.where("row_index % 3 = 0").selectExpr("row_index", "'{}' AS data"), "labels_bucketed", str(tmp_path / "labels"), 8)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        todo = rows_to_prefill(data, labels)
        plan = todo._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan
        assert "Exchange" not in plan
        assert todo.count() == 1333
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.sql("DROP TABLE docs_bucketed")
        spark.sql("DROP TABLE labels_bucketed")
