"""Live progress against a full count, over replays, repeats and late submissions."""

from datetime import timedelta

from annolytics.operators.annotations import annotation_upsert
from annolytics.operators.status import count_per_row, progress, progress_by_user
from annolytics.streaming.progress import live_progress, read_progress
from annolytics.streaming.store import ProjectStore
from tests.test_writes import START, SUBMISSION, submissions


def test_live_progress_equals_a_full_count(spark, tmp_path):
    rows = submissions(200, seed=11)
    source, root, checkpoint = (str(tmp_path / n) for n in ("in", "store", "checkpoint"))
    write = lambda part: spark.createDataFrame(part, SUBMISSION).coalesce(2).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(SUBMISSION).option("maxFilesPerTrigger", 2).parquet(source)
        live_progress(stream, root, checkpoint, available_now=True, fan_in=2).awaitTermination()

    def check(seen):
        table = annotation_upsert(spark.createDataFrame(seen, SUBMISSION))
        for me in ("hot", "u1", "nobody"):
            want = {tuple(r) for r in progress(table, me).select("project_id", "annotated_rows", "annotated_by_me", "total_annotations").collect()}
            assert {tuple(r) for r in read_progress(spark, root, me).collect()} == want
        store = ProjectStore(spark, root)
        by_user = {(r.project_id, r.user_id): r.annotated_by_me for r in progress_by_user(table).collect()}
        assert {(r.project_id, r.user_id): r.annotated_rows for r in store.read("user_progress").collect()} == by_user
        p0 = {r.row_index: r.n_annotations for r in count_per_row(table.where("project_id = 'p0'")).collect()}
        assert {r.row_index: r.n_annotations for r in store.read("row_progress").where("project_id = 'p0'").collect()} == p0

    write(rows[:120])
    run()
    check(rows[:120])
    # Repeats, the rest, and one that is late, through a query that goes on from its checkpoint.
    late = [("p2", 4, "u9", "{}", START - timedelta(days=30), 9000)]
    for part in (rows[:50], rows[120:], late):
        write(part)
    run()
    check(rows + late)
    run()
    check(rows + late)
    assert len(ProjectStore(spark, root).snapshot().of("row_progress")) <= 3


def test_a_hot_row_is_kept_by_many_tasks(spark, tmp_path):
    """Row 7 of p0 has all submissions; its state lies in several partitions."""
    rows = [("p0", 7, f"u{i}", "{}", START, i) for i in range(300)]
    source, root, checkpoint = (str(tmp_path / n) for n in ("in", "store", "checkpoint"))
    for _ in range(2):
        spark.createDataFrame(rows, SUBMISSION).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(SUBMISSION).option("maxFilesPerTrigger", 1).parquet(source)
    live_progress(stream, root, checkpoint, available_now=True).awaitTermination()
    assert [tuple(r) for r in read_progress(spark, root, "u1").collect()] == [("p0", 1, 1, 300)]
    kept = spark.read.format("statestore").load(checkpoint)
    assert kept.count() == 301 and kept.select("partition_id").distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
