"""Time the heavy operators on skewed submissions.

    python tools/stress.py [submissions, default 12 million]

A third of all submissions are in one project beyond its share, a sixth are for one row and a
sixth by one user. The data is generated by Spark below a new temporary folder.
"""

from __future__ import annotations

import sys
import tempfile
import time
from collections.abc import Callable
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from annolytics.operators import annotations as an  # noqa: E402
from annolytics.operators import browse, ordering, payloads, status  # noqa: E402
from annolytics.operators.filters import FilterExpr  # noqa: E402
from annolytics.plans.ranking import blocked_positions  # noqa: E402
from annolytics.session import local_session  # noqa: E402
from workload.fixtures import NOW  # noqa: E402

DATASET_ROWS = 20_000_000
USERS = 2_000_000


def below(bound: int, salt: int):
    return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(bound))


def submissions(spark: SparkSession, count: int) -> DataFrame:
    i = F.col("id")
    day = F.make_dt_interval(secs=(i % USERS).cast("decimal(18,6)"))
    return spark.range(count).select(
        F.concat(F.lit("p"), F.when(i % 3 == 0, 0).otherwise(below(3, 0))).alias("project_id"),
        F.when(i % 6 == 0, 7).otherwise(below(DATASET_ROWS, 1)).cast("bigint").alias("row_index"),
        F.concat(F.lit("u"), F.when(i % 6 == 3, 1).otherwise(below(USERS, 2))).alias("user_id"),
        F.concat(F.lit('{"label":"l'), below(5, 0), F.lit('","n":'), i, F.lit("}")).alias("data"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + day).alias("ts"),
        i.alias("event_id"),
    )


def timed(name: str, run: Callable) -> None:
    started = time.perf_counter()
    result = run()
    print(f"{name:26} {time.perf_counter() - started:6.1f} s   {result}", flush=True)


def main() -> None:
    count = int(sys.argv[1]) if len(sys.argv) > 1 else 12_000_000
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark = local_session(8, shuffle_partitions=32, **{"spark.checkpoint.dir": f"{root}/scratch"})
    path = f"{root}/annotations"
    timed("upsert and store", lambda: an.write_annotations(an.annotation_upsert(submissions(spark, count)), path))
    table = an.read_annotations(spark, path).drop("row_block")
    p0 = browse.project_annotations(table, "p0")
    dataset = spark.range(DATASET_ROWS).selectExpr("id AS row_index", "id % 7 AS k")
    users = table.select("user_id").distinct()
    timed("rows, of p0, of row, of user", lambda: [df.count() for df in (table, p0, p0.where("row_index = 7"), p0.where("user_id = 'u1'"))])
    timed("progress", lambda: [tuple(r) for r in status.progress(table, "u1").collect()])
    placed = lambda: status.row_annotators(p0)
    timed("annotators of each row, placed", lambda: tuple(placed().agg(F.count("*"), F.max("position")).first()))
    lists = lambda: status.row_status(p0, "u1")
    timed("row_status", lambda: tuple(lists().agg(F.count("*"), F.max(F.size("annotators")), F.sum(F.size("annotators"))).first()))
    queue = lambda: ordering.label_queue(users, p0, F.lit("s"), DATASET_ROWS, 3)
    timed("label_queue, 3 per user", lambda: queue().count())
    exprs = [FilterExpr("annotations.count", ">", "1"), FilterExpr("annotation.label", "=", "l1"), FilterExpr("data.k", "=", "3")]
    timed("filter", lambda: browse.filter_rows(dataset, p0, exprs, "u1", NOW).count())
    unseen = lambda: browse.filter_rows(dataset, p0, [FilterExpr("annotations.count", "=", "0")], "u1", NOW)
    timed("page 200,000 of unseen", lambda: browse.page_keys(unseen(), 200_000, 50).total)
    hot_page = lambda: browse.browse_rows(dataset, p0, [FilterExpr("row_index", "<", "20")], "u1", NOW)
    timed("page with the hot row", lambda: tuple(hot_page().agg(F.count("*"), F.sum(F.size("annotators"))).first()))
    clip = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), below(50, 0)))
    samples = spark.range(count).select(clip.alias("clip"), F.col("id").alias("event_id"), below(1000, 0).cast("double").alias("v"))
    peaks = lambda: payloads.peak_envelope(blocked_positions(samples, ["clip"], "event_id"), "clip", "position", "v")
    timed("peak_envelope", lambda: tuple(peaks().agg(F.count("*"), F.sum("peak")).first()))
    spark.stop()


if __name__ == "__main__":
    main()
