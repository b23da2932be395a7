"""Upserts, deletes, patches, checks and the submission stream."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolytics.operators import annotations as an
from annolytics.operators import checks as ck
from annolytics.operators.projects import project_patch
from annolytics.session import scratch_path
from annolytics.streaming.progress import live_progress, read_progress
from annolytics.streaming.store import ProjectStore
from annolytics.streaming.submissions import read_log, stream_upsert
from workload import fixtures as fx
from workload.registry import plain, query

_TIMES = """strftime(created_at,'%Y-%m-%d %H:%M:%S.%f') AS created_at, strftime(updated_at,'%Y-%m-%d %H:%M:%S.%f') AS updated_at"""
_ALL = f"SELECT project_id, row_index, user_id, data, {_TIMES} FROM annotations"
EARLY = "ts < timestamp_ntz '2024-01-10'"
LATE = f"NOT ({EARLY})"


@query("annotation_upsert", _ALL)
def annotation_upsert(spark, sf):
    """Submissions of the first days, then the rest upserted onto them."""
    rows = fx.submissions(spark, sf)
    return plain(an.annotation_upsert(rows.where(LATE), an.annotation_upsert(rows.where(EARLY))))


@query("annotation_table_merge", _ALL)
def annotation_table_merge(spark, sf):
    """The same through a stored table whose touched partitions are rewritten."""
    path = scratch_path(spark, "table")
    rows = fx.submissions(spark, sf)
    an.write_annotations(an.annotation_upsert(rows.where(EARLY)), path)
    an.merge_into_table(rows.where(LATE), path)
    return plain(an.read_annotations(spark, path).drop("row_block"))


@query("store_upsert", _ALL)
def store_upsert(spark, sf):
    """Six commits to a store, whose folders are merged by twos."""
    rows, store = fx.submissions(spark, sf), ProjectStore(spark, scratch_path(spark, "store"), fan_in=2)
    for part in range(6):
        store.upsert({"annotations": rows.where(F.pmod(F.xxhash64("event_id"), F.lit(6)) == part)})
    store.compact("annotations")
    return plain(store.read("annotations"))


@query(
    "store_delete",
    """SELECT 'annotations' AS table_name, project_id, count(*) AS n FROM annotations WHERE project_id <> 'p1' GROUP BY 2
       UNION ALL SELECT 'annotations', project_id, count(DISTINCT (row_index, user_id)) FROM submissions WHERE project_id='p1' AND ts >= TIMESTAMP '2024-01-10' GROUP BY 2
       UNION ALL SELECT 'ml_annotations', project_id, count(DISTINCT row_index) FROM submissions WHERE project_id<>'p1' GROUP BY 2
       UNION ALL SELECT 'permissions', project_id, count(*) FROM permissions WHERE project_id<>'p1' GROUP BY 2
       UNION ALL SELECT 'projects', project_id, 1 FROM projects WHERE project_id<>'p1'""",
)
def store_delete(spark, sf):
    """A project deleted from all tables in one commit, and annotated again after it."""
    store = ProjectStore(spark, scratch_path(spark, "store"), fan_in=2)
    rows, made = fx.submissions(spark, sf), {"ts": F.lit(fx.NOW).cast("timestamp_ntz"), "event_id": F.lit(0).cast("bigint")}
    store.upsert(
        {
            "annotations": rows.where(EARLY),
            "ml_annotations": rows.withColumn("annotator", F.lit("m")),
            "permissions": fx.permissions(spark, sf).withColumns(made),
            "projects": fx.projects(spark, sf).withColumns(made),
        }
    )
    store.upsert({"annotations": rows.where(LATE).where("project_id <> 'p1'")})
    store.delete_projects(fx.projects(spark, sf).where("project_id = 'p1'"))
    store.upsert({"annotations": rows.where(LATE).where("project_id = 'p1'")})
    store.compact("annotations")
    snapshot = store.snapshot()
    counts = [
        store.read(name, snapshot).groupBy("project_id").agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "project_id", "n")
        for name in ("annotations", "ml_annotations", "permissions", "projects")
    ]
    return reduce(DataFrame.unionByName, counts)


@query(
    "ml_upsert",
    f"""WITH s AS (SELECT 'p0' AS project_id, row_index, 'm'||(event_id%4) AS annotator, data, ts, event_id FROM submissions),
          new AS (SELECT project_id, row_index, arg_max(row(annotator,data,ts), row(ts,event_id)) AS r FROM s GROUP BY 1,2),
          m AS (SELECT project_id, row_index, r[1] AS annotator, r[2] AS data, r[3] AS created_at, r[3] AS updated_at FROM new
            WHERE r[3] > TIMESTAMP '2024-01-15 12:00:00' OR row_index NOT IN (SELECT row_index FROM ml_annotations)
            UNION ALL SELECT o.* FROM ml_annotations o LEFT JOIN new USING (project_id,row_index)
            WHERE new.r IS NULL OR new.r[3] <= TIMESTAMP '2024-01-15 12:00:00')
        SELECT project_id, row_index, annotator, data, {_TIMES} FROM m""",
)
def ml_upsert(spark, sf):
    rows = fx.submissions(spark, sf).select(
        F.lit("p0").alias("project_id"), "row_index", F.concat(F.lit("m"), F.col("event_id") % 4).alias("annotator"), "data", "ts", "event_id"
    )
    return plain(an.ml_upsert(rows, fx.ml_annotations(spark, sf)))


@query(
    "cascade_delete",
    """SELECT 'annotations' AS table_name, project_id, count(*) AS n FROM annotations WHERE project_id NOT IN ('p1','p5') GROUP BY 2
       UNION ALL SELECT 'ml_annotations', project_id, count(*) FROM ml_annotations GROUP BY 2
       UNION ALL SELECT 'permissions', project_id, count(*) FROM permissions WHERE project_id<>'p1' GROUP BY 2
       UNION ALL SELECT 'projects', project_id, 1 FROM projects WHERE project_id NOT IN ('p1','p5')""",
)
def cascade_delete(spark, sf):
    tables = {
        "annotations": fx.annotations(spark, sf),
        "ml_annotations": fx.ml_annotations(spark, sf),
        "permissions": fx.permissions(spark, sf),
        "projects": fx.projects(spark, sf),
    }
    gone = fx.projects(spark, sf).where(F.col("project_id").isin("p1", "p5")).select("project_id")
    left = an.cascade_delete(tables, gone)
    counts = [
        df.groupBy("project_id").agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "project_id", "n")
        for name, df in left.items()
    ]
    return reduce(DataFrame.unionByName, counts)


@query(
    "project_patch",
    """SELECT project_id, CASE WHEN named THEN 'renamed '||s_suppkey ELSE name END AS name,
         CASE WHEN named AND s_acctbal>8000 THEN '#000000' ELSE color END AS color, tags,
         CASE WHEN named THEN 'read '||s_suppkey ELSE instructions END AS instructions
       FROM projects JOIN (SELECT *, s_acctbal>5000 AND s_nationkey<>7 AS named FROM supplier) ON project_id='p'||s_suppkey""",
)
def project_patch_query(spark, sf):
    k = F.col("s_suppkey")
    # Suppliers in credit patch their project; a patch with a blank name is rejected.
    patches = fx.table(spark, sf, "supplier").where("s_acctbal > 5000").select(
        F.concat(F.lit("p"), k).alias("project_id"),
        F.when(F.col("s_nationkey") != 7, F.concat(F.lit("renamed "), k)).otherwise(F.lit("  ")).alias("name"),
        F.when(F.col("s_acctbal") > 8000, "#000000").alias("color"),
        F.lit(None).cast("string").alias("tags"),
        F.concat(F.lit("read "), k).alias("instructions"),
    )
    return project_patch(fx.projects(spark, sf), patches).select("project_id", "name", "color", "tags", "instructions")


@query("stream_upsert", _ALL)
def streamed(spark, sf):
    source, log = scratch_path(spark, "incoming"), scratch_path(spark, "log")
    events = fx.table(spark, sf, "events")
    # Four files in no order of time, two per micro-batch.
    events.repartition(4, "event_id").write.parquet(source)
    incoming = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(source)
    stream_upsert(fx.submission_rows(incoming), log, scratch_path(spark, "checkpoint"), available_now=True).awaitTermination()
    return plain(read_log(spark, log))


def _streamed_counts(spark, sf):
    """The store of a stream that meets every file twice, in batches of three."""
    source, root = scratch_path(spark, "incoming"), scratch_path(spark, "progress")
    events = fx.table(spark, sf, "events")
    for _ in range(2):
        events.repartition(3, "event_id").write.mode("append").parquet(source)
    incoming = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 3).parquet(source)
    rows = fx.submission_rows(incoming)
    live_progress(rows, root, scratch_path(spark, "checkpoint"), available_now=True, fan_in=2).awaitTermination()
    return root


@query(
    "live_progress",
    """SELECT project_id, count(DISTINCT row_index) AS annotated_rows,
         count(DISTINCT CASE WHEN user_id='u7' THEN row_index END) AS annotated_by_me, count(*) AS total_annotations
       FROM annotations GROUP BY project_id""",
)
def streamed_progress(spark, sf):
    return read_progress(spark, _streamed_counts(spark, sf), fx.ME)


# --- checks ----------------------------------------------------------------------------------


@query(
    "chk_unique",
    """SELECT 'submission' AS kind, project_id, row_index, user_id, count(*) AS n FROM submissions GROUP BY 2,3,4 HAVING count(*)>1
       UNION ALL SELECT 'annotation', project_id, row_index, user_id, count(*) FROM annotations GROUP BY 2,3,4 HAVING count(*)>1
       UNION ALL SELECT 'ml', project_id, row_index, NULL, count(*) FROM
         (SELECT project_id,row_index FROM ml_annotations UNION ALL SELECT project_id,row_index FROM ann WHERE user_id='u7') GROUP BY 2,3 HAVING count(*)>1
       UNION ALL SELECT 'permission', project_id, NULL, user_id, count(*) FROM
         (SELECT project_id,user_id FROM permissions UNION ALL SELECT 'p0',user_id FROM users) GROUP BY 2,4 HAVING count(*)>1""",
)
def chk_unique(spark, sf):
    mine = fx.project_rows(spark, sf).where(F.col("user_id") == fx.ME)
    ml = fx.ml_annotations(spark, sf).select("project_id", "row_index").unionByName(mine.select("project_id", "row_index"))
    granted = fx.permissions(spark, sf).select("project_id", "user_id").unionByName(
        fx.users(spark, sf).select(F.lit("p0").alias("project_id"), "user_id")
    )
    key = ["project_id", "row_index", "user_id"]
    found = {
        "submission": ck.duplicate_keys(fx.submissions(spark, sf), key),
        "annotation": ck.duplicate_keys(fx.annotations(spark, sf), key),
        "ml": ck.duplicate_keys(ml, key[:2]),
        "permission": ck.duplicate_keys(granted, ["project_id", "user_id"]),
    }
    parts = [df.withColumn("kind", F.lit(kind)) for kind, df in found.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).select("kind", *key, "n")


@query(
    "chk_foreign",
    """SELECT 'annotation_user' AS kind, project_id, user_id, row_index FROM
         (SELECT project_id, row_index, CASE WHEN row_index%9=0 THEN 'ghost'||row_index ELSE user_id END AS user_id FROM annotations)
         WHERE user_id NOT IN (SELECT user_id FROM users)
       UNION ALL SELECT 'annotation_project', project_id, user_id, row_index FROM
         (SELECT CASE WHEN row_index%11=0 THEN 'lost'||row_index ELSE project_id END AS project_id, user_id, row_index FROM annotations)
         WHERE project_id NOT IN (SELECT project_id FROM projects)
       UNION ALL SELECT 'permission_user', project_id, user_id, NULL FROM permissions WHERE user_id NOT IN (SELECT user_id FROM users WHERE global_role<>'annotator' OR user_id LIKE '%1')""",
)
def chk_foreign(spark, sf):
    rows = fx.annotations(spark, sf).select("project_id", "row_index", "user_id")
    users, projects = fx.users(spark, sf), fx.projects(spark, sf)
    ghosts = rows.withColumn("user_id", F.when(F.col("row_index") % 9 == 0, F.concat(F.lit("ghost"), "row_index")).otherwise(F.col("user_id")))
    lost = rows.withColumn("project_id", F.when(F.col("row_index") % 11 == 0, F.concat(F.lit("lost"), "row_index")).otherwise(F.col("project_id")))
    few = users.where((F.col("global_role") != "annotator") | F.col("user_id").endswith("1"))
    found = {
        "annotation_user": ck.orphans(ghosts, users, "user_id"),
        "annotation_project": ck.orphans(lost, projects, "project_id"),
        "permission_user": ck.orphans(fx.permissions(spark, sf).drop("role"), few, "user_id"),
    }
    parts = [df.withColumn("kind", F.lit(kind)) for kind, df in found.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).select("kind", "project_id", "user_id", "row_index")


@query(
    "chk_domain",
    """SELECT 'global_role' AS kind, user_id AS id, role AS value FROM (SELECT user_id, CASE WHEN user_id LIKE '%3' THEN 'owner' ELSE global_role END AS role FROM users)
         WHERE role NOT IN ('system_admin','annotator')
       UNION ALL SELECT 'project_role', user_id||'/'||project_id, role FROM (SELECT user_id, project_id, CASE WHEN user_id LIKE '%4' THEN NULL ELSE role END AS role FROM permissions)
         WHERE role IS NULL OR role NOT IN ('project_admin','annotator')
       UNION ALL SELECT 'row_index', user_id||'/'||project_id, (row_index*100)::varchar FROM annotations JOIN projects USING (project_id) JOIN catalog USING (dataset_id)
         WHERE row_index*100 < 0 OR row_index*100 >= num_rows""",
)
def chk_domain(spark, sf):
    users = fx.users(spark, sf).withColumn("role", F.when(F.col("user_id").endswith("3"), "owner").otherwise(F.col("global_role")))
    perms = fx.permissions(spark, sf).withColumn("role", F.when(~F.col("user_id").endswith("4"), F.col("role")))
    spread = fx.annotations(spark, sf).withColumn("row_index", F.col("row_index") * 100)
    pair = F.concat_ws("/", "user_id", "project_id")
    found = [
        ck.bad_values(users, "role", ck.GLOBAL_ROLES).select(F.lit("global_role").alias("kind"), F.col("user_id").alias("id"), F.col("role").alias("value")),
        ck.bad_values(perms, "role", ck.PROJECT_ROLES).select(F.lit("project_role").alias("kind"), pair.alias("id"), F.col("role").alias("value")),
        ck.rows_out_of_range(spread, fx.projects(spark, sf), fx.catalog(spark, sf)).select(
            F.lit("row_index").alias("kind"), pair.alias("id"), F.col("row_index").cast("string").alias("value")
        ),
    ]
    return reduce(DataFrame.unionByName, found)
