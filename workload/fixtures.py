"""Annotation tables derived from the driver's tables, in Spark and in SQL.

Every fixture is computed from a table that grows with the scale factor. SQL_FIXTURES holds the
same definitions as common table expressions, in dependency order.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolytics.functions.permutation import project_salt
from annolytics.operators.annotations import annotation_upsert, read_annotations, write_annotations
from annolytics.session import scratch_path

NOW = datetime(2024, 1, 31)
ME = "u7"
PROJECT = "p0"

# Words frequent in the generated prose, used as lexicons.
POSITIVE = ("that", "with", "for", "was", "que", "und")
NEGATIVE = ("ci", "der", "des", "this", "are", "les")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def dataset(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as the dataset; their ids are contiguous from 0."""
    return table(spark, sf, "documents").select(F.col("doc_id").alias("row_index"), "text", "lang", "source", "n_chars")


def submission_rows(events: DataFrame) -> DataFrame:
    payload = F.struct(
        F.col("event_type").alias("label"), F.col("value").alias("score"), (1 + F.col("event_id") % 5).alias("rating")
    )
    return events.select(
        F.concat(F.lit("p"), F.col("event_id") % 3).alias("project_id"),
        F.get_json_object("props", "$.k").cast("bigint").alias("row_index"),
        F.concat(F.lit("u"), F.col("user_id")).alias("user_id"),
        F.to_json(payload).alias("data"),
        "ts",
        "event_id",
    )


def submissions(spark: SparkSession, sf: str) -> DataFrame:
    return submission_rows(table(spark, sf, "events"))


_STORED: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf: str, name: str, write) -> str:
    """The path of a table that is written once per session, as a project's tables are."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _STORED:
        path = scratch_path(spark, name)
        write(path)
        _STORED[key] = path
    return _STORED[key]


def annotations(spark: SparkSession, sf: str) -> DataFrame:
    """The annotation table."""
    path = stored(spark, sf, "annotations", lambda p: write_annotations(annotation_upsert(submissions(spark, sf)), p))
    return read_annotations(spark, path).drop("row_block")


def project_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The annotations of the project most queries are about; only its partitions are read."""
    return annotations(spark, sf).where(F.col("project_id") == PROJECT)


def users(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "events")
        .select("user_id")
        .distinct()
        .select(
            F.concat(F.lit("u"), F.col("user_id")).alias("user_id"),
            F.concat(F.lit("User "), F.col("user_id")).alias("name"),
            F.when(F.col("user_id") % 50 == 0, "system_admin").otherwise("annotator").alias("global_role"),
        )
    )


def _project_rows(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("s_suppkey")
    project_id = F.concat(F.lit("p"), key)
    return (
        table(spark, sf, "supplier")
        .join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            project_id.alias("project_id"),
            F.col("s_name").alias("name"),
            F.concat(F.lower("r_name"), F.lit(", batch "), key % 2).alias("tags"),
            F.concat(F.lit("d"), key * 3).alias("dataset_id"),
            F.concat(F.lit("t"), key * 7).alias("template_id"),
            F.lit("#1976d2").alias("color"),
            F.lit("").alias("instructions"),
            project_salt(project_id, F.col("s_name")).alias("salt"),
        )
    )


def projects(spark: SparkSession, sf: str) -> DataFrame:
    """The project table."""
    rows = _project_rows(spark, sf)
    path = stored(spark, sf, "projects", rows.write.parquet)
    return spark.read.schema(rows.schema).parquet(path)


def permissions(spark: SparkSession, sf: str) -> DataFrame:
    """Every user who is no admin has a role in the projects they submitted to."""
    members = users(spark, sf).where("global_role <> 'system_admin'").select("user_id")
    pairs = submissions(spark, sf).select("user_id", "project_id").distinct().join(members, "user_id", "left_semi")
    return pairs.select(
        "user_id", "project_id", F.when(F.col("user_id").endswith("1"), "project_admin").otherwise("annotator").alias("role")
    )


def _quality_labels(labels: DataFrame) -> DataFrame:
    made = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    return labels.select(
        F.lit(PROJECT).alias("project_id"),
        F.col("doc_id").alias("row_index"),
        F.lit("quality").alias("annotator"),
        F.to_json(F.struct("quality", "toxic")).alias("data"),
        made.alias("created_at"),
        made.alias("updated_at"),
    )


def ml_annotations(spark: SparkSession, sf: str) -> DataFrame:
    """The model annotation table: the labels, which cover some of the documents."""
    rows = _quality_labels(table(spark, sf, "labels"))
    path = stored(spark, sf, "ml_annotations", rows.write.parquet)
    return spark.read.schema(rows.schema).parquet(path)


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("page_id")
    return table(spark, sf, "pages").select(
        F.concat(F.lit("d"), key).alias("dataset_id"),
        F.when(key % 3 != 0, F.concat(F.lit("Page "), key)).alias("name"),
        F.col("url").alias("source"),
        F.length("html").cast("bigint").alias("num_rows"),
        F.concat(F.lit('[{"name":"c'), key % 7, F.lit('","type":"string"},{"name":"html","type":"string"}]')).alias("columns"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=key.cast("int"))).alias("created_at"),
    )


def templates(spark: SparkSession, sf: str) -> DataFrame:
    widget = (
        F.when(F.col("p_size") % 4 == 0, "TextField")
        .when(F.col("p_size") % 4 == 1, "RatingField")
        .when(F.col("p_size") % 4 == 2, "AudioSegmentField")
        .otherwise("NERField")
    )
    source = F.concat(
        F.lit('<div>{data.text}</div><SelectField labels={["a","b"]} name="'), "p_type", F.lit('" /><'), widget,
        F.lit(' name="'), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit('" />'),
    )
    return table(spark, sf, "part").select(
        F.concat(F.lit("t"), "p_partkey").alias("template_id"), F.when(F.col("p_size") != 50, source).alias("source")
    )


def entities(spark: SparkSession, sf: str) -> DataFrame:
    def span(start: int, end: int, name: str):
        return F.struct(F.lit(start).alias("start"), F.lit(end).alias("end"), F.lit(name).alias("entity"))

    two = F.array(span(20, 30, "LOC"), span(0, 9, "ORG"))
    three = F.array(span(20, 30, "LOC"), span(0, 9, "ORG"), span(25, 35, "PER"))
    return (
        table(spark, sf, "documents")
        .select(F.col("doc_id").alias("row_index"), "text", F.when(F.col("doc_id") % 5 == 0, three).otherwise(two).alias("entities"))
    )


def corners(spark: SparkSession, sf: str) -> DataFrame:
    at = lambda i: F.abs(F.col("embedding")[i].cast("double"))
    corner = F.struct(
        at(0).alias("x0"), at(1).alias("y0"), at(2).alias("x1"), at(3).alias("y1"), F.concat(F.lit("c"), "label").alias("category")
    )
    return table(spark, sf, "embeddings").select("vec_id", F.array(corner).alias("corners"))


def segments(spark: SparkSession, sf: str) -> DataFrame:
    start = F.col("value") / 10
    segment = F.struct(start.alias("start"), (start + (F.col("event_id") % 7) * 0.02).alias("end"), F.col("event_type").alias("label"))
    return table(spark, sf, "events").select("event_id", F.array(segment).alias("segments"), F.lit(30.0).alias("duration"))


SQL_FIXTURES = {
    "dataset": "SELECT doc_id AS row_index, text, lang, source, n_chars FROM documents",
    "submissions": """SELECT 'p'||(event_id%3)::varchar AS project_id, (props::json->>'$.k')::bigint AS row_index,
      'u'||user_id::varchar AS user_id, to_json({label:event_type,score:value,rating:1+event_id%5})::varchar AS data,
      ts, event_id FROM events""",
    "annotations": """SELECT project_id, row_index, user_id, min(ts) AS created_at, max(ts) AS updated_at,
      arg_max(data, row(ts, event_id)) AS data FROM submissions GROUP BY ALL""",
    "ann": "SELECT * FROM annotations WHERE project_id = 'p0'",
    "users": """SELECT DISTINCT 'u'||user_id::varchar AS user_id, 'User '||user_id::varchar AS name,
      CASE WHEN user_id%50=0 THEN 'system_admin' ELSE 'annotator' END AS global_role FROM events""",
    "projects": """SELECT 'p'||s_suppkey AS project_id, s_name AS name, lower(r_name)||', batch '||(s_suppkey%2) AS tags,
      'd'||(s_suppkey*3) AS dataset_id, 't'||(s_suppkey*7) AS template_id, '#1976d2' AS color, '' AS instructions,
      substr(sha256('p'||s_suppkey||':'||s_name),1,16) AS salt
      FROM supplier JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey""",
    "permissions": """SELECT DISTINCT user_id, project_id, CASE WHEN user_id LIKE '%1' THEN 'project_admin' ELSE 'annotator' END AS role
      FROM submissions JOIN users USING (user_id) WHERE global_role<>'system_admin'""",
    "ml_annotations": """SELECT 'p0' AS project_id, doc_id AS row_index, 'quality' AS annotator,
      to_json({quality:quality,toxic:toxic})::varchar AS data, TIMESTAMP '2024-01-15 12:00:00' AS created_at,
      TIMESTAMP '2024-01-15 12:00:00' AS updated_at FROM labels""",
    "catalog": """SELECT 'd'||page_id AS dataset_id, CASE WHEN page_id%3<>0 THEN 'Page '||page_id END AS name, url AS source,
      length(html)::bigint AS num_rows,
      '[{"name":"c'||(page_id%7)||'","type":"string"},{"name":"html","type":"string"}]' AS columns,
      TIMESTAMP '2024-01-01 00:00:00' + to_minutes(page_id) AS created_at FROM pages""",
    "templates": """SELECT 't'||p_partkey AS template_id, CASE WHEN p_size<>50 THEN
      '<div>{data.text}</div><SelectField labels={["a","b"]} name="'||p_type||'" /><'||
      CASE p_size%4 WHEN 0 THEN 'TextField' WHEN 1 THEN 'RatingField' WHEN 2 THEN 'AudioSegmentField' ELSE 'NERField' END||
      ' name="'||replace(p_name,' ','_')||'" />' END AS source FROM part""",
    "spans": """SELECT doc_id AS row_index, text, unnest([0,1,2]) AS no, unnest([20,0,25]) AS s, unnest([30,9,35]) AS e,
      unnest(['LOC','ORG','PER']) AS entity FROM documents""",
    "entity_spans": "SELECT * FROM spans WHERE no<2 OR row_index%5=0",
    "corners": """SELECT vec_id, abs(embedding[1]::double) AS x0, abs(embedding[2]::double) AS y0, abs(embedding[3]::double) AS x1,
      abs(embedding[4]::double) AS y1, 'c'||label AS category FROM embeddings""",
    "boxes": """SELECT * FROM (SELECT vec_id, least(x0,x1) AS x, least(y0,y1) AS y, abs(x1-x0) AS w, abs(y1-y0) AS h,
      category FROM corners) WHERE w>0.005 AND h>0.005""",
    "keys": """SELECT user_id, ('0x'||substr(h,1,8))::bigint AS w0, ('0x'||substr(h,9,8))::bigint AS w1,
      ('0x'||substr(h,17,8))::bigint AS w2, ('0x'||substr(h,25,8))::bigint AS w3, ('0x'||substr(h,33,8))::bigint AS w4,
      ('0x'||substr(h,41,8))::bigint AS w5, ('0x'||substr(h,49,8))::bigint AS w6, ('0x'||substr(h,57,8))::bigint AS w7
      FROM (SELECT user_id, sha256(user_id||':'||(SELECT salt FROM projects WHERE project_id='p0')) AS h FROM users)""",
    # The keyed shuffle, walked forward from every position for every user.
    "walk": """SELECT user_id, t.p AS pos, t.p AS x, 1::bigint AS i, (SELECT count(*) FROM documents) AS n
        FROM keys, generate_series(0::bigint, (SELECT count(*) FROM documents)-1) AS t(p)
      UNION ALL
      SELECT user_id, pos, CASE WHEN (greatest(x,m)%2147483647*scale+shift)%2147483647%2=1 THEN m ELSE x END, i+1, n
      FROM (SELECT *, (turn-x+n)%n AS m FROM (SELECT walk.*,
          ((w0+i*w1)%2147483647*2147483647+(w2+i*w3)%2147483647)%n AS turn,
          (w4+i*w5)%2147483646+1 AS scale, (w6+i*w7)%2147483647 AS shift
        FROM walk JOIN keys USING (user_id) WHERE i<=16))""",
    "user_order": "SELECT user_id, pos, x AS row_index FROM walk WHERE i=17",
}
