"""Projections, joins, aggregates, pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from annolytics.functions.permutation import project_salt
from annolytics.operators import browse, projects as pr, projections as pj, status as st
from annolytics.operators.annotations import effective_label
from annolytics.operators.filters import FilterExpr
from workload import fixtures as fx
from workload.registry import plain, query

FIELDS = ["text", "lang", "source", "n_chars"]


@query("row_lookup", "SELECT row_index, lang, source, n_chars FROM dataset WHERE row_index IN (SELECT row_index FROM ann)")
def row_lookup(spark, sf):
    return browse.row_lookup(fx.dataset(spark, sf), fx.project_rows(spark, sf)).select("row_index", "lang", "source", "n_chars")


@query(
    "row_detail",
    """SELECT 'u7' AS user_id, row_index, lang, source, row_index IN (SELECT row_index FROM ann WHERE user_id='u7') AS by_me,
         row_index IN (SELECT row_index FROM ann) AS by_any FROM dataset""",
)
def row_detail(spark, sf):
    rows = fx.dataset(spark, sf).select("row_index", "lang", "source")
    return st.row_detail(rows.select(F.lit(fx.ME).alias("user_id"), "row_index"), rows, fx.project_rows(spark, sf))


@query(
    "row_json",
    """SELECT l_orderkey, l_linenumber, to_json({l_quantity:l_quantity, l_returnflag:l_returnflag, nothing:NULL,
         l_shipdate:strftime(l_shipdate,'%Y-%m-%d %H:%M:%S'), flags:[l_returnflag,l_linestatus]})::varchar AS json FROM lineitem""",
)
def row_json(spark, sf):
    rows = fx.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", F.lit(None).cast("string").alias("nothing"), "l_shipdate",
        F.array("l_returnflag", "l_linestatus").alias("flags"),
    )
    json = pj.row_json(rows, ["l_quantity", "l_returnflag", "nothing", "l_shipdate", "flags"])
    return rows.select("l_orderkey", "l_linenumber", json.alias("json"))


@query("binary_refs", "SELECT row_index, lang, '/api/v1/datasets/d0/rows/'||row_index||'/columns/payload' AS payload FROM dataset")
def binary_refs(spark, sf):
    rows = fx.dataset(spark, sf).select("row_index", "lang", F.encode("text", "utf-8").alias("payload"))
    return pj.with_binary_refs(rows, F.lit("d0"))


_CUT = "CASE WHEN length({c})>{n} THEN substr({c},1,{n})||'…' ELSE {c} END"


@query(
    "row_preview",
    f"""SELECT row_index, 0 AS place, 'text' AS name, {_CUT.format(c='text', n=60)} AS text, 0 AS more_fields FROM dataset
      UNION ALL SELECT row_index, 1, 'lang', lang, 0 FROM dataset UNION ALL SELECT row_index, 2, 'source', source, 0 FROM dataset
      UNION ALL SELECT row_index, 3, 'n_chars', n_chars::varchar, 0 FROM dataset""",
)
def row_preview(spark, sf):
    rows = fx.dataset(spark, sf)
    shown = rows.select("row_index", *pj.row_preview(rows, FIELDS))
    return shown.select("row_index", F.posexplode("preview").alias("place", "p"), "more_fields").select(
        "row_index", "place", "p.name", "p.text", "more_fields"
    )


@query(
    "row_preview_list",
    f"""SELECT page_id, {_CUT.format(c='url', n=40)} AS url, {_CUT.format(c='html', n=40)} AS html, 2 AS more_fields FROM pages""",
)
def row_preview_list(spark, sf):
    pages = fx.table(spark, sf, "pages").selectExpr("page_id", "url", "html", "page_id AS a", "url AS b", "html AS c")
    shown = pages.select("page_id", *pj.row_preview(pages, pages.columns, pj.LIST_PREVIEW))
    return shown.select("page_id", F.col("preview")[1]["text"].alias("url"), F.col("preview")[2]["text"].alias("html"), "more_fields")


_STATUS = """SELECT row_index, bool_or(user_id='u7') AS by_me, true AS by_any,
  string_agg(user_id, ',' ORDER BY user_id) AS annotators FROM ann GROUP BY row_index"""


@query("row_status", _STATUS)
def row_status(spark, sf):
    ann = fx.project_rows(spark, sf)
    status = st.row_status(ann, fx.ME)
    return status.withColumn("annotators", F.array_join("annotators", ","))


@query(
    "row_annotators",
    "SELECT row_index, user_id AS author_id, row_number() OVER (PARTITION BY row_index ORDER BY user_id) - 1 AS position FROM ann",
)
def row_annotators(spark, sf):
    return st.row_annotators(fx.project_rows(spark, sf))


@query(
    "page_annotations",
    """WITH page AS (SELECT row_index FROM dataset ORDER BY row_index LIMIT 50)
      SELECT row_index, user_id AS author_id, data, strftime(created_at,'%Y-%m-%d %H:%M:%S.%f') AS created_at,
        strftime(updated_at,'%Y-%m-%d %H:%M:%S.%f') AS updated_at FROM ann JOIN page USING (row_index)""",
)
def page_annotations(spark, sf):
    page = browse.page_keys(fx.dataset(spark, sf).select("row_index"))
    return plain(browse.page_annotations(fx.project_rows(spark, sf), page))


@query(
    "row_flags",
    "SELECT row_index, bool_or(user_id='u7') AS by_me, true AS by_any, count(*) AS n_annotators FROM ann GROUP BY row_index",
)
def row_flags(spark, sf):
    return st.row_flags(fx.project_rows(spark, sf), fx.ME)


@query(
    "status_label",
    f"""SELECT d.row_index, CASE WHEN s.by_me THEN 'Annotated by me' WHEN s.by_any THEN replace(s.annotators,',',', ')
        ELSE 'Unannotated' END AS label FROM dataset d LEFT JOIN ({_STATUS}) s USING (row_index)""",
)
def status_label(spark, sf):
    ann = fx.project_rows(spark, sf)
    status = st.row_status(ann, fx.ME)
    rows = fx.dataset(spark, sf).select("row_index").join(status, "row_index", "left")
    return rows.select("row_index", pj.status_label(F.col("by_me"), F.col("by_any"), F.col("annotators")).alias("label"))


@query("tags_split", "SELECT project_id, trim(unnest(string_split(tags,','))) AS tag FROM projects")
def tags_split(spark, sf):
    return fx.projects(spark, sf).select("project_id", F.explode(pj.tag_list(F.col("tags"))).alias("tag"))


# --- joins -----------------------------------------------------------------------------------


@query("projects_for_user", "SELECT user_id, project_id, name, role FROM projects JOIN permissions USING (project_id)")
def projects_for_user(spark, sf):
    found = pr.projects_for_user(fx.projects(spark, sf), fx.permissions(spark, sf))
    return found.select("user_id", "project_id", "name", "role")


@query(
    "projects_visible",
    """SELECT 'admin' AS caller, project_id, name, NULL AS role FROM projects
       UNION ALL SELECT 'member', project_id, name, role FROM projects JOIN permissions USING (project_id) WHERE user_id='u7'""",
)
def projects_visible(spark, sf):
    tables = fx.projects(spark, sf), fx.permissions(spark, sf), fx.users(spark, sf)
    seen = [
        pr.projects_visible(*tables, user).select(F.lit(caller).alias("caller"), "project_id", "name", "role")
        for caller, user in (("admin", "u0"), ("member", fx.ME))
    ]
    return seen[0].unionByName(seen[1])


@query(
    "visibility_grants",
    """SELECT user_id, 'all' AS scope, NULL AS project_id, NULL AS role FROM users WHERE global_role='system_admin'
       UNION ALL SELECT user_id, 'project', project_id, role FROM permissions
       WHERE user_id IN (SELECT user_id FROM users WHERE global_role<>'system_admin')""",
)
def visibility_grants(spark, sf):
    return pr.visibility_grants(fx.permissions(spark, sf), fx.users(spark, sf))


@query(
    "project_detail",
    r"""WITH prog AS (SELECT project_id, count(DISTINCT row_index) AS annotated_rows,
          count(DISTINCT CASE WHEN user_id='u7' THEN row_index END) AS annotated_by_me, count(*) AS total_annotations
          FROM annotations GROUP BY project_id)
        SELECT p.project_id, p.name, coalesce(c.num_rows,0) AS num_rows, t.source AS template_source,
          coalesce(array_to_string(regexp_extract_all(t.source,
            '<(?:SelectField|TextField|CheckboxGroup|RatingField|NERField|BBoxField)\s[^>]*?name="([^"]+)"',1),','),'') AS annotation_fields,
          coalesce(annotated_rows,0) AS annotated_rows, coalesce(annotated_by_me,0) AS annotated_by_me,
          coalesce(total_annotations,0) AS total_annotations
        FROM projects p LEFT JOIN catalog c USING (dataset_id) LEFT JOIN templates t USING (template_id) LEFT JOIN prog USING (project_id)""",
)
def project_detail(spark, sf):
    detail = pr.project_detail(
        fx.projects(spark, sf), fx.catalog(spark, sf), fx.templates(spark, sf), fx.annotations(spark, sf), fx.ME
    )
    return detail.select(
        "project_id", "name", "num_rows", "template_source", F.array_join("annotation_fields", ",").alias("annotation_fields"),
        "annotated_rows", "annotated_by_me", "total_annotations",
    )


BROWSE = [FilterExpr("data.lang", "=", "en"), FilterExpr("annotations.count", ">", "10")]


@query(
    "browse_rows",
    """WITH hit AS (SELECT d.row_index, d.lang, d.source, d.n_chars FROM dataset d WHERE lang='en'
          AND row_index IN (SELECT row_index FROM ann GROUP BY 1 HAVING count(*)>10)),
        page AS (SELECT * FROM hit ORDER BY row_index LIMIT 20 OFFSET 20),
        latest AS (SELECT row_index, arg_max(data, row(created_at,user_id)) AS data FROM ann GROUP BY 1)
      SELECT page.row_index, (SELECT count(*) FROM hit) AS total,
        string_agg(a.user_id, ',' ORDER BY a.user_id) AS annotators, bool_or(a.user_id='u7') AS by_me, true AS by_any,
        string_agg(a.data, '|' ORDER BY a.user_id) AS payloads, any_value(lang) AS lang, any_value(source) AS source,
        any_value(n_chars::varchar) AS n_chars, any_value(l.data::json->>'$.label') AS label,
        any_value(l.data::json->>'$.rating') AS rating
      FROM page JOIN ann a USING (row_index) JOIN latest l USING (row_index) GROUP BY page.row_index""",
)
def browse_rows(spark, sf):
    page = browse.browse_rows(
        fx.dataset(spark, sf), fx.project_rows(spark, sf), BROWSE, fx.ME, fx.NOW, page=2, per_page=20
    )
    shown = [F.try_element_at("preview", F.lit(f)).alias(f) for f in ("lang", "source", "n_chars", "label", "rating")]
    return page.select(
        "row_index", "total", F.array_join("annotators", ",").alias("annotators"), "by_me", "by_any",
        F.array_join(F.transform("annotations", lambda a: a["data"]), "|").alias("payloads"), *shown,
    )


@query(
    "browse_unannotated",
    """SELECT row_index, (SELECT count(*) FROM dataset WHERE row_index NOT IN (SELECT row_index FROM ann)) AS total,
         text, lang, 'Unannotated' AS label FROM dataset WHERE row_index NOT IN (SELECT row_index FROM ann)
       ORDER BY row_index LIMIT 50""",
)
def browse_unannotated(spark, sf):
    page = browse.browse_rows(
        fx.dataset(spark, sf), fx.project_rows(spark, sf), [FilterExpr("annotations.count", "=", "0")], fx.ME, fx.NOW
    )
    label = pj.status_label(F.col("by_me"), F.col("by_any"), F.col("annotators"))
    return page.select(
        "row_index", "total", F.try_element_at("preview", F.lit("text")).alias("text"),
        F.try_element_at("preview", F.lit("lang")).alias("lang"), label.alias("label"),
    )


@query(
    "browse_null_label",
    """WITH page AS (SELECT * FROM dataset ORDER BY row_index LIMIT 50)
      SELECT row_index, CASE WHEN row_index % 2 = 0 THEN NULL ELSE lang END AS lang, source FROM page""",
)
def browse_null_label(spark, sf):
    """Every second row has a label that sets a field to null."""
    rows = fx.dataset(spark, sf)
    stamp = F.lit(fx.NOW.isoformat(sep=" ")).cast("timestamp_ntz")
    labels = rows.where(F.col("row_index") % 2 == 0).select(
        F.lit("p").alias("project_id"), "row_index", F.lit("u1").alias("user_id"), F.lit('{"lang": null}').alias("data"),
        stamp.alias("created_at"), stamp.alias("updated_at"),
    )
    page = browse.browse_rows(rows, labels, [], fx.ME, fx.NOW)
    return page.select("row_index", *[F.try_element_at("preview", F.lit(f)).alias(f) for f in ("lang", "source")])


@query(
    "browse_binary",
    """SELECT row_index, lang, '/api/v1/datasets/d0/rows/'||row_index||'/columns/text' AS text FROM dataset ORDER BY row_index LIMIT 50""",
)
def browse_binary(spark, sf):
    """A page of rows with a binary column."""
    rows = fx.dataset(spark, sf).withColumn("text", F.encode("text", "utf-8"))
    page = browse.browse_rows(rows, fx.project_rows(spark, sf), [], fx.ME, fx.NOW, dataset_id="d0")
    return page.select("row_index", *[F.try_element_at("preview", F.lit(f)).alias(f) for f in ("lang", "text")])


@query(
    "unannotated_by_user",
    "SELECT row_index, lang FROM dataset WHERE row_index NOT IN (SELECT row_index FROM ann WHERE user_id='u7')",
)
def unannotated_by_user(spark, sf):
    return st.unannotated_by_user(fx.dataset(spark, sf), fx.project_rows(spark, sf), fx.ME).select("row_index", "lang")


@query(
    "effective_label",
    """SELECT d.row_index, coalesce(h.data,m.data) AS data,
         CASE WHEN h.data IS NOT NULL THEN 'human' WHEN m.data IS NOT NULL THEN 'model' ELSE 'none' END AS source
       FROM dataset d LEFT JOIN (SELECT * FROM ann WHERE user_id='u7') h USING (row_index)
       LEFT JOIN ml_annotations m USING (row_index)""",
)
def effective(spark, sf):
    return effective_label(fx.dataset(spark, sf), fx.project_rows(spark, sf), fx.ml_annotations(spark, sf), fx.ME)


@query(
    "annotation_lookup",
    """SELECT e.event_id, project_id, row_index, user_id, a.data, strftime(a.updated_at,'%Y-%m-%d %H:%M:%S.%f') AS updated_at
       FROM (SELECT event_id, 'p'||(event_id%2) AS project_id, (props::json->>'$.k')::bigint AS row_index, 'u'||user_id AS user_id FROM events) e
       JOIN annotations a USING (project_id, row_index, user_id)""",
)
def annotation_lookup(spark, sf):
    requests = fx.submissions(spark, sf).select(
        "event_id", F.concat(F.lit("p"), F.col("event_id") % 2).alias("project_id"), "row_index", "user_id"
    )
    return plain(
        browse.annotation_lookup(requests, fx.annotations(spark, sf)).select(
            "event_id", "project_id", "row_index", "user_id", "data", "updated_at"
        )
    )


@query(
    "ml_annotation_lookup",
    """SELECT s.event_id, row_index, m.annotator, m.data FROM submissions s JOIN ml_annotations m USING (project_id, row_index)""",
)
def ml_annotation_lookup(spark, sf):
    requests = fx.submissions(spark, sf).select("event_id", "project_id", "row_index")
    found = browse.ml_annotation_lookup(requests, fx.ml_annotations(spark, sf))
    return found.select("event_id", "row_index", "annotator", "data")


# --- aggregates ------------------------------------------------------------------------------


@query(
    "progress",
    """SELECT project_id, count(DISTINCT row_index) AS annotated_rows,
         count(DISTINCT CASE WHEN user_id='u7' THEN row_index END) AS annotated_by_me, count(*) AS total_annotations
       FROM annotations GROUP BY project_id""",
)
def progress(spark, sf):
    return st.progress(fx.annotations(spark, sf), fx.ME)


@query(
    "progress_by_user",
    """WITH t AS (SELECT project_id, count(DISTINCT row_index) AS annotated_rows, count(*) AS total_annotations FROM annotations GROUP BY 1)
       SELECT project_id, user_id, count(*) AS annotated_by_me, any_value(annotated_rows) AS annotated_rows,
         any_value(total_annotations) AS total_annotations FROM annotations JOIN t USING (project_id) GROUP BY 1,2""",
)
def progress_by_user(spark, sf):
    return st.progress_by_user(fx.annotations(spark, sf))


@query(
    "progress_pct",
    """WITH t AS (SELECT project_id, count(DISTINCT row_index) AS n FROM annotations GROUP BY 1)
       SELECT project_id, coalesce(n,0) AS annotated_rows, CASE WHEN coalesce(num_rows,0)=0 THEN 0
         ELSE floor(coalesce(n,0)*100/num_rows+0.5)::bigint END AS pct
       FROM projects LEFT JOIN catalog USING (dataset_id) LEFT JOIN t USING (project_id)""",
)
def progress_pct(spark, sf):
    done = pr.project_detail(
        fx.projects(spark, sf), fx.catalog(spark, sf), fx.templates(spark, sf), fx.annotations(spark, sf), fx.ME
    )
    return done.select("project_id", "annotated_rows", st.percent(F.col("annotated_rows"), F.col("num_rows")).alias("pct"))


@query("count_per_row", "SELECT row_index, count(*) AS n_annotations FROM ann GROUP BY 1")
def count_per_row(spark, sf):
    return st.count_per_row(fx.project_rows(spark, sf))


@query(
    "annotations_per_row",
    """SELECT row_index, count(*) AS n, string_agg(user_id||' '||data||' '||strftime(created_at,'%Y-%m-%d %H:%M:%S.%f')
         ||' '||strftime(updated_at,'%Y-%m-%d %H:%M:%S.%f'), '|' ORDER BY user_id) AS annotations FROM ann GROUP BY 1""",
)
def annotations_per_row(spark, sf):
    ann = fx.project_rows(spark, sf)
    lists = st.annotations_per_row(ann)
    time = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    texts = F.transform(
        "annotations", lambda a: F.concat_ws(" ", a["author_id"], a["data"], time(a["created_at"]), time(a["updated_at"]))
    )
    return lists.select("row_index", F.size("annotations").cast("bigint").alias("n"), F.array_join(texts, "|").alias("annotations"))


@query(
    "role_map",
    """SELECT user_id, name, global_role, string_agg(project_id||'='||role, ',' ORDER BY project_id) AS project_roles
       FROM users LEFT JOIN permissions USING (user_id) GROUP BY 1,2,3""",
)
def role_map(spark, sf):
    mapped = pr.role_map(fx.users(spark, sf), fx.permissions(spark, sf))
    pairs = F.transform(F.map_entries("project_roles"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return mapped.select("user_id", "name", "global_role", F.array_join(pairs, ",").alias("project_roles"))


# --- pages -----------------------------------------------------------------------------------


@query("browse_page", "SELECT row_index, lang, source, n_chars FROM dataset WHERE lang='en' ORDER BY row_index LIMIT 50 OFFSET 50")
def browse_page(spark, sf):
    rows = fx.dataset(spark, sf).where("lang = 'en'").select("row_index", "lang", "source", "n_chars")
    return browse.browse_page(rows, page=2)


@query(
    "deep_page",
    """SELECT o_orderkey AS row_index, (SELECT count(*) FROM orders WHERE o_custkey<>5) AS total, o_totalprice FROM orders
       WHERE o_custkey<>5 ORDER BY o_orderkey LIMIT 50 OFFSET 10000""",
)
def deep_page(spark, sf):
    orders = fx.table(spark, sf, "orders").where("o_custkey <> 5").withColumn("row_index", F.col("o_orderkey"))
    page = browse.page_keys(orders, page=201, per_page=50)
    return browse.rows_at(orders, page).select("row_index", F.lit(page.total).alias("total"), "o_totalprice")


@query("page_count", "SELECT lang, source, count(*) AS total, ceil(count(*)/50.0)::bigint AS pages FROM documents GROUP BY 1,2")
def page_count(spark, sf):
    totals = fx.table(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("total"))
    return totals.withColumn("pages", browse.page_count(F.col("total")))


@query("project_salt", "SELECT project_id, name, salt FROM projects")
def salt(spark, sf):
    return fx.projects(spark, sf).select("project_id", "name", project_salt(F.col("project_id"), F.col("name")).alias("salt"))
