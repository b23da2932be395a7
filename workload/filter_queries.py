"""Filters and predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolytics.functions.literals import literal_kind, literal_number, relative_time, timestamp_literal
from annolytics.functions.jsontext import json_text
from annolytics.operators.bitmaps import bit_total, bitmap_page, filter_bitmaps, rows_of_bitmaps
from annolytics.operators.browse import distinct_rows, filter_rows, intersect_rows
from annolytics.operators.filters import FilterExpr
from annolytics.operators.projects import search_catalog, search_projects
from annolytics.session import settle
from annolytics.sources.grams import GramSettings, narrowed, open_grams, store_with_grams
from workload import fixtures as fx
from workload.registry import plain, query

Case = tuple[str, list[tuple], str]
#: Cases, loader and conjunction of every query of filters.
FILTER_CASES: dict[str, tuple] = {}


def _exprs(parts) -> list[FilterExpr]:
    return [FilterExpr(*part) for part in parts]


def register_cases(name: str, cases: list[Case], source: str = "dataset", with_or: bool = False) -> None:
    """One query of several filters. A case is a name, its expressions, and the SQL condition on
    a row ``d``."""
    rows = {
        "dataset": ("dataset", lambda spark, sf: fx.dataset(spark, sf)),
        "orders": (
            "(SELECT o_orderkey AS row_index, * FROM orders)",
            lambda spark, sf: fx.table(spark, sf, "orders").withColumn("row_index", F.col("o_orderkey")),
        ),
        "part": (
            "(SELECT p_partkey AS row_index, * FROM part)",
            lambda spark, sf: fx.table(spark, sf, "part").withColumn("row_index", F.col("p_partkey")),
        ),
        "lineitem": (
            """(SELECT l_orderkey*8+l_linenumber AS row_index, *, l_quantity>25 AS big,
                CAST(l_tax AS DECIMAL(6,3)) AS tax, l_shipdate::date AS day FROM lineitem)""",
            lambda spark, sf: fx.table(spark, sf, "lineitem").withColumns(
                {
                    "row_index": F.col("l_orderkey") * 8 + F.col("l_linenumber"),
                    "big": F.col("l_quantity") > 25,
                    "tax": F.col("l_tax").cast("decimal(6,3)"),
                    "day": F.col("l_shipdate").cast("date"),
                }
            ),
        ),
    }
    table, load = rows[source]
    FILTER_CASES[name] = cases, load, with_or
    union = " UNION ALL ".join(
        f"SELECT '{case}' AS case_name, d.row_index FROM {table} d WHERE {condition}" for case, _, condition in cases
    )

    def run(spark, sf) -> DataFrame:
        data, ann = load(spark, sf), fx.project_rows(spark, sf)
        parts = [
            filter_rows(data, ann, _exprs(parts), fx.ME, fx.NOW, with_or).select(F.lit(case).alias("case_name"), "row_index")
            for case, parts, _ in cases
        ]
        return reduce(DataFrame.unionByName, parts)

    query(name, union)(run)


def some(condition: str) -> str:
    return f"EXISTS (SELECT 1 FROM ann a WHERE a.row_index=d.row_index AND {condition})"


def count_is(condition: str) -> str:
    return f"d.row_index IN (SELECT row_index FROM ann GROUP BY row_index HAVING count(*) {condition})"


register_cases(
    "flt_row_index",
    [
        ("eq", [("row_index", "=", "17")], "d.row_index=17"),
        ("ne", [("row_index", "!=", "17")], "d.row_index<>17"),
        ("range", [("row_index", ">=", "10"), ("row_index", "<=", "19")], "d.row_index BETWEEN 10 AND 19"),
        ("gt", [("row_index", ">", "150")], "d.row_index>150"),
        ("lt", [("row_index", "<", "5")], "d.row_index<5"),
        ("other", [("row_index", "~=", "1")], "true"),
    ],
)
register_cases(
    "flt_count_zero",
    [
        (name, [("annotations.count", op, value)], "d.row_index NOT IN (SELECT row_index FROM ann)")
        for name, op, value in (("eq0", "=", "0"), ("lt1", "<", "1"), ("le0", "<=", "0"))
    ],
)
register_cases(
    "flt_count",
    [
        ("gt0", [("annotations.count", ">", "0")], count_is("> 0")),
        ("ge3", [("annotations.count", ">=", "3")], count_is(">= 3")),
        ("ne3", [("annotations.count", "!=", "3")], count_is("<> 3")),
        ("lt30", [("annotations.count", "<", "30")], count_is("< 30")),
        ("ge0", [("annotations.count", ">=", "0")], count_is(">= 0")),
    ],
)
register_cases(
    "flt_annotated_by",
    [
        ("me", [("annotations.annotated_by", "=", "me")], some("a.user_id='u7'")),
        ("u3", [("annotations.annotated_by", "=", "u3")], some("a.user_id='u3'")),
        ("operator_ignored", [("annotations.annotated_by", "!=", "u3")], some("a.user_id='u3'")),
    ],
)
for column in ("created_at", "updated_at"):
    register_cases(
        f"flt_{column}",
        [
            ("days", [(f"annotations.{column}", ">=", "10d")], some(f"a.{column}>=TIMESTAMP '2024-01-21'")),
            ("month", [(f"annotations.{column}", "<", "1M")], some(f"a.{column}<TIMESTAMP '2024-01-01'")),
            ("hours", [(f"annotations.{column}", ">", "400h")], some(f"a.{column}>TIMESTAMP '2024-01-14 08:00:00'")),
            ("date", [(f"annotations.{column}", "<=", "2024-01-09")], some(f"a.{column}<=TIMESTAMP '2024-01-09'")),
            ("future", [(f"annotations.{column}", ">=", "2099-01-01")], "false"),
        ],
    )

SCORE = "(a.data::json->>'$.score')::double"
CLICKED = some("a.data::json->>'$.label'='click'")
BY_ME = some("a.user_id='u7'")
BY_U3 = some("a.user_id='u3'")
HIGH_SCORE = some(f"{SCORE}>200")
register_cases(
    "flt_label_contains",
    [
        ("case", [("annotation.label", "~=", "IC")], some("(a.data::json->>'$.label') ILIKE '%IC%'")),
        ("wildcard", [("annotation.label", "~=", "c_ick")], some("(a.data::json->>'$.label') ILIKE '%c_ick%'")),
        ("number", [("annotation.rating", "~=", "4")], some("(a.data::json->>'$.rating') LIKE '%4%'")),
        ("missing", [("annotation.nothing", "~=", "a")], "false"),
    ],
)
register_cases(
    "flt_label_eq",
    [
        ("text", [("annotation.label", "=", "click")], some("a.data::json->>'$.label'='click'")),
        ("int", [("annotation.rating", "=", "5")], some("(a.data::json->>'$.rating')::int=5")),
        ("float", [("annotation.rating", "=", "5.0")], some("(a.data::json->>'$.rating')::int=5")),
        ("other_type", [("annotation.label", "=", "5")], "false"),
        ("text_vs_number", [("annotation.rating", "=", "five")], "false"),
    ],
)
register_cases(
    "flt_label_ne",
    [
        ("text", [("annotation.label", "!=", "click")], some("a.data::json->>'$.label'<>'click'")),
        ("int", [("annotation.rating", "!=", "5")], some("(a.data::json->>'$.rating')::int<>5")),
        ("other_type", [("annotation.label", "!=", "5")], some("true")),
        ("missing", [("annotation.nothing", "!=", "5")], "false"),
    ],
)
register_cases(
    "flt_label_cmp",
    [
        ("gt", [("annotation.score", ">", "100")], some(f"{SCORE}>100")),
        ("le", [("annotation.score", "<=", "1.5")], some(f"{SCORE}<=1.5")),
        ("ge", [("annotation.rating", ">=", "5")], some("(a.data::json->>'$.rating')::int>=5")),
        ("text_is_zero", [("annotation.label", "<", "1")], some("true")),
        ("text_not_positive", [("annotation.label", ">", "0")], "false"),
    ],
)
register_cases(
    "flt_data_contains",
    [
        ("en", [("data.text", "~=", "the ")], "contains(d.text,'the ')"),
        ("case", [("data.text", "~=", "The ")], "contains(d.text,'The ')"),
        ("literal", [("data.text", "~=", "%")], "contains(d.text,'%')"),
    ],
)
register_cases(
    "flt_data_contains_cast",
    [
        ("double", [("data.o_totalprice", "~=", "99.5")], "contains(d.o_totalprice::varchar,'99.5')"),
        ("no_zero", [("data.o_totalprice", "~=", ".0")], "contains(regexp_replace(d.o_totalprice::varchar,'\\.0$',''),'.0')"),
        ("bigint", [("data.o_custkey", "~=", "77")], "contains(d.o_custkey::varchar,'77')"),
        ("time", [("data.o_orderdate", "~=", "-28 00:00:00.000000")], "contains(strftime(d.o_orderdate,'%Y-%m-%d %H:%M:%S.%f'),'-28 00:00:00.000000')"),
    ],
    "orders",
)
register_cases(
    "flt_data_eq",
    [
        ("int", [("data.p_size", "=", "7")], "d.p_size=7"),
        ("double", [("data.p_retailprice", "=", "901")], "d.p_retailprice=901"),
        ("text", [("data.p_brand", "=", "Brand#2")], "d.p_brand='Brand#2'"),
        ("int_unparsable", [("data.p_size", "=", "7.0")], "false"),
    ],
    "part",
)
register_cases(
    "flt_data_ne",
    [
        ("int", [("data.p_size", "!=", "7")], "d.p_size<>7"),
        ("double", [("data.p_retailprice", "!=", "901.0")], "d.p_retailprice<>901"),
        ("text", [("data.p_brand", "!=", "Brand#2")], "d.p_brand<>'Brand#2'"),
        ("int_unparsable", [("data.p_size", "!=", "x")], "true"),
    ],
    "part",
)
register_cases(
    "flt_data_cmp",
    [
        ("gt", [("data.o_totalprice", ">", "400000.5")], "d.o_totalprice>400000.5"),
        ("int_fraction", [("data.o_custkey", "<=", "7.5")], "d.o_custkey<=7.5"),
        ("range", [("data.o_custkey", ">=", "10"), ("data.o_custkey", "<", "2e1")], "d.o_custkey>=10 AND d.o_custkey<20"),
        ("text_never", [("data.o_orderstatus", ">", "1")], "false"),
        ("unparsable_never", [("data.o_custkey", ">", "x")], "false"),
    ],
    "orders",
)
register_cases(
    "flt_data_fallback",
    [
        ("bool_eq", [("data.big", "=", "True")], "d.big"),
        ("bool_eq_lower", [("data.big", "=", "true")], "false"),
        ("bool_ne", [("data.big", "!=", "True")], "NOT d.big"),
        ("bool_contains", [("data.big", "~=", "fal")], "NOT d.big"),
        ("bool_gt", [("data.big", ">", "0.5")], "d.big"),
        ("time_eq", [("data.l_shipdate", "=", "1998-01-05 00:00:00")], "d.l_shipdate=TIMESTAMP '1998-01-05'"),
        ("time_never", [("data.l_shipdate", ">", "1")], "false"),
        ("date_eq", [("data.day", "=", "1998-01-05")], "d.day=DATE '1998-01-05'"),
        ("decimal_eq", [("data.tax", "=", "0.050")], "d.tax=0.05"),
        ("decimal_scale", [("data.tax", "=", "0.05")], "false"),
        ("decimal_gt", [("data.tax", ">", "0.0755")], "d.tax>0.0755"),
    ],
    "lineitem",
)
register_cases(
    "flt_and",
    [
        (
            "all_kinds",
            [
                ("data.lang", "=", "en"), ("annotation.label", "=", "click"), ("annotations.count", ">", "1"),
                ("row_index", "<", "90"), ("nobody.knows", "=", "1"), ("annotations.annotated_by", "=", "u3", "OR"),
            ],
            f"d.lang='en' AND {CLICKED} AND {count_is('> 1')} AND d.row_index<90 AND {BY_U3}",
        ),
        (
            "zero_and_text",
            [("annotations.count", "=", "0"), ("data.text", "~=", "the "), ("data.n_chars", ">", "500")],
            "d.row_index NOT IN (SELECT row_index FROM ann) AND contains(d.text,'the ') AND d.n_chars>500",
        ),
        ("zero_and_some", [("annotations.count", "=", "0"), ("annotation.label", "=", "click")], "false"),
    ],
)
register_cases(
    "flt_or",
    [
        (
            "mixed",
            [("data.lang", "=", "de"), ("annotations.annotated_by", "=", "me", "OR"), ("row_index", "<", "500", "AND")],
            f"(d.lang='de' OR {BY_ME}) AND d.row_index<500",
        ),
        (
            "zero_or_score",
            [("annotations.count", "=", "0", "OR"), ("annotation.score", ">", "200", "OR")],
            f"d.row_index NOT IN (SELECT row_index FROM ann) OR {HIGH_SCORE}",
        ),
        (
            "count_or_text",
            [("annotations.count", "!=", "3"), ("data.text", "~=", "%", "OR")],
            f"{count_is('<> 3')} OR contains(d.text,'%')",
        ),
    ],
    with_or=True,
)




def stored_with_grams(spark, sf, name, rows, fields):
    """A table stored by small blocks with n-gram filters, once per session."""
    path = fx.stored(spark, sf, name, lambda p: store_with_grams(rows(), p, fields, GramSettings(block=128, bits=1 << 18)))
    return open_grams(spark, path)


_RARE = "(SELECT substr(text, 200, 24) FROM documents WHERE doc_id=77)"


@query(
    "gram_data_contains",
    f"""SELECT 'rare' AS case_name, row_index FROM dataset WHERE contains(text, {_RARE})
        UNION ALL SELECT 'common', row_index FROM dataset WHERE contains(text, 'the ')
        UNION ALL SELECT 'short', row_index FROM dataset WHERE contains(text, '%')
        UNION ALL SELECT 'both', row_index FROM dataset WHERE contains(text, {_RARE}) AND contains(text, 'nd')""",
)
def gram_data_contains(spark, sf):
    """Texts found through the filter; the rare one is a passage of a document."""
    table = stored_with_grams(spark, sf, "dataset-grams", lambda: fx.dataset(spark, sf), ["data.text"])
    rare = fx.dataset(spark, sf).where("row_index = 77").select(F.substring("text", 200, 24)).first()[0]
    cases = {"rare": [rare], "common": ["the "], "short": ["%"], "both": [rare, "nd"]}
    parts = []
    for case, values in cases.items():
        exprs = [FilterExpr("data.text", "~=", value) for value in values]
        found = filter_rows(narrowed(table, exprs), fx.project_rows(spark, sf), exprs, fx.ME, fx.NOW)
        parts.append(found.select(F.lit(case).alias("case_name"), "row_index"))
    return reduce(DataFrame.unionByName, parts)


@query(
    "gram_label_contains",
    " UNION ALL ".join(
        f"SELECT '{case}' AS case_name, d.row_index FROM dataset d WHERE {some(condition)}"
        for case, condition in (
            ("case", "(a.data::json->>'$.label') ILIKE '%LICK%'"),
            ("wildcard", "(a.data::json->>'$.label') ILIKE '%pur_has%'"),
            ("short", "(a.data::json->>'$.label') ILIKE '%ic%'"),
            ("missing", "(a.data::json->>'$.label') ILIKE '%nobody%'"),
        )
    ),
)
def gram_label_contains(spark, sf):
    table = stored_with_grams(spark, sf, "label-grams", lambda: fx.project_rows(spark, sf), ["annotation.label"])
    parts = []
    for case, value in (("case", "LICK"), ("wildcard", "pur_has"), ("short", "ic"), ("missing", "nobody")):
        expr = FilterExpr("annotation.label", "~=", value)
        found = filter_rows(fx.dataset(spark, sf), narrowed(table, [expr]), [expr], fx.ME, fx.NOW)
        parts.append(found.select(F.lit(case).alias("case_name"), "row_index"))
    return reduce(DataFrame.unionByName, parts)


def register_bitmaps(name: str, of: str) -> None:
    """The cases of a query of filters, found by bitmaps: each with its rows, and the total counted in bits."""
    cases, load, with_or = FILTER_CASES[of]
    union = " UNION ALL ".join(
        f"SELECT '{case}' AS case_name, d.row_index, count(*) OVER () AS total FROM dataset d WHERE {condition}" for case, _, condition in cases
    )

    def run(spark, sf) -> DataFrame:
        data, ann = load(spark, sf), fx.project_rows(spark, sf)
        parts = []
        for case, exprs, _ in cases:
            bits = settle(filter_bitmaps(data, ann, _exprs(exprs), fx.ME, fx.NOW, with_or), "case-bitmaps")
            total = bits.agg(F.coalesce(F.sum(bit_total(F.col("bits"))), F.lit(0)).alias("total"))
            parts.append(rows_of_bitmaps(bits).select(F.lit(case).alias("case_name"), "row_index").join(F.broadcast(total)))
        return reduce(DataFrame.unionByName, parts)

    query(name, union)(run)


register_bitmaps("bitmap_and", "flt_and")
register_bitmaps("bitmap_or", "flt_or")


@query(
    "bitmap_page",
    f"""WITH hit AS (SELECT d.row_index FROM dataset d WHERE d.lang='en' OR {BY_ME} OR {count_is('> 3')})
      SELECT row_index, (SELECT count(*) FROM hit) AS total FROM hit ORDER BY row_index LIMIT 50 OFFSET 50""",
)
def bitmap_paged(spark, sf):
    exprs = _exprs([("data.lang", "=", "en"), ("annotations.annotated_by", "=", "me", "OR"), ("annotations.count", ">", "3", "OR")])
    page = bitmap_page(filter_bitmaps(fx.dataset(spark, sf), fx.project_rows(spark, sf), exprs, fx.ME, fx.NOW, with_or=True), 2)
    return page.rows.select("row_index", F.lit(page.total).cast("bigint").alias("total"))


@query(
    "flt_projects",
    "SELECT project_id, name, tags FROM projects WHERE contains(lower(name),'supplier#00') AND contains(lower(tags),'asia, batch 1')",
)
def flt_projects(spark, sf):
    return search_projects(fx.projects(spark, sf), "SUPPLIER#00", "Asia, Batch 1").select("project_id", "name", "tags")


@query(
    "flt_catalog_search",
    "SELECT dataset_id, name, source FROM catalog WHERE coalesce(contains(lower(name),'page 1'),false) OR contains(lower(source),'page 1') OR contains(lower(name),'page 1')",
)
def flt_catalog_search(spark, sf):
    return search_catalog(fx.catalog(spark, sf), "PAGE 1").select("dataset_id", "name", "source")


@query(
    "index_intersect",
    """SELECT row_index FROM dataset WHERE lang='en' INTERSECT SELECT row_index FROM ann
       INTERSECT SELECT row_index FROM ml_annotations""",
)
def index_intersect(spark, sf):
    return intersect_rows(
        fx.dataset(spark, sf).where("lang = 'en'"), fx.project_rows(spark, sf), fx.ml_annotations(spark, sf)
    )


@query("distinct_rows", "SELECT DISTINCT row_index FROM annotations")
def distinct(spark, sf):
    return distinct_rows(fx.submissions(spark, sf))


@query(
    "relative_time",
    """SELECT event_id, CASE WHEN u='x' THEN v ELSE
         strftime(TIMESTAMP '2024-01-31' - to_seconds(a*CASE u WHEN 'm' THEN 60 WHEN 'h' THEN 3600 WHEN 'd' THEN 86400
           WHEN 'M' THEN 2592000 ELSE 31536000 END), '%Y-%m-%dT%H:%M:%S') END AS threshold
       FROM (SELECT event_id, (props::json->>'$.k')::bigint AS a, ['m','h','d','M','Y','x'][1+event_id%6] AS u,
         (props::json->>'$.k')||['m','h','d','M','Y','x'][1+event_id%6] AS v FROM events)""",
)
def relative(spark, sf):
    unit = F.element_at(F.array(*[F.lit(u) for u in "mhdMYx"]), (1 + F.col("event_id") % 6).cast("int"))
    value = F.concat(F.get_json_object("props", "$.k"), unit)
    return fx.table(spark, sf, "events").select("event_id", relative_time(value, timestamp_literal(fx.NOW)).alias("threshold"))


@query(
    "json_path",
    """SELECT project_id, row_index, user_id, data::json->>'$.label' AS label, (data::json->>'$.score') AS score,
       data::json->>'$.none' AS missing FROM annotations""",
)
def json_paths(spark, sf):
    d = F.col("data")
    return fx.annotations(spark, sf).select(
        "project_id", "row_index", "user_id", json_text(d, "label").alias("label"), json_text(d, "score").alias("score"),
        json_text(d, "none").alias("missing"),
    )


@query(
    "typed_literal",
    """SELECT part_no, v, CASE WHEN contains(v,'.') AND try_cast(v AS double) IS NOT NULL THEN 'float'
         WHEN NOT contains(v,'.') AND try_cast(v AS bigint) IS NOT NULL THEN 'int' ELSE 'text' END AS kind,
         CASE WHEN contains(v,'.') OR try_cast(v AS bigint) IS NOT NULL THEN try_cast(v AS double) END AS number
       FROM (SELECT p_partkey AS part_no, [p_size::varchar, p_retailprice::varchar, p_name, p_brand][1+p_partkey%4] AS v FROM part)""",
)
def typed(spark, sf):
    choice = F.array(F.col("p_size").cast("string"), F.col("p_retailprice").cast("string"), "p_name", "p_brand")
    v = F.element_at(choice, (1 + F.col("p_partkey") % 4).cast("int"))
    rows = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("part_no"), v.alias("v"))
    return rows.select("part_no", "v", literal_kind(F.col("v")).alias("kind"), literal_number(F.col("v")).alias("number"))
