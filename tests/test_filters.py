"""Filter semantics, case by case, with rows worked out by hand."""

import math
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from annolytics.operators.browse import filter_rows, intersect_rows
from annolytics.operators.filters import FilterError, FilterExpr
from annolytics.functions.literals import time_threshold, typed_literal
from annolytics.functions.text import float_text

ANNOTATIONS = "project_id string, row_index bigint, user_id string, data string, created_at timestamp_ntz, updated_at timestamp_ntz"
PAYLOADS = [
    '{"v": "5"}', '{"v": 5}', '{"v": 5.0}', '{"v": true}', '{"v": false}', '{"v": null}', '{}', '{"v": "5 apples"}',
    '{"v": [1, 2]}', '{"v": {"a": "Pos"}}', '{"v": "positive"}', '{"v": 12.5}', '{"v": "-3e1x"}', '{"v": "50%"}', '{"v": 9007199254740993}',
]


def annotate(spark, rows):
    when = datetime(2024, 1, 30, 12)
    full = [("p", r[0], r[1], r[2], *(r[3:] or (when, when))) for r in rows]
    return spark.createDataFrame(full, ANNOTATIONS)


@pytest.fixture(scope="module")
def labelled(spark):
    data = spark.range(len(PAYLOADS)).select(F.col("id").alias("row_index")).cache()
    return data, annotate(spark, [(i, "a", p) for i, p in enumerate(PAYLOADS)]).cache()


def hits(data, ann, now, *exprs, me="me-user", with_or=False):
    rows = filter_rows(data, ann, [FilterExpr(*e) for e in exprs], me, now, with_or)
    return sorted(r["row_index"] for r in rows.collect())


@pytest.mark.parametrize(
    ("op", "value", "expected"),
    [
        ("=", "5", [1, 2]),
        ("=", "5.0", [1, 2]),
        ("=", "1", [3]),
        ("=", "0", [4]),
        ("=", "positive", [10]),
        ("=", "Positive", []),
        ("=", "[1,2]", [8]),
        ("=", "9007199254740992", []),
        ("=", "9007199254740993", [14]),
        ("!=", "5", [0, 3, 4, 7, 8, 9, 10, 11, 12, 13, 14]),
        ("!=", "positive", [0, 1, 2, 3, 4, 7, 8, 9, 11, 12, 13, 14]),
        ("~=", "POS", [9, 10]),
        ("~=", "5", [0, 1, 2, 7, 11, 13, 14]),
        ("~=", "%", [0, 1, 2, 3, 4, 7, 8, 9, 10, 11, 12, 13, 14]),
        ("~=", "p_s", [9, 10]),
        ("~=", "1", [3, 8, 11, 12, 14]),
        (">", "4.5", [0, 1, 2, 7, 11, 13, 14]),
        ("<=", "0", [4, 8, 9, 10, 12]),
        ("<", "-1", [12]),
        (">=", "1", [0, 1, 2, 3, 7, 11, 13, 14]),
        ("<", "nan", []),
    ],
)
def test_label_values(labelled, now, op, value, expected):
    assert hits(*labelled, now, ("annotation.v", op, value)) == expected


def test_label_paths(spark, now):
    data = spark.range(3).withColumnRenamed("id", "row_index")
    ann = annotate(spark, [(0, "a", '{"x": {"y": 7}}'), (1, "a", '{"x": [3, 7]}'), (2, "a", "not json")])
    assert hits(data, ann, now, ("annotation.x.y", "=", "7")) == [0]
    assert hits(data, ann, now, ("annotation.x[1]", ">", "6")) == [1]
    odd = annotate(spark, [(0, "a", '{"my field": {"a-b": "x%y"}}'), (1, "a", r'{"my field": {"a-b": "x\\y_z"}}'), (2, "a", '{"my field": 1}')])
    assert hits(data, odd, now, ("annotation.my field.a-b", "~=", "X")) == [0, 1]
    assert hits(data, odd, now, ("annotation.my field.a-b", "~=", "\\")) == [1]
    assert hits(data, odd, now, ("annotation.my field", "=", "1")) == [2]
    for path in ("annotation.a[", "annotation.a..b", "annotation.a[*]", "annotation..a"):
        with pytest.raises(FilterError):
            filter_rows(data, ann, [FilterExpr(path, "=", "1")], "me", now)


@pytest.fixture(scope="module")
def counted(spark):
    data = spark.range(6).select(F.col("id").alias("row_index"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("kind"))
    rows = [(1, u, '{"l":"x"}') for u in ("alice", "bob", "me-user")] + [(2, "alice", '{"l":"x"}'), (2, "bob", '{"l":"y"}'), (3, "bob", '{"l":"y"}')]
    return data.cache(), annotate(spark, rows).cache()


@pytest.mark.parametrize(
    ("op", "value", "expected"),
    [
        ("=", "0", [0, 4, 5]), ("<", "1", [0, 4, 5]), ("<=", "0", [0, 4, 5]),
        (">", "0", [1, 2, 3]), ("=", "2", [2]), ("!=", "3", [2, 3]), ("<", "3", [2, 3]), (">=", "0", [1, 2, 3]), ("!=", "0", [1, 2, 3]),
    ],
)
def test_counts(counted, now, op, value, expected):
    assert hits(*counted, now, ("annotations.count", op, value)) == expected


def test_annotators(counted, now):
    assert hits(*counted, now, ("annotations.annotated_by", "=", "me")) == [1]
    assert hits(*counted, now, ("annotations.annotated_by", "!=", "alice")) == [1, 2]


def test_each_test_asks_for_some_annotation(counted, now):
    """Alice labelled x and Bob y: both tests hold though no one annotation meets both."""
    assert hits(*counted, now, ("annotations.annotated_by", "=", "alice"), ("annotation.l", "=", "y")) == [2]


def test_zero_count_with_label_is_empty(counted, now):
    assert hits(*counted, now, ("annotations.count", "=", "0"), ("annotation.l", "=", "x")) == []


def test_conjunctions(counted, now):
    odd_or_alice = [("data.kind", "=", "odd"), ("annotations.annotated_by", "=", "alice", "OR")]
    assert hits(*counted, now, *odd_or_alice) == [1]
    assert hits(*counted, now, *odd_or_alice, with_or=True) == [1, 2, 3, 5]
    left_fold = [("row_index", "=", "0"), ("row_index", "=", "1", "OR"), ("data.kind", "=", "odd", "AND")]
    assert hits(*counted, now, *left_fold, with_or=True) == [1]
    first_ignored = [("row_index", ">", "3", "OR"), ("annotations.count", "=", "0", "AND")]
    assert hits(*counted, now, *first_ignored, with_or=True) == [4, 5]
    none_or_many = [("annotations.count", "=", "0"), ("annotations.count", ">", "2", "OR")]
    assert hits(*counted, now, *none_or_many, with_or=True) == [0, 1, 4, 5]


def test_ignored_fields(counted, now):
    everything = [0, 1, 2, 3, 4, 5]
    for expr in (("nobody", "=", "1"), ("data.", "=", "1"), ("annotation.", "=", "1"), ("annotations.other", "=", "1")):
        assert hits(*counted, now, expr) == everything
    assert hits(*counted, now, ("row_index", "~=", "1")) == everything
    assert hits(*counted, now, ("data.kind", "?", "1")) == everything
    assert hits(*counted, now, ("annotation.l", "?", "1")) == everything


def test_huge_numbers(counted, now):
    big = str(2**70)
    assert hits(*counted, now, ("row_index", "<", big)) == [0, 1, 2, 3, 4, 5]
    assert hits(*counted, now, ("row_index", "=", big)) == []
    assert hits(*counted, now, ("annotations.count", "<", big)) == [1, 2, 3]


@pytest.mark.parametrize(
    "expr",
    [
        ("data.nothing", "=", "1"), ("row_index", "=", "x"), ("annotations.count", "=", "1.5"), ("annotations.count", "~=", "1"),
        ("annotation.l", ">", "x"), ("annotations.created_at", "~=", "1h"), ("annotations.updated_at", ">", "soon"),
    ],
)
def test_mistakes_are_reported_before_a_job(counted, now, expr):
    with pytest.raises(FilterError):
        filter_rows(*counted, [FilterExpr(*expr)], "me", now)


def test_times(spark, now):
    data = spark.range(4).withColumnRenamed("id", "row_index")
    moments = [datetime(2024, 1, 30, 23, 30), datetime(2024, 1, 29), datetime(2023, 6, 1), datetime(2019, 5, 5)]
    ann = annotate(spark, [(i, "a", "{}", m, m) for i, m in enumerate(moments)])
    field = "annotations.created_at"
    assert hits(data, ann, now, (field, ">=", "1h")) == [0]
    assert hits(data, ann, now, (field, ">=", "45m")) == [0]
    assert hits(data, ann, now, ("annotations.updated_at", ">=", "2d")) == [0, 1]
    assert hits(data, ann, now, (field, ">=", "2020-01-01")) == [0, 1, 2]
    assert hits(data, ann, now, (field, ">=", "2099-01-01")) == []
    assert hits(data, ann, now, (field, "<", "8M")) == [2, 3]
    assert hits(data, ann, now, (field, "<", "9M")) == [3]
    assert hits(data, ann, now, (field, "<", "2Y")) == [3]
    assert hits(data, ann, now, (field, "<", "2020")) == [3]
    assert time_threshold("2024-01-30T12:00:00+02:00", now) == datetime(2024, 1, 30, 10)


COLUMNS = (
    "row_index bigint, n int, x double, f float, s string, b boolean, t timestamp_ntz, d date, m decimal(6,2), "
    "st struct<k:string,v:int>, ar array<int>, bin binary"
)
ROWS = [
    (0, 5, 1.0, 0.5, "five", True, datetime(2024, 1, 2), date(2024, 1, 2), Decimal("1.50"), ("a", 1), [1, 2], bytearray(b"raw")),
    (1, -7, math.nan, 1.5, "Five", False, datetime(2024, 1, 2, 3, 4, 5, 500000), date(2024, 2, 1), Decimal("2.00"), ("None", 2), [], bytearray(b"x")),
    (2, None, None, None, None, None, None, None, None, None, None, None),
    (3, 50, 1e20, -2.0, "100%", True, datetime(2023, 1, 1), date(2023, 1, 1), Decimal("-1.00"), ("b", 3), [5], bytearray(b"row")),
]


@pytest.fixture(scope="module")
def typed(spark):
    return spark.createDataFrame(ROWS, COLUMNS).cache(), annotate(spark, [(0, "a", "{}")]).cache()


@pytest.mark.parametrize(
    ("column", "op", "value", "expected"),
    [
        # strings: literal, case-sensitive substrings; ordering never matches
        ("s", "~=", "ive", [0, 1]), ("s", "~=", "%", [3]), ("s", "=", "five", [0]), ("s", "!=", "five", [1, 3]), ("s", ">", "1", []),
        # integers
        ("n", "=", "5", [0]), ("n", "!=", "5", [1, 3]), ("n", "~=", "5", [0, 3]), ("n", ">", "4.5", [0, 3]), ("n", "<=", "5", [0, 1]),
        ("n", "=", "5.0", []), ("n", "!=", "5.0", [0, 1, 2, 3]), ("n", "!=", "x", [0, 1, 2, 3]), ("n", "=", "None", [2]), ("n", "<", "x", []),
        # floats: not-a-number equals nothing and is never ordered
        ("x", "=", "1", [0]), ("x", "!=", "1", [1, 3]), ("x", ">", "0", [0, 3]), ("x", "<", "1e30", [0, 3]), ("x", "=", "nan", []),
        ("x", "!=", "nan", [0, 1, 3]), ("x", "~=", "1e+20", [3]), ("x", "~=", ".0", []), ("x", "~=", "nan", [1]), ("x", ">", "nan", []),
        ("f", "=", "0.5", [0]), ("f", ">=", "0.5", [0, 1]), ("f", "~=", "-2", [3]),
        # booleans compare as True and False and order as 1 and 0
        ("b", "=", "True", [0, 3]), ("b", "=", "true", []), ("b", "!=", "True", [1, 2]), ("b", "~=", "ru", [0, 3]), ("b", ">", "0.5", [0, 3]),
        ("b", "<=", "0", [1]),
        # times and dates compare as text and are never ordered
        ("t", "=", "2024-01-02 00:00:00", [0]), ("t", "=", "2024-01-02 03:04:05.500000", [1]), ("t", "!=", "2024-01-02 00:00:00", [1, 2, 3]),
        ("t", "~=", ".000000", [0, 3]), ("t", ">", "1", []), ("d", "=", "2024-02-01", [1]), ("d", "~=", "2024", [0, 1]), ("d", "<", "9", []),
        # decimals keep their scale as text and are ordered as numbers
        ("m", "=", "1.50", [0]), ("m", "=", "1.5", []), ("m", ">", "1.2", [0, 1]), ("m", "~=", ".0", [1, 3]), ("m", "!=", "1.50", [1, 2, 3]),
        # nested values compare as JSON, a null as the text None
        ("st", "=", '{"k":"a","v":1}', [0]), ("st", "~=", '"v":2', [1]), ("st", "~=", "None", [1, 2]), ("ar", "=", "[1,2]", [0]), ("ar", ">", "0", []),
        ("bin", "~=", "r", [0, 3]), ("bin", "=", "x", [1]),
    ],
)
def test_dataset_columns(typed, now, column, op, value, expected):
    assert hits(*typed, now, (f"data.{column}", op, value)) == expected


def test_column_names_with_dots(spark, now):
    data = spark.createDataFrame([(0, "x"), (1, "y")], "row_index bigint, `a.b` string")
    assert hits(data, annotate(spark, [(0, "a", "{}")]), now, ("data.a.b", "=", "y")) == [1]


def test_pushdown(spark, now, tmp_path):
    path = str(tmp_path / "ds")
    spark.range(100).selectExpr("id AS row_index", "cast(id AS int) AS n", "cast(id AS string) AS s").write.parquet(path)
    rows = filter_rows(
        spark.read.parquet(path), annotate(spark, [(0, "a", "{}")]),
        [FilterExpr("row_index", "<", "50"), FilterExpr("data.n", ">", "7"), FilterExpr("data.s", "~=", "1")], "me", now,
    )
    plan = rows._jdf.queryExecution().executedPlan().toString()
    for pushed in ("LessThan(row_index,50)", "GreaterThan(n,7)", "StringContains(s,1)"):
        assert pushed in plan


def test_many_annotation_tests_share_one_aggregate(counted, now):
    exprs = [FilterExpr("annotation.l", "=", "x"), FilterExpr("annotation.l", "~=", "y"), FilterExpr("annotations.count", ">", "1")]
    plan = filter_rows(*counted, exprs, "me", now)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1


def test_typed_literals():
    assert typed_literal("5").number == 5
    assert typed_literal("5.0").number == 5.0
    assert typed_literal("1.2.3").number is None
    assert typed_literal("1e5").number is None


def test_float_text(spark):
    cases = {1.0: "1", 0.1: "0.1", -0.0: "-0", 1e20: "1e+20", -1.25e20: "-1.25e+20", 1e-7: "1e-7", 1e-6: "0.000001", 1.5e-5: "0.000015",
             1234567.0: "1234567", 12345678.9: "12345678.9", 1e10: "1e+10", math.inf: "inf", -math.inf: "-inf", 100.0: "100", 0.00099: "0.00099"}
    rows = spark.createDataFrame([(v,) for v in cases], "v double").select(float_text(F.col("v"))).collect()
    assert [r[0] for r in rows] == list(cases.values())


def test_intersect(spark):
    sets = [spark.createDataFrame([(i,) for i in rows], "row_index bigint") for rows in ([1, 2, 2, 3], [2, 3, 4], [3, 2, 9])]
    assert sorted(r[0] for r in intersect_rows(*sets).collect()) == [2, 3]
