"""Filters as bitmaps against the plan of joins."""

import random

import pytest
from pyspark.sql import functions as F

from annolytics.operators import bitmaps as bm
from annolytics.operators import browse
from annolytics.operators.filters import FilterExpr
from tests.test_filters import annotate
from workload import fixtures as fx
from workload.filter_queries import FILTER_CASES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    """Rows over several blocks, of which a third of the annotations are on one."""
    rng = random.Random(3)
    rows = sorted(rng.sample(range(200_000), 1500) + [0, 63, 64, 32_767, 32_768, 5_000_000_000])
    data = spark.createDataFrame([(i, f"t{i % 7}", i % 5) for i in rows], "row_index bigint, text string, n int")
    pairs = {(rng.choice(rows), f"u{rng.randrange(6)}") for _ in range(900)} | {(rows[3], f"u{i}") for i in range(500)}
    pairs |= {(rows[0] + 1_000_000 + i, "u1") for i in range(20)}
    labels = annotate(spark, [(r, u, f'{{"v": {r % 4}}}') for r, u in sorted(pairs)])
    return data.cache(), labels.cache()


FILTERS = [
    ([], False),
    ([("annotations.count", "=", "0")], False),
    ([("annotations.count", ">", "1"), ("data.n", "=", "3")], False),
    ([("annotations.annotated_by", "=", "u1"), ("annotation.v", "=", "2"), ("row_index", "<", "150000")], False),
    ([("annotations.count", "=", "0"), ("annotations.annotated_by", "=", "u1")], False),
    ([("data.n", "=", "1"), ("annotation.v", "=", "2", "OR")], True),
    ([("annotations.count", "<", "1"), ("data.text", "~=", "t3", "OR"), ("annotations.count", "!=", "2", "AND")], True),
    ([("annotations.count", ">=", "2"), ("annotations.count", "=", "0", "OR"), ("nobody", "=", "1", "OR")], True),
    ([("data.n", "=", "9")], False),
]


@pytest.mark.parametrize(("parts", "with_or"), FILTERS)
def test_bitmaps_equal_joins(tables, now, parts, with_or):
    data, labels = tables
    exprs = [FilterExpr(*p) for p in parts]
    want = sorted(r[0] for r in browse.filter_rows(data, labels, exprs, "u2", now, with_or).select("row_index").collect())
    bits = bm.filter_bitmaps(data, labels, exprs, "u2", now, with_or)
    assert sorted(r[0] for r in bm.rows_of_bitmaps(bits).collect()) == want
    for page in (1, 2, 40):
        keys = bm.bitmap_page(bits, page, 30)
        part = want[(page - 1) * 30 : page * 30]
        assert sorted(r[0] for r in keys.rows.collect()) == part
        assert (keys.low, keys.high, keys.total) == (part[0] if part else None, part[-1] if part else None, len(want))
    got = browse.browse_rows(data, labels, exprs, "u2", now, 1, 30, with_or, by_bitmaps=True)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, browse.browse_rows(data, labels, exprs, "u2", now, 1, 30, with_or).collect()))


@pytest.mark.parametrize("name", sorted(FILTER_CASES))
def test_every_filter_fixture(spark, name):
    cases, load, with_or = FILTER_CASES[name]
    data, labels = load(spark, SF), fx.project_rows(spark, SF)
    for case, parts, _ in cases:
        exprs = [FilterExpr(*p) for p in parts]
        want = browse.filter_rows(data, labels, exprs, fx.ME, fx.NOW, with_or).select("row_index")
        got = bm.rows_of_bitmaps(bm.filter_bitmaps(data, labels, exprs, fx.ME, fx.NOW, with_or))
        # Some of these tables have an index twice, which a bitmap has once.
        assert sorted(r[0] for r in got.collect()) == sorted({r[0] for r in want.collect()}), case


def shuffled(spark, df):
    """Bytes that running a plan writes to the shuffle."""
    store = spark.sparkContext._jsc.sc().statusStore()
    total = lambda: store.executorSummary("driver").totalShuffleWrite()
    before = total()
    df.write.format("noop").mode("overwrite").save()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return total() - before


def test_bitmaps_shuffle_less(spark, now):
    """With annotations in the order a table stores them in."""
    data = spark.range(600_000).select(F.col("id").alias("row_index"), (F.col("id") % 3).alias("n"))
    labels = spark.range(1_200_000).select(
        F.lit("p").alias("project_id"), F.floor(F.col("id") / 2).alias("row_index"), F.concat(F.lit("u"), F.col("id") % 5).alias("user_id"),
        F.lit(now).cast("timestamp_ntz").alias("created_at"), F.lit(now).cast("timestamp_ntz").alias("updated_at"), F.lit("{}").alias("data"),
    )
    exprs = [FilterExpr("annotations.annotated_by", "=", "u1"), FilterExpr("annotations.annotated_by", "=", "u2"), FilterExpr("data.n", "=", "1")]
    joined = browse.filter_rows(data, labels, exprs, "me", now)
    bits = bm.filter_bitmaps(data, labels, exprs, "me", now)
    assert bits.agg(F.sum(bm.bit_total(F.col("bits")))).first()[0] == joined.count() > 1000
    assert shuffled(spark, bits) < shuffled(spark, joined) / 2
