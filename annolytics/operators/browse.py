"""Browsing: filters compiled to one plan, pages, row status and previews.

A list of filter expressions becomes dataset predicates (pushed into the scan) and at most one
aggregate over the project's annotations, however many annotation tests it has.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annolytics.functions.text import quoted
from annolytics.operators.annotations import ROW_BLOCK
from annolytics.operators.filters import (
    FilterError,
    FilterExpr,
    annotation_predicate,
    count_predicate,
    data_predicate,
    row_index_predicate,
)
from annolytics.operators.payloads import overlay_fields
from annolytics.operators.projections import display_map, with_binary_refs
from annolytics.operators.status import annotations_per_row, row_status
from annolytics.plans.ranking import BLOCK
from annolytics.session import settle

PER_PAGE = 50


def project_annotations(annotations: DataFrame, project_id: str) -> DataFrame:
    return annotations.where(F.col("project_id") == project_id)


def row_predicate(expr: FilterExpr, dataset: DataFrame) -> Column | None:
    if expr.kind == "row":
        return row_index_predicate(expr)
    if expr.kind == "data":
        return data_predicate(expr, dataset.schema)
    return None


def annotation_flags(
    annotations: DataFrame, exprs: Sequence[FilterExpr], me: str, now: datetime
) -> DataFrame:
    """One row per annotated row: its count ``_n`` and ``_f<i>``, whether test i holds for any.

    The tests are evaluated per annotation and combined map-side, so a row with very many
    annotations sends one partial result per task.
    """
    tests = {
        f"_f{i}": annotation_predicate(expr, me, now)
        for i, expr in enumerate(exprs)
        if expr.kind == "annotation"
    }
    source = annotations.withColumn("payload", F.try_parse_json("data")) if reads_payload(exprs) else annotations
    return (
        source.select("row_index", *[test.alias(name) for name, test in tests.items()])
        .groupBy("row_index")
        .agg(F.count("*").alias("_n"), *[F.bool_or(name).alias(name) for name in tests])
    )


def reads_payload(exprs: Sequence[FilterExpr]) -> bool:
    return any(e.kind == "annotation" and e.field.startswith("annotation.") for e in exprs)


def _flag(i: int, expr: FilterExpr) -> Column:
    """Test ``i`` over the columns of annotation_flags; false for a row that has none."""
    if expr.wants_no_annotation:
        return F.col("_n").isNull()
    holds = count_predicate(expr, F.col("_n")) if expr.kind == "count" else F.col(f"_f{i}")
    return F.coalesce(holds, F.lit(False))


def filter_rows(
    dataset: DataFrame,
    annotations: DataFrame,
    exprs: Sequence[FilterExpr],
    me: str,
    now: datetime,
    with_or: bool = False,
) -> DataFrame:
    """The dataset rows that pass the filters.

    ``annotations`` are those of one project. All expressions are joined by AND, whatever their
    conjunction says, unless ``with_or`` is set: then they are read left to right without
    precedence and the first conjunction is ignored. Unknown fields are ignored.
    """
    active = [expr for expr in exprs if expr.kind != "ignored"]
    if with_or and any(expr.conjunction.upper() == "OR" for expr in active[1:]):
        return _filter_any(dataset, annotations, active, me, now)

    for expr in active:
        predicate = row_predicate(expr, dataset)
        if predicate is not None:
            dataset = dataset.where(predicate)
    tests = [expr for expr in active if expr.kind in ("count", "annotation")]
    if not tests:
        return dataset
    flags = annotation_flags(annotations, tests, me, now)
    wanted = [_flag(i, expr) for i, expr in enumerate(tests) if not expr.wants_no_annotation]
    if wanted:
        passing = flags
        for test in wanted:
            passing = passing.where(test)
        dataset = dataset.join(passing.select("row_index"), "row_index", "left_semi")
    if len(wanted) < len(tests):
        dataset = dataset.join(flags.select("row_index"), "row_index", "left_anti")
    return dataset


def _filter_any(
    dataset: DataFrame, annotations: DataFrame, exprs: Sequence[FilterExpr], me: str, now: datetime
) -> DataFrame:
    columns = dataset.columns
    if any(expr.kind in ("count", "annotation") for expr in exprs):
        dataset = dataset.join(annotation_flags(annotations, exprs, me, now), "row_index", "left")
    verdict: Column | None = None
    for i, expr in enumerate(exprs):
        test = row_predicate(expr, dataset)
        test = _flag(i, expr) if test is None else F.coalesce(test, F.lit(False))
        if verdict is None:
            verdict = test
        elif expr.conjunction.upper() == "OR":
            verdict = verdict | test
        else:
            verdict = verdict & test
    return dataset.where(verdict).select(*[quoted(name) for name in columns])


def intersect_rows(*row_sets: DataFrame) -> DataFrame:
    """Row indices in every set, as a chain of semi joins."""
    result = distinct_rows(row_sets[0])
    for other in row_sets[1:]:
        result = result.join(distinct_rows(other), "row_index", "left_semi")
    return result


def distinct_rows(rows: DataFrame) -> DataFrame:
    return rows.select("row_index").distinct()


# --- pages -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Page:
    """The row indices of one page as a table, their bounds, and the total before paging.

    Bounds and total are three numbers whatever the page holds; an empty page has none and total 0.
    """

    rows: DataFrame
    low: int | None
    high: int | None
    total: int


def check_page(page: int, per_page: int) -> None:
    if page < 1 or per_page < 1:
        raise FilterError("page and per_page start at 1")


def page_rows(rows: DataFrame, page: int = 1, per_page: int = PER_PAGE) -> DataFrame:
    """``(row_index, total)`` of one page, lazily and at a cost that does not grow with the page.

    A count per block of row indices gives the total and the few blocks the page lies in; only
    rows of those blocks are then ranked, each block by itself, so pages may be of any size. A row with an index that occurs twice counts twice.
    """
    check_page(page, per_page)
    first, last = (page - 1) * per_page, page * per_page
    cut = rows.select("row_index", F.floor(F.col("row_index") / F.lit(BLOCK)).alias("_block"))
    ordered = Window.orderBy("_block")
    blocks = cut.groupBy("_block").agg(F.count("*").alias("_n"))
    blocks = blocks.select(
        "_block",
        "_n",
        (F.sum("_n").over(ordered) - F.col("_n")).alias("_before"),
        F.sum("_n").over(Window.partitionBy()).alias("total"),
    )
    on_page = blocks.where((F.col("_before") + F.col("_n") > first) & (F.col("_before") < last))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_block").orderBy("row_index")) - 1
    ranked = cut.join(on_page, "_block").withColumn("_place", place)
    return ranked.where(F.col("_place").between(first, last - 1)).select("row_index", "total")


def page_keys(rows: DataFrame, page: int = 1, per_page: int = PER_PAGE) -> Page:
    """A page, stored once, so that filters are not evaluated again for what is looked up by it."""
    keys = settle(page_rows(rows, page, per_page), "page")
    found = keys.agg(F.min("row_index").alias("low"), F.max("row_index").alias("high"), F.max("total").alias("total")).first()
    return Page(keys.select("row_index").distinct(), found["low"], found["high"], found["total"] or 0)


def browse_page(rows: DataFrame, page: int = 1, per_page: int = PER_PAGE) -> DataFrame:
    """One page of rows by row_index."""
    return rows_at(rows, page_keys(rows, page, per_page)).orderBy("row_index")


def rows_at(df: DataFrame, page: Page) -> DataFrame:
    """Rows of a page. Its bounds go into the scan; stored row blocks outside them are not opened."""
    if page.low is None:
        return df.where(F.lit(False))
    within = df.where(F.col("row_index").between(page.low, page.high))
    if "row_block" in df.columns:
        within = within.where(F.col("row_block").between(page.low // ROW_BLOCK, page.high // ROW_BLOCK))
    return within.join(page.rows, "row_index", "left_semi")


def page_count(total: Column, per_page: int = PER_PAGE) -> Column:
    return F.ceil(total / F.lit(per_page))


# --- lookups and the decorated page -----------------------------------------------------------


def row_lookup(dataset: DataFrame, keys: DataFrame) -> DataFrame:
    """Dataset rows for a table of row indices; duplicates in the request are answered once."""
    return dataset.join(distinct_rows(keys), "row_index", "left_semi")


def annotation_lookup(requests: DataFrame, annotations: DataFrame) -> DataFrame:
    """Annotations for requested (project_id, row_index, user_id) keys."""
    return requests.join(annotations, ["project_id", "row_index", "user_id"])


def ml_annotation_lookup(requests: DataFrame, ml_annotations: DataFrame) -> DataFrame:
    """Model annotations for requested (project_id, row_index) keys."""
    return requests.join(ml_annotations, ["project_id", "row_index"])


def page_annotations(annotations: DataFrame, page: Page) -> DataFrame:
    """The annotations of a page's rows, a row each: ``(row_index, author_id, data, created_at, updated_at)``."""
    found = rows_at(annotations, page)
    return found.select("row_index", F.col("user_id").alias("author_id"), "data", "created_at", "updated_at")


def decorate_rows(
    dataset: DataFrame, annotations: DataFrame, page: Page, me: str, dataset_id: str = ""
) -> DataFrame:
    """The rows of a page with preview, annotations, status and total.

    Both tables are cut to the page's bounds in their scans before anything is joined, and the page's
    annotations are stored once for all that is made of them. Binary columns show their
    addresses; their bytes are not read. A page has one row per dataset row, whatever the number of its annotations, which are one value;
    page_annotations gives them as rows.
    """
    dataset = with_binary_refs(dataset, F.lit(dataset_id))
    rows = rows_at(dataset, page)
    mine = settle(rows_at(annotations, page), "page-annotations")
    fields = [c for c in dataset.columns if c != "row_index"]
    preview = F.map_concat(
        # A label that is null hides the value it stands over.
        F.transform_values("_base", lambda k, v: F.when(F.map_contains_key("_overlay", k), F.try_element_at("_overlay", k)).otherwise(v)),
        F.map_filter("_overlay", lambda k, v: ~F.array_contains(F.map_keys("_base"), k)),
    )
    return (
        rows.select("row_index", display_map(dataset, fields).alias("_base"))
        .join(overlay_fields(mine), "row_index", "left")
        .join(annotations_per_row(mine), "row_index", "left")
        .join(row_status(mine, me), "row_index", "left")
        .select(
            "row_index",
            F.when(F.col("_overlay").isNull(), F.col("_base")).otherwise(preview).alias("preview"),
            "annotations",
            F.coalesce("by_me", F.lit(False)).alias("by_me"),
            F.coalesce("by_any", F.lit(False)).alias("by_any"),
            F.coalesce("annotators", F.array().cast("array<string>")).alias("annotators"),
            F.lit(page.total).cast("bigint").alias("total"),
        )
    )


def browse_rows(
    dataset: DataFrame,
    annotations: DataFrame,
    exprs: Sequence[FilterExpr],
    me: str,
    now: datetime,
    page: int = 1,
    per_page: int = PER_PAGE,
    with_or: bool = False,
    dataset_id: str = "",
    by_bitmaps: bool = False,
) -> DataFrame:
    """One page of filtered rows with their annotations and status.

    ``by_bitmaps`` finds the page by bitmaps instead of joins, for unique row indices: same rows, less to shuffle where
    tests on annotations pass many rows.
    """
    if by_bitmaps:
        from annolytics.operators.bitmaps import bitmap_page, filter_bitmaps

        keys = bitmap_page(filter_bitmaps(dataset, annotations, exprs, me, now, with_or), page, per_page)
    else:
        keys = page_keys(filter_rows(dataset, annotations, exprs, me, now, with_or).select("row_index"), page, per_page)
    return decorate_rows(dataset, annotations, keys, me, dataset_id)
