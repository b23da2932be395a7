"""Filters as bitmaps: a bit per dataset row, in blocks of 32,768 rows.

Each test gives a bitmap per block. AND, OR and NOT are then operations on words of 64 bits, totals and the place
of a page are sums of bit counts, and only the rows of a page become rows again. A test on annotations crosses the
shuffle as words, not as annotations or row numbers, combined by every task before. All of it is built-in functions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annolytics.operators.browse import PER_PAGE, Page, check_page, reads_payload, row_predicate
from annolytics.operators.filters import FilterExpr, annotation_predicate, count_predicate
from annolytics.session import settle

WORD = 64
BLOCK_WORDS = 512
#: Rows of a block.
BLOCK = WORD * BLOCK_WORDS


def row_bitmaps(rows: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """``(block, <test>...)``: for each test an array of 512 words, in which a row's bit is set if the test holds for any of its rows.

    A first aggregate gives words, which tasks combine before the shuffle; a second one puts the (at most 512) words of a block in their places.
    """
    index, names = F.col("row_index"), list(tests)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(index, F.lit(WORD)).cast("int"))
    words = rows.select(
        F.floor(index / F.lit(BLOCK)).cast("bigint").alias("block"),
        F.floor(F.pmod(index, F.lit(BLOCK)) / F.lit(WORD)).cast("int").alias("_word"),
        *[F.when(test, bit).otherwise(F.lit(0).cast("bigint")).alias(name) for name, test in tests.items()],
    )
    words = words.groupBy("block", "_word").agg(*[F.bit_or(name).alias(name) for name in names])
    held = words.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("_word", F.struct(*names)))).alias("_words"))
    places = F.sequence(F.lit(0), F.lit(BLOCK_WORDS - 1))
    zero = F.lit(0).cast("bigint")

    def words_of(name: str) -> Column:
        return F.transform(places, lambda i: F.coalesce(F.try_element_at("_words", i)[name], zero)).alias(name)

    return held.select("block", *[words_of(name) for name in names])


def _count_bitmaps(annotations: DataFrame, exprs: dict[str, FilterExpr]) -> DataFrame:
    """Bitmaps of tests on the number of a row's annotations, which needs a count per row first."""
    counts = annotations.groupBy("row_index").agg(F.count("*").alias("_n"))
    return row_bitmaps(counts, {name: count_predicate(expr, F.col("_n")) for name, expr in exprs.items()})


def _annotation_bitmaps(annotations: DataFrame, exprs: dict[str, FilterExpr], me: str, now: datetime) -> DataFrame:
    """Bitmaps of tests that some annotation of a row must meet, and of ``_any``."""
    source = annotations.withColumn("payload", F.try_parse_json("data")) if reads_payload(list(exprs.values())) else annotations
    return row_bitmaps(source, {"_any": F.lit(True), **{name: annotation_predicate(expr, me, now) for name, expr in exprs.items()}})


def filter_bitmaps(
    dataset: DataFrame, annotations: DataFrame, exprs: Sequence[FilterExpr], me: str, now: datetime, with_or: bool = False
) -> DataFrame:
    """``(block, bits)`` of the dataset rows that pass the filters, read as filter_rows reads them. Blocks without such rows may be missing.

    Row indices must be unique. With AND alone, tests on the dataset stay predicates of its scan.
    """
    active = [expr for expr in exprs if expr.kind != "ignored"]
    any_or = with_or and any(expr.conjunction.upper() == "OR" for expr in active[1:])
    own: dict[str, Column] = {"_rows": F.lit(True)}
    on_annotations, on_counts = {}, {}
    for i, expr in enumerate(active):
        predicate = row_predicate(expr, dataset)
        if predicate is not None and any_or:
            own[f"_t{i}"] = predicate
        elif predicate is not None:
            dataset = dataset.where(predicate)
        elif expr.kind == "annotation":
            on_annotations[f"_t{i}"] = expr
        elif not expr.wants_no_annotation:
            on_counts[f"_t{i}"] = expr
    bitmaps = row_bitmaps(dataset, own)
    if on_annotations or any(expr.wants_no_annotation for expr in active):
        bitmaps = bitmaps.join(_annotation_bitmaps(annotations, on_annotations, me, now), "block", "left")
    if on_counts:
        bitmaps = bitmaps.join(_count_bitmaps(annotations, on_counts), "block", "left")

    def word(name: str) -> Callable[[Column], Column]:
        # A block that one side lacks has no bit set there.
        return lambda i: F.coalesce(F.get(name, i), F.lit(0).cast("bigint"))

    def test(k: int, i: Column) -> Column:
        return F.bitwise_not(word("_any")(i)) if active[k].wants_no_annotation else word(f"_t{k}")(i)

    def verdict(i: Column) -> Column:
        tested = [k for k, expr in enumerate(active) if any_or or expr.kind in ("count", "annotation")]
        out = None
        for k in tested:
            if out is None:
                out = test(k, i)
            elif any_or and active[k].conjunction.upper() == "OR":
                out = out.bitwiseOR(test(k, i))
            else:
                out = out.bitwiseAND(test(k, i))
        return word("_rows")(i) if out is None else word("_rows")(i).bitwiseAND(out)

    return bitmaps.select("block", F.transform(F.sequence(F.lit(0), F.lit(BLOCK_WORDS - 1)), verdict).alias("bits"))


def bit_total(bits: Column) -> Column:
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda total, word: total + F.bit_count(word))


def rows_of_bitmaps(bitmaps: DataFrame) -> DataFrame:
    """``row_index`` of every set bit."""
    words = bitmaps.select("block", F.posexplode("bits").alias("_at", "_word")).where("_word <> 0")
    start = F.col("block") * BLOCK + F.col("_at") * WORD
    is_set = lambda b: F.call_function("getbit", F.col("_word"), b) == 1
    return words.select(F.explode(F.transform(F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), is_set), lambda b: start + b)).alias("row_index"))


def bitmap_page(bitmaps: DataFrame, page: int = 1, per_page: int = PER_PAGE) -> Page:
    """A page of the rows of bitmaps, by row_index, with the total, as browse.page_keys gives it.

    Bitmaps are stored once: a bit per row. Counts per block give the total and the blocks of the page, and only their bits become rows.
    """
    check_page(page, per_page)
    first, last = (page - 1) * per_page, page * per_page
    stored = settle(bitmaps.withColumn("n", bit_total(F.col("bits"))).where("n > 0"), "bitmaps")
    running = Window.orderBy("block")
    blocks = stored.select("block", "n", (F.sum("n").over(running) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    told = blocks.agg(F.max("total").alias("total")).first()
    on_page = blocks.where((F.col("before") + F.col("n") > first) & (F.col("before") < last))
    rows = rows_of_bitmaps(stored.select("block", "bits").join(on_page, "block", "left_semi"))
    within = Window.partitionBy("block").orderBy("row_index")
    placed = rows.withColumn("block", F.floor(F.col("row_index") / F.lit(BLOCK)).cast("bigint")).join(on_page, "block")
    placed = placed.withColumn("place", F.col("before") + F.row_number().over(within) - 1)
    keys = settle(placed.where(F.col("place").between(first, last - 1)).select("row_index"), "page")
    found = keys.agg(F.min("row_index").alias("low"), F.max("row_index").alias("high")).first()
    return Page(keys, found["low"], found["high"], told["total"] or 0)
