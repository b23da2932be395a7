"""Each annotator's own order of the rows, and the work queue it defines.

The order is the keyed shuffle of functions/permutation.py. The row at a position and the
position of a row are computed from the row alone, so no operator here sorts or even reads the
dataset: all they need is its number of rows, which the catalog holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annolytics.functions.permutation import order_seed, position_of, row_at
from annolytics.operators.status import row_detail

# Queue positions generated per task row; a user with many annotations spans many such blocks.
CANDIDATE_BLOCK = 10_000


def user_row_order(dataset: DataFrame, user_id: Column, salt: Column, num_rows: int) -> DataFrame:
    """Dataset rows with ``order_position``, their place in the user's order. No shuffle."""
    return dataset.withColumn(
        "order_position", position_of(F.col("row_index"), order_seed(user_id, salt), num_rows)
    )


def label_queue(users: DataFrame, annotations: DataFrame, salt: Column, num_rows: int, k: int) -> DataFrame:
    """The next ``k`` un-annotated rows of every user: ``(user_id, queue_no, row_index)``.

    ``users`` has one row per user, ``annotations`` are those of the project. A user's annotated
    positions are counted by their number of binary digits, at most 64 counts whatever the user
    has annotated. These tell how many of the first positions, one less than a power of two, hold k free
    ones: at most about twice as many candidates as needed, and never users times rows. The
    candidates of one user are generated in blocks and meet the annotated positions by user and
    position, so no task handles all of a busy user's.
    """
    seed = order_seed(F.col("user_id"), salt)
    # A row outside the dataset has no place in the order.
    annotations = annotations.where(F.col("row_index").between(0, num_rows - 1))
    taken = annotations.select("user_id", position_of(F.col("row_index"), seed, num_rows).alias("_position"))
    digits = (F.length(F.bin(F.col("_position") + 1)) - 1).alias("bits")
    counted = taken.groupBy("user_id", digits).agg(F.count("*").alias("n"))
    spread = counted.groupBy("user_id").agg(F.collect_list(F.struct("bits", "n")).alias("_spread"))
    # The first 2^i - 1 positions are those with fewer than i digits beyond the first.
    enough = F.expr(
        f"""filter(sequence(0, 62), i -> shiftleft(1L, i) - 1
            - aggregate(filter(_spread, x -> x.bits < i), 0L, (sum, x) -> sum + x.n) >= {int(k)})"""
    )
    needed = (
        users.select("user_id")
        .join(spread, "user_id", "left")
        .withColumn("_spread", F.coalesce("_spread", F.expr("cast(array() AS array<struct<bits: int, n: bigint>>)")))
        .withColumn("_i", F.try_element_at(enough, F.lit(1)))
    )
    needed = needed.withColumn("_needed", F.least(F.coalesce(F.expr("shiftleft(1L, _i) - 1"), F.lit(num_rows)), F.lit(num_rows)).cast("bigint"))
    needed = needed.where(F.col("_needed") > 0)
    blocks = needed.select(
        "user_id",
        "_needed",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_needed") - 1, F.lit(CANDIDATE_BLOCK).cast("bigint"))).alias("_from"),
    ).repartition("user_id", "_from")
    last = F.least(F.col("_from") + CANDIDATE_BLOCK, F.col("_needed")) - 1
    candidates = blocks.select("user_id", F.explode(F.sequence("_from", last)).alias("_position"))
    free = candidates.join(taken, ["user_id", "_position"], "left_anti")
    nearest = Window.partitionBy("user_id").orderBy("_position")
    return (
        free.withColumn("queue_no", F.row_number().over(nearest))
        .where(F.col("queue_no") <= k)
        .select("user_id", "queue_no", row_at(F.col("_position"), seed, num_rows).alias("row_index"))
    )


def next_row(users: DataFrame, annotations: DataFrame, salt: Column, num_rows: int) -> DataFrame:
    """Every user's next row, null for a user who has annotated all: ``(user_id, row_index)``."""
    first = label_queue(users, annotations, salt, num_rows, 1).select("user_id", "row_index")
    return users.select("user_id").join(first, "user_id", "left")


def navigate(current: DataFrame, salt: Column, num_rows: int) -> DataFrame:
    """For (user_id, row_index) the rows before and after it in the user's order, null at the ends.

    A row outside the dataset has neither. No shuffle, no window.
    """
    seed = order_seed(F.col("user_id"), salt)
    valid = F.col("row_index").between(0, num_rows - 1)
    at = current.withColumn(
        "_at", position_of(F.when(valid, F.col("row_index")).otherwise(F.lit(0)), seed, max(num_rows, 1))
    )
    before = row_at(F.greatest(F.col("_at") - 1, F.lit(0)), seed, max(num_rows, 1))
    after = row_at(F.least(F.col("_at") + 1, F.lit(num_rows - 1)), seed, max(num_rows, 1))
    return (
        at.withColumns({"_before": before, "_after": after})
        .withColumn("prev_row", F.when(valid & (F.col("_at") > 0), F.col("_before")))
        .withColumn("next_row", F.when(valid & (F.col("_at") < num_rows - 1), F.col("_after")))
        .drop("_at", "_before", "_after")
    )


def navigate_rows(current: DataFrame, dataset: DataFrame, annotations: DataFrame, salt: Column, num_rows: int) -> DataFrame:
    """The row after each (user_id, row_index) with its status, as ``row_detail`` gives it; ``from_row`` is where the user was."""
    moves = navigate(current, salt, num_rows).where(F.col("next_row").isNotNull())
    requests = moves.select("user_id", F.col("row_index").alias("from_row"), F.col("next_row").alias("row_index"))
    return row_detail(requests, dataset, annotations)
