"""Progress and annotation status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolytics.plans.ranking import ranged_positions


def progress(annotations: DataFrame, me: str) -> DataFrame:
    """Per project: rows annotated, rows annotated by ``me``, annotations.

    A first aggregate per row replaces distinct counts, which would shuffle every annotation
    once per distinct expression.
    """
    per_row = annotations.groupBy("project_id", "row_index").agg(
        F.count("*").alias("_n"), F.max((F.col("user_id") == me).cast("int")).alias("_mine")
    )
    return per_row.groupBy("project_id").agg(
        F.count("*").alias("annotated_rows"),
        F.sum("_mine").cast("bigint").alias("annotated_by_me"),
        F.sum("_n").alias("total_annotations"),
    )


def progress_by_user(annotations: DataFrame) -> DataFrame:
    """Progress for every (project, user) that annotated; a user has one annotation per row."""
    totals = progress(annotations, "").drop("annotated_by_me")
    mine = annotations.groupBy("project_id", "user_id").agg(F.count("*").alias("annotated_by_me"))
    return mine.join(totals, "project_id")


def percent(done: Column, total: Column) -> Column:
    """A whole percentage, halves rounded up; 0 for an empty dataset."""
    share = F.floor(done * 100 / F.nullif(total, F.lit(0)) + 0.5)
    return F.coalesce(share, F.lit(0)).cast("bigint")


def count_per_row(annotations: DataFrame) -> DataFrame:
    return annotations.groupBy("row_index").agg(F.count("*").alias("n_annotations"))


def row_annotators(annotations: DataFrame) -> DataFrame:
    """Who annotated what: ``(row_index, author_id, position)``, one row per annotator, placed by name from 0.

    The form for rows of any number of annotators: they are dealt out by range of row and name, so that one row may take as many tasks as it needs.
    """
    pairs = annotations.select("row_index", F.col("user_id").alias("author_id"))
    return ranged_positions(pairs, ["row_index"], ["author_id"])


def row_flags(annotations: DataFrame, me: str) -> DataFrame:
    """Per annotated row: by_me, by_any and the number of annotators, combined before the shuffle."""
    return annotations.groupBy("row_index").agg(
        F.bool_or(F.col("user_id") == me).alias("by_me"), F.lit(True).alias("by_any"), F.count("*").alias("n_annotators")
    )


def row_status(annotations: DataFrame, me: str) -> DataFrame:
    """Per annotated row, one row: by_me, by_any and the sorted annotators.

    The names of one row are one value, of any number that a value can hold; row_annotators gives them as rows, row_flags without.
    """
    return annotations.groupBy("row_index").agg(
        F.bool_or(F.col("user_id") == me).alias("by_me"), F.lit(True).alias("by_any"), F.array_sort(F.collect_list("user_id")).alias("annotators")
    )


def annotations_per_row(annotations: DataFrame) -> DataFrame:
    """Per annotated row, one row with its annotations ``{author_id, data, created_at, updated_at}`` by author.

    As with row_status they are one value; the annotations themselves are the form for more.
    """
    item = F.struct(F.col("user_id").alias("author_id"), "data", "created_at", "updated_at")
    return annotations.groupBy("row_index").agg(F.array_sort(F.collect_list(item)).alias("annotations"))


def row_detail(requests: DataFrame, dataset: DataFrame, annotations: DataFrame) -> DataFrame:
    """Requested dataset rows with their status: the columns of ``requests (user_id, row_index, ...)``, those of the rows, by_me, by_any.

    ``annotations`` are those of one project. Requests of rows that the dataset lacks are left out; repeated ones are answered each.
    """
    anyone = annotations.select("row_index").distinct().withColumn("_any", F.lit(True))
    mine = annotations.select("row_index", "user_id").distinct().withColumn("_me", F.lit(True))
    found = requests.join(dataset, "row_index").join(anyone, "row_index", "left").join(mine, ["row_index", "user_id"], "left")
    return found.withColumns({"by_me": F.coalesce("_me", F.lit(False)), "by_any": F.coalesce("_any", F.lit(False))}).drop("_me", "_any")


def unannotated_by_user(dataset: DataFrame, annotations: DataFrame, user_id: str) -> DataFrame:
    """Dataset rows the user has not annotated."""
    done = annotations.where(F.col("user_id") == user_id).select("row_index")
    return dataset.join(done, "row_index", "left_anti")
