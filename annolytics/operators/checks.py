"""Integrity checks: uniqueness, references and domains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GLOBAL_ROLES = ("system_admin", "annotator")
PROJECT_ROLES = ("project_admin", "annotator")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with how often."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def orphans(child: DataFrame, parent: DataFrame, column: str, parent_column: str | None = None) -> DataFrame:
    """Child rows whose reference names no parent row.

    The distinct references are matched first, so a busy parent does not make one task see all
    its children.
    """
    known = parent.select(F.col(parent_column or column).alias(column)).distinct()
    missing = child.select(column).distinct().join(known, column, "left_anti")
    return child.join(missing, column, "left_semi")


def bad_values(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Rows whose value is null or none of the allowed ones."""
    return df.where(F.col(column).isNull() | ~F.col(column).isin(*allowed))


def rows_out_of_range(annotations: DataFrame, projects: DataFrame, catalog: DataFrame) -> DataFrame:
    """Annotations whose row_index is not within the project's dataset."""
    sizes = projects.join(catalog, "dataset_id").select("project_id", "num_rows")
    inside = (F.col("row_index") >= 0) & (F.col("row_index") < F.col("num_rows"))
    return annotations.join(sizes, "project_id").where(~inside).select(*annotations.columns, "num_rows")
