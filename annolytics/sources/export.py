"""Exporting a project's annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXPORT_COLUMNS = ("row_index", "user_id", "data", "created_at", "updated_at")
FORMATS = ("parquet", "jsonl")


def export_rows(annotations: DataFrame, project_id: str) -> DataFrame:
    return annotations.where(F.col("project_id") == project_id).select(*EXPORT_COLUMNS)


def export_annotations(annotations: DataFrame, project_id: str, path: str, fmt: str = "parquet") -> None:
    """Write one project: Parquet with the payload as bytes, or JSON lines with it as text.

    An empty project still gets its columns.
    """
    if fmt not in FORMATS:
        raise ValueError(f"Unsupported export format: {fmt}")
    rows = export_rows(annotations, project_id)
    if fmt == "parquet":
        rows.withColumn("data", F.encode("data", "utf-8")).write.parquet(path)
    else:
        # The default format would cut the times to milliseconds.
        rows.write.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path)
