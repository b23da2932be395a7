"""Row output: JSON-safe rows, binary references, previews, labels for status and tags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annolytics.functions.text import quoted

GRID_PREVIEW = (5, 60)
LIST_PREVIEW = (4, 40)
_JSON_TYPES = (
    T.StringType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
)


def binary_reference(dataset_id: Column, row_index: Column, column: str) -> Column:
    """The address of a binary value, which stands in for the value itself."""
    return F.concat_ws(
        "/", F.lit("/api/v1/datasets"), dataset_id, F.lit("rows"), row_index.cast("string"), F.lit("columns"), F.lit(column)
    )


def with_binary_refs(rows: DataFrame, dataset_id: Column) -> DataFrame:
    """Replace every binary column by its references. The bytes are never read."""
    refs = {
        field.name: binary_reference(dataset_id, F.col("row_index"), field.name)
        for field in rows.schema.fields
        if isinstance(field.dataType, T.BinaryType)
    }
    return rows.withColumns(refs) if refs else rows


def json_safe(column: Column, kind: T.DataType) -> Column:
    """A value as JSON can hold it: scalars and nested values kept, all else as text."""
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda item: json_safe(item, kind.elementType))
    if isinstance(kind, T.StructType):
        fields = [json_safe(column[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(column.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.MapType):
        return F.transform_values(column, lambda k, v: json_safe(v, kind.valueType))
    if isinstance(kind, T.BinaryType):
        return F.base64(column)
    return column if isinstance(kind, _JSON_TYPES) else column.cast("string")


def row_json(rows: DataFrame, columns: Sequence[str]) -> Column:
    """A row as JSON text with nulls written out. Bytes are base64; with_binary_refs puts addresses in their place."""
    fields = [json_safe(quoted(c), rows.schema[c].dataType).alias(c) for c in columns]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def display_text(column: Column, kind: T.DataType) -> Column:
    """A value as a preview shows it: strings as they are, other values as JSON."""
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(json_safe(column, kind))
    return json_safe(column, kind).cast("string")


def display_map(rows: DataFrame, columns: Sequence[str]) -> Column:
    """The display texts of a row by column name, in column order."""
    entries: list[Column] = []
    for name in columns:
        entries += [F.lit(name), display_text(quoted(name), rows.schema[name].dataType)]
    return F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")


def row_preview(rows: DataFrame, columns: Sequence[str], shape: tuple[int, int] = GRID_PREVIEW) -> list[Column]:
    """``preview``, the first fields cut to a length with an ellipsis, and ``more_fields``."""
    count, length = shape
    shown = []
    for name in columns[:count]:
        text = display_text(quoted(name), rows.schema[name].dataType)
        text = F.coalesce(text, F.lit("null"))
        cut = F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("…"))).otherwise(text)
        shown.append(F.struct(F.lit(name).alias("name"), cut.alias("text")))
    return [F.array(*shown).alias("preview"), F.lit(max(0, len(columns) - count)).alias("more_fields")]


def status_label(by_me: Column, by_any: Column, annotators: Column) -> Column:
    """What a row's badge says."""
    return (
        F.when(by_me, "Annotated by me")
        .when(by_any, F.array_join(annotators, ", "))
        .otherwise("Unannotated")
    )


def tag_list(tags: Column) -> Column:
    """Comma-separated tags as a trimmed list; none for empty tags."""
    listed = F.transform(F.split(tags, ","), lambda tag: F.trim(tag))
    return F.when(tags != "", listed).otherwise(F.array().cast("array<string>"))
