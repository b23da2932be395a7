"""Typed access to JSON payloads.

``get_json_object`` alone forgets types: the string "5" and the number 5 read the same. The
payload is parsed to VARIANT once and each value keeps its type, its text and its number.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The longest numeric prefix of a text, as a database cast from text to a real number reads it.
NUMERIC_PREFIX = r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"


# A field name, then names after dots and positions in brackets.
FIELD_PATH = re.compile(r"[^.\[\]]+(\.[^.\[\]]+|\[\d+\])*")


@dataclass(frozen=True)
class JsonValue:
    """Columns describing the value at one path of a payload."""

    present: Column
    is_text: Column
    is_bool: Column
    is_string: Column
    text: Column
    number: Column
    integer: Column


def json_path(field: str) -> str:
    return f"$.{field}"


def json_text(data: Column, field: str) -> Column:
    """The value at a path as text: strings bare, containers as JSON text."""
    return F.get_json_object(data, json_path(field))


def json_value(data: Column, payload: Column, field: str) -> JsonValue:
    """Describe ``$.field`` of ``payload`` (a VARIANT) and ``data`` (its JSON text)."""
    path = json_path(field)
    value = F.try_variant_get(payload, path, "variant")
    kind = F.schema_of_variant(value)
    # Objects and arrays compare as text, like strings.
    is_text = kind.rlike("^(STRING|ARRAY|OBJECT)")
    return JsonValue(
        present=value.isNotNull() & (kind != "VOID"),
        is_text=is_text,
        is_bool=kind == "BOOLEAN",
        is_string=kind.startswith("STRING"),
        text=json_text(data, field),
        number=F.when(~is_text, F.try_variant_get(payload, path, "double")),
        integer=F.when(kind == "BIGINT", F.try_variant_get(payload, path, "bigint")),
    )


def numeric_prefix(text: Column) -> Column:
    """The number a text starts with, null when it starts with none."""
    return F.regexp_extract(text, NUMERIC_PREFIX, 1).try_cast("double")


def like_text(value: JsonValue) -> Column:
    """Text for LIKE: booleans are 1 and 0."""
    flag = F.when(value.text == "true", F.lit("1")).otherwise(F.lit("0"))
    return F.when(value.is_bool, flag).otherwise(value.text)


def payload_entries(data: Column) -> Column:
    """A payload's top-level fields as MAP<STRING,STRING>: strings bare, the rest as JSON text."""
    return F.from_json(data, "map<string,string>")
