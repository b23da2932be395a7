"""Filter expressions as columns.

An expression is ``(field, operator, value, conjunction)`` and every value is text. The field
decides what it tests:

* ``row_index``                         the row number
* ``annotations.count``                 how many annotations the row has
* ``annotations.annotated_by``          whether a user annotated it (``me`` is the caller)
* ``annotations.created_at|updated_at`` whether any annotation was made then
* ``annotation.<path>``                 whether any annotation's payload has such a value
* ``data.<column>``                     the value of a dataset column

Each annotation test asks on its own for *some* annotation of the row; two tests may be met by
two different annotations. Mistakes that would fail at run time (an unknown column, a count that
is not a number) are raised here, before any job starts.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annolytics.functions.jsontext import FIELD_PATH, JsonValue, json_value, like_text, numeric_prefix
from annolytics.functions.literals import (
    parse_float,
    parse_int,
    time_threshold,
    timestamp_literal,
    typed_literal,
)
from annolytics.functions.text import float_text, quoted

COMPARE: dict[str, Callable] = {
    "=": operator.eq,
    "!=": operator.ne,
    ">": operator.gt,
    ">=": operator.ge,
    "<": operator.lt,
    "<=": operator.le,
}
ORDERING = (">", ">=", "<", "<=")
TIME_FIELDS = ("annotations.created_at", "annotations.updated_at")

# The numbers a BIGINT can hold.
_LONG_RANGE = (-(2**63), 2**63 - 1)


class FilterError(ValueError):
    """A filter expression that cannot be evaluated."""


@dataclass(frozen=True)
class FilterExpr:
    field: str
    operator: str
    value: str
    conjunction: str = "AND"

    @property
    def kind(self) -> str:
        """row, count, annotation, data, or ignored for a prefix nobody knows."""
        if self.field == "row_index":
            return "row"
        if self.field == "annotations.count":
            return "count"
        if self.field == "annotations.annotated_by" or self.field in TIME_FIELDS:
            return "annotation"
        if self.field.startswith("annotation.") and self.field != "annotation.":
            known = self.operator == "~=" or self.operator in COMPARE
            return "annotation" if known else "ignored"
        if self.field.startswith("data.") and self.field != "data.":
            return "data"
        return "ignored"

    @property
    def wants_no_annotation(self) -> bool:
        """``count = 0``, ``< 1`` and ``<= 0`` ask for rows without any annotation."""
        if self.kind != "count":
            return False
        return (self.operator, _count_value(self)) in (("=", 0), ("<", 1), ("<=", 0))


def _whole_number(expr: FilterExpr) -> int:
    value = parse_int(expr.value)
    if value is None:
        raise FilterError(f"{expr.field} needs a whole number, not {expr.value!r}")
    return value


def _count_value(expr: FilterExpr) -> int:
    if expr.operator not in COMPARE:
        raise FilterError(f"{expr.field} does not support {expr.operator}")
    return _whole_number(expr)


def _beyond_long(op: str, value: int) -> Column:
    """Any BIGINT against a number outside its range: all that matters is the side."""
    return F.lit(bool(COMPARE[op](0, value)))


def row_index_predicate(expr: FilterExpr, column: str = "row_index") -> Column:
    """``row_index`` against a whole number; other operators pass every row."""
    value = _whole_number(expr)
    if expr.operator not in COMPARE:
        return F.lit(True)
    if not _LONG_RANGE[0] <= value <= _LONG_RANGE[1]:
        return _beyond_long(expr.operator, value)
    return COMPARE[expr.operator](F.col(column), F.lit(value).cast("bigint"))


def count_predicate(expr: FilterExpr, count: Column) -> Column:
    """The annotation count of a row that has annotations; a row without any never matches."""
    value = _count_value(expr)
    if not _LONG_RANGE[0] <= value <= _LONG_RANGE[1]:
        return count.isNotNull() & _beyond_long(expr.operator, value)
    return COMPARE[expr.operator](count, F.lit(value).cast("bigint"))


def annotation_predicate(expr: FilterExpr, me: str, now: datetime) -> Column:
    """A test on one annotation (columns user_id, created_at, updated_at, data, payload)."""
    if expr.field == "annotations.annotated_by":
        # Always equality, whatever the operator.
        return F.col("user_id") == F.lit(me if expr.value == "me" else expr.value)
    if expr.field in TIME_FIELDS:
        if expr.operator not in COMPARE:
            raise FilterError(f"{expr.field} does not support {expr.operator}")
        try:
            moment = time_threshold(expr.value, now)
        except (ValueError, OverflowError) as error:
            raise FilterError(f"{expr.field} needs a time, not {expr.value!r}") from error
        return COMPARE[expr.operator](F.col(expr.field.split(".")[1]), timestamp_literal(moment))
    field = expr.field[len("annotation.") :]
    if not FIELD_PATH.fullmatch(field):
        raise FilterError(f"{expr.field} is not a path of names and positions")
    return label_predicate(json_value(F.col("data"), F.col("payload"), field), expr)


_FOLD = str.maketrans(ascii_uppercase, ascii_lowercase)


def _equals_number(value: JsonValue, number: float | int) -> Column:
    """Whole numbers compare as such: as doubles, large ones that differ would look equal."""
    if isinstance(number, int) and _LONG_RANGE[0] <= number <= _LONG_RANGE[1]:
        whole = value.integer == F.lit(number).cast("bigint")
        return F.coalesce(whole, value.number == F.lit(float(number)))
    return value.number == F.lit(float(number))


def folded_label_text(value: JsonValue) -> Column:
    """What ``~=`` looks at in a payload value: its text, A to Z in lower case."""
    return F.translate(like_text(value), ascii_uppercase, ascii_lowercase)


def folded_pattern(value: str) -> str:
    return value.translate(_FOLD)


def label_predicate(value: JsonValue, expr: FilterExpr) -> Column:
    """A typed test on a payload value; a missing or null value never matches."""
    if expr.operator == "~=":
        # Wildcards in the value count, as in LIKE; the case of A to Z does not.
        pattern = "%" + expr.value.replace("\\", "\\\\") + "%"
        matched = folded_label_text(value).like(folded_pattern(pattern))
    elif expr.operator in ("=", "!="):
        literal = typed_literal(expr.value)
        if literal.number is None:
            equal = value.is_text & (value.text == F.lit(literal.text))
        else:
            equal = F.coalesce(_equals_number(value, literal.number), F.lit(False))
        matched = equal if expr.operator == "=" else ~equal
    else:
        bound = parse_float(expr.value)
        if bound is None:
            raise FilterError(f"{expr.field} {expr.operator} needs a number, not {expr.value!r}")
        if math.isnan(bound):
            return F.lit(False)
        from_text = F.when(value.is_string, numeric_prefix(value.text))
        number = F.coalesce(value.number, from_text, F.lit(0.0))
        matched = COMPARE[expr.operator](number, F.lit(bound))
    return F.coalesce(value.present & matched, F.lit(False))


# --- dataset columns -------------------------------------------------------------------------

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATS = (T.FloatType, T.DoubleType)
_TIMES = (T.TimestampType, T.TimestampNTZType)


def _time_text(column: Column, kind: T.DataType) -> Column:
    """A timestamp as ``YYYY-MM-DD hh:mm:ss``, with six decimals when it has a fraction."""
    micros = F.date_format(column, "SSSSSS")
    whole = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
    text = F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))
    return F.concat(text, F.lit("+00:00")) if isinstance(kind, T.TimestampType) else text


def value_text(column: Column, kind: T.DataType) -> Column:
    """The text a value compares as when its type has no comparison of its own."""
    if isinstance(kind, T.BooleanType):
        return F.when(column, "True").when(~column, "False")
    if isinstance(kind, _TIMES):
        return _time_text(column, kind)
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(column)
    if isinstance(kind, T.BinaryType):
        return F.decode(column, "utf-8")
    return column.cast("string")


def contains_text(column: Column, kind: T.DataType) -> Column:
    """The text a substring is looked for in."""
    if isinstance(kind, _FLOATS):
        return float_text(column.cast("double"))
    if isinstance(kind, T.BooleanType):
        return column.cast("string")
    if isinstance(kind, _TIMES):
        zone = "Z" if isinstance(kind, T.TimestampType) else ""
        return F.concat(F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(zone))
    return value_text(column, kind)


def _as_text(column: Column, kind: T.DataType, op: str, value: str) -> Column:
    """Equality on the text form. A null reads as the text None here, so it passes ``!=``."""
    equal = F.coalesce(value_text(column, kind), F.lit("None")) == F.lit(value)
    return equal if op == "=" else ~equal


def _numeric_equality(column: Column, kind: T.DataType, op: str, value: str) -> Column:
    if isinstance(kind, _INTEGERS):
        number = parse_int(value)
        if number is None or not _LONG_RANGE[0] <= number <= _LONG_RANGE[1]:
            return _as_text(column, kind, op, value)
        return COMPARE[op](column, F.lit(number).cast("bigint"))
    number = parse_float(value)
    if number is None:
        return _as_text(column, kind, op, value)
    column = column.cast("double")
    if math.isnan(number):
        # Not-a-number equals nothing, itself included.
        return F.lit(False) if op == "=" else column.isNotNull()
    return COMPARE[op](column, F.lit(number))


def _ordering(column: Column, kind: T.DataType, op: str, value: str) -> Column:
    bound = parse_float(value)
    if bound is None or math.isnan(bound):
        return F.lit(False)
    if isinstance(kind, T.BooleanType):
        return COMPARE[op](column.cast("int"), F.lit(bound))
    if isinstance(kind, _FLOATS):
        # Spark ranks NaN above every number; here it never matches.
        return COMPARE[op](column, F.lit(bound)) & ~F.isnan(column)
    if isinstance(kind, _INTEGERS) and bound.is_integer() and abs(bound) < 2**53:
        # A whole bound keeps the column free of casts, so the scan can use the predicate.
        return COMPARE[op](column, F.lit(int(bound)).cast("bigint"))
    if isinstance(kind, (*_INTEGERS, T.DecimalType)):
        return COMPARE[op](column, F.lit(bound))
    return F.lit(False)


def data_predicate(expr: FilterExpr, schema: T.StructType) -> Column:
    """A test on a dataset column, by the column's type."""
    name = expr.field[len("data.") :]
    if name not in schema.names:
        raise FilterError(f"unknown column {name!r}")
    kind, column = schema[name].dataType, quoted(name)
    op, value = expr.operator, expr.value
    if op == "~=":
        if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
            return F.coalesce(contains_text(column, kind), F.lit("None")).contains(value)
        return contains_text(column, kind).contains(value)
    if op in ("=", "!="):
        if isinstance(kind, T.StringType):
            return COMPARE[op](column, F.lit(value))
        if isinstance(kind, (*_INTEGERS, *_FLOATS)):
            return _numeric_equality(column, kind, op, value)
        return _as_text(column, kind, op, value)
    if op in ORDERING:
        return _ordering(column, kind, op, value)
    return F.lit(True)
