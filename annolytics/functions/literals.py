"""Filter literals: every filter value arrives as text and is typed by its use."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds per unit of a relative time such as 15m, 3h, 2d, 1M, 1Y.
# No moment is further from another than the years of a timestamp allow.
MAX_SPAN = 10_000 * 365 * 86400
UNIT_SECONDS = {"m": 60, "h": 3600, "d": 86400, "M": 30 * 86400, "Y": 365 * 86400}
RELATIVE_PATTERN = r"^(\d+)([mhdMY])$"


def parse_int(value: str) -> int | None:
    try:
        return int(value)
    except ValueError:
        return None


def parse_float(value: str) -> float | None:
    try:
        return float(value)
    except ValueError:
        return None


@dataclass(frozen=True)
class Literal:
    """A label literal: a number when the text reads as one, else the text."""

    text: str
    number: float | int | None


def typed_literal(value: str) -> Literal:
    """Text with a dot is tried as a float, other text as an integer; what fails stays text."""
    number = parse_float(value) if "." in value else parse_int(value)
    return Literal(value, number)


def literal_kind(value: Column) -> Column:
    """``float``, ``int`` or ``text`` for a column of literals (column form of typed_literal)."""
    number = F.when(value.contains("."), value.try_cast("double").isNotNull())
    return (
        F.when(number, F.lit("float"))
        .when(~value.contains(".") & value.try_cast("bigint").isNotNull(), F.lit("int"))
        .otherwise(F.lit("text"))
    )


def literal_number(value: Column) -> Column:
    """The numeric reading of a literal, null for text."""
    return F.when(literal_kind(value) != "text", value.try_cast("double"))


def time_threshold(value: str, now: datetime) -> datetime:
    """A moment from a relative time (counted back from ``now``) or an ISO date, year or time."""
    relative = re.match(RELATIVE_PATTERN, value)
    if relative:
        return now - timedelta(seconds=int(relative.group(1)) * UNIT_SECONDS[relative.group(2)])
    text = value.strip()
    if re.fullmatch(r"\d{4}", text):
        text += "-01-01"
    elif re.fullmatch(r"\d{4}-\d{2}", text):
        text += "-01"
    moment = datetime.fromisoformat(text)
    return moment.replace(tzinfo=None) - (moment.utcoffset() or timedelta())


def timestamp_literal(moment: datetime) -> Column:
    """A zone-less timestamp literal, independent of the zones of the driver and the session."""
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def relative_time(value: Column, now: Column) -> Column:
    """Column form: relative times become ISO text counted back from ``now``, others stay as is."""
    amount = F.regexp_extract(value, RELATIVE_PATTERN, 1).try_cast("bigint")
    unit = F.regexp_extract(value, RELATIVE_PATTERN, 2)
    seconds = F.lit(None).cast("bigint")
    for name, size in UNIT_SECONDS.items():
        seconds = F.when(unit == name, F.lit(size).cast("bigint")).otherwise(seconds)
    # An amount that leaves the range of intervals gives null rather than failing the query.
    span = F.try_multiply(amount, seconds).try_cast("decimal(18,6)")
    span = F.when(F.abs(span) <= F.lit(MAX_SPAN), span)
    moment = F.try_subtract(now, F.make_dt_interval(secs=span))
    micros = F.date_format(moment, "SSSSSS")
    whole = F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")
    iso = F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))
    return F.when(value.rlike(RELATIVE_PATTERN), iso).otherwise(value)
