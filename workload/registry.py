"""Registered queries, each next to the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from workload.fixtures import SQL_FIXTURES

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``; ``sql`` may use the fixture names as tables."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_fixtures(sql)
        return fn

    return register


def with_fixtures(sql: str) -> str:
    """Put the fixtures a statement names, and those they name, in front of it."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name, body in SQL_FIXTURES.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(body)

    visit(sql)
    parts = [f"{name} AS ({body})" for name, body in SQL_FIXTURES.items() if name in needed]
    sql = sql.strip()
    if not parts:
        return sql
    # RECURSIVE is allowed, and without effect, where nothing recurses.
    if sql.upper().startswith("WITH "):
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + sql[5:].removeprefix("RECURSIVE ")
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + sql


def plain(df: DataFrame) -> DataFrame:
    """Times as text and nested values as JSON, so that both engines print them the same."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.TimestampNTZType, T.TimestampType)):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
            column = F.to_json(column)
        columns.append(column.alias(field.name))
    return df.select(*columns)
