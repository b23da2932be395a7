"""Datasets that grow by files: a ledger tells which files were numbered, and where each one's rows begin.

Rows of new files get the next numbers, those of known files keep theirs, and known files are not read again. Rows and ledger
are committed together, so a job that dies adds nothing.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annolytics.sources.readers import Schema, SourceError, resolve_source, scan_source
from annolytics.sources.records import plain_name, reader_path
from annolytics.sources.snapshots import Segment, Snapshot, commit, latest_snapshot

LEDGER = "file string, size bigint, modified timestamp, first bigint, rows bigint"
FILE = "_file"


def listed_files(spark: SparkSession, pattern: str) -> dict[str, tuple]:
    """``{file: (size, modified)}`` under a path, from the listing alone."""
    found = spark.read.format("binaryFile").load(pattern).select("path", "length", "modificationTime").collect()
    return {re.sub("^file:/+", "file:/", row["path"]): (row["length"], row["modificationTime"]) for row in found}


def _folders(snapshot: Snapshot, table: str) -> list[str]:
    return [segment.folder for segment in snapshot.of(table)]


def read_ledger(spark: SparkSession, path: str, snapshot: Snapshot | None = None) -> DataFrame:
    """The files of an ingested dataset: size, time, first row and number of rows."""
    folders = _folders(snapshot or latest_snapshot(spark, path), "ledger")
    return spark.read.schema(LEDGER).parquet(*folders) if folders else spark.createDataFrame([], LEDGER)


def read_ingested(spark: SparkSession, path: str) -> DataFrame:
    """The rows ingested so far, with row_index."""
    folders = _folders(latest_snapshot(spark, path), "rows")
    if not folders:
        raise SourceError(f"nothing has been ingested to {path}")
    return spark.read.parquet(*folders).drop(FILE)


def ingest_files(spark: SparkSession, source: str, path: str, schema: Schema = None) -> int:
    """Number and store the files of a source that the ledger at ``path`` does not know; gives the number of rows added.

    New files are numbered in the order of their names, after all that is there. A known file that has changed or gone is an error, as its rows keep their
    numbers. The first files fix the columns and types (inferred, unless ``schema`` is given). Of two runs at once one fails, and may be called again.
    """
    pattern, ext = resolve_source(spark, source)
    snapshot = latest_snapshot(spark, path)
    files = listed_files(spark, pattern)
    known = {row["file"]: (row["size"], row["modified"]) for row in read_ledger(spark, path, snapshot).select("file", "size", "modified").collect()}
    changed = sorted(name for name, seen in known.items() if files.get(name) != seen)
    if changed:
        raise SourceError(f"Files changed or gone since they were numbered: {', '.join(changed[:20])}")
    new = sorted(set(files) - set(known))
    if not new:
        return 0
    first = read_ledger(spark, path, snapshot).agg(F.max(F.col("first") + F.col("rows"))).first()[0] or 0
    if known:
        stored = read_ingested(spark, path).schema
        schema = T.StructType([f for f in stored.fields if f.name != "row_index"])
    rows = scan_source(spark, [reader_path(name) for name in new], ext, schema, row_index=True, file_col=FILE)
    if known:
        rows = rows.select("row_index", *[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields], FILE)
    folder = f"{path}/data/{uuid.uuid4().hex}"
    rows.withColumn("row_index", F.col("row_index") + F.lit(first)).write.parquet(f"{folder}/rows")
    counts = spark.read.parquet(f"{folder}/rows").groupBy(FILE).agg(F.min("row_index").alias("first"), F.count("*").alias("rows")).collect()
    counted = {plain_name(row[FILE]): (row["first"], row["rows"]) for row in counts}
    entries, at = [], first
    for name in new:
        # A file without rows begins where the next one does.
        n = counted.get(name, (at, 0))[1]
        entries.append((name, *files[name], at, n))
        at += n
    spark.createDataFrame(entries, LEDGER).coalesce(1).write.parquet(f"{folder}/ledger")

    def add(base: Snapshot) -> Snapshot:
        if base.version != snapshot.version:
            raise SourceError("another run has added files meanwhile")
        number = base.version + 1
        added = (Segment("rows", f"{folder}/rows", 0, number, number), Segment("ledger", f"{folder}/ledger", 0, number, number))
        return Snapshot(number, base.segments + added, base.batches)

    commit(spark, path, add)
    return at - first
