"""Reading datasets: source detection and CSV, JSON, JSON lines and Parquet files.

A dataset is read from a file, a directory (its direct children) or a glob. URLs and hub names
are recognised but not fetched: stage the files where the executors can read them. Files are split
over tasks whatever their records look like: see records.py.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annolytics.sources.records import (
    SourceError,
    brackets_end,
    csv_records,
    csv_splits,
    file_paths,
    json_records,
    json_splits,
    numbered,
    plain_name,
    reader_path,
    text_lines,
)
from annolytics.sources.rowindex import with_row_index, with_row_index_parquet

# File extensions and the format each is read as, in the order a directory is
# searched.
FORMATS = {"csv": "csv", "json": "json", "jsonl": "json", "parquet": "parquet"}
SUPPORTED = "Supported: .csv, .json, .jsonl, .parquet"
#: Bytes of a JSON file that are looked at to tell its shape.
HEAD_BYTES = 64 * 1024


def extension(path: Column) -> Column:
    """The lower-case extension of the last path part, a query string left out."""
    name = F.regexp_extract(F.substring_index(path, "?", 1), r"([^/]*)/*$", 1)
    return F.lower(F.regexp_extract(name, r"[^.]\.([^.]+)$", 1))


def detect_source(source: Column) -> Column:
    """``{source_type, format, path, error}`` of source strings; no format comes with an error."""
    is_http = source.startswith("http://") | source.startswith("https://")
    is_file = source.startswith("file://")
    path = F.when(is_file, F.substring(source, F.lit(8), F.length(source))).otherwise(source)
    ext = extension(path)
    kind = F.when(is_http, "http").when(is_file, "file").otherwise("huggingface")
    fmt = F.when(ext.isin("csv", "parquet"), ext).when(ext.isin("json", "jsonl"), "json")
    by_extension = is_http | is_file
    error = F.when(
        by_extension & fmt.isNull(), F.concat(F.lit("Unsupported format: ."), ext, F.lit(f". {SUPPORTED}"))
    )
    return F.struct(
        kind.alias("source_type"), F.when(by_extension, fmt).alias("format"), path.alias("path"), error.alias("error")
    )


Schema = T.StructType | str | None


def _struct(schema: Schema) -> T.StructType | None:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def _demote_times(schema: T.StructType) -> T.StructType:
    times = (T.DateType, T.TimestampType, T.TimestampNTZType)
    return T.StructType(
        [T.StructField(f.name, T.StringType() if isinstance(f.dataType, times) else f.dataType) for f in schema.fields]
    )


def _listed(files: Sequence[str]) -> str:
    return ", ".join(sorted(files)[:20]) + (f" and {len(files) - 20} more" if len(files) > 20 else "")


def _texts(records: DataFrame):
    """Records as the data set of strings that Spark's readers take."""
    return getattr(records.select("record")._jdf, "as")(records.sparkSession._jvm.org.apache.spark.sql.Encoders.STRING())


def _schema_of(frame) -> T.StructType:
    return T.StructType.fromJson(json.loads(frame.schema().json()))


class CsvFiles(NamedTuple):
    """CSV files with line breaks inside quotes, those without, and the splits of all."""

    broken: list[str]
    plain: list[str]
    splits: DataFrame


def csv_breaks(spark: SparkSession, path: str | Sequence[str]) -> CsvFiles:
    """Tell the files of CSV with line breaks inside quotes from the others, in one scan of flags. Unbalanced quotes are an error."""
    files = file_paths(spark, path)
    splits = csv_splits(text_lines(spark, files))
    ends = splits.groupBy("file").agg(F.max_by("ends_inside", "at").alias("is_open"), F.sum("breaks").alias("breaks"))
    told = ends.where("is_open OR breaks > 0").collect()
    if unbalanced := [plain_name(row["file"]) for row in told if row["is_open"]]:
        raise SourceError(f"Unbalanced quotes: {_listed(unbalanced)}")
    broken = {plain_name(row["file"]) for row in told}
    return CsvFiles([f for f in files if f in broken], [f for f in files if f not in broken], splits)


def _inferred_csv(spark: SparkSession, path: str | Sequence[str], records: DataFrame) -> T.StructType:
    """Names from the first record of the first file, types from all records."""
    names = spark.read.options(header=True, multiLine=True, escape='"').csv(path).columns
    kinds = [f.dataType for f in _schema_of(spark.read.options(escape='"', inferSchema=True)._jreader.csv(_texts(records))).fields]
    return T.StructType([T.StructField(name, kinds[i] if i < len(kinds) else T.StringType()) for i, name in enumerate(names)])


def scan_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: Schema = None,
    line_breaks: bool = True,
    row_index: bool = False,
    file_col: str | None = None,
) -> DataFrame:
    """CSV with a header, also with line breaks inside quotes. Dates and times stay text; blank lines are skipped.

    Without a schema the types are inferred, which reads the data once more: pass one for data
    of any size. Files are split over tasks anywhere: one scan finds where the records of files
    with line breaks inside quotes begin; these records are stored as text and read by Spark's
    own parser, and other files are read as they are. Unbalanced quotes are an error naming the
    file. ``line_breaks=False`` vouches that there are none inside quotes and spares that scan.
    ``row_index`` adds each row's number in file order, and then ``file_col`` the address of its file.
    """
    reader, schema = spark.read.options(header=True, escape='"'), _struct(schema)
    found = csv_breaks(spark, path) if line_breaks else None
    if found is None or not found.broken:
        if schema is None:
            schema = _demote_times(reader.option("inferSchema", True).csv(path).schema)
        df = reader.schema(schema).csv(path)
        return with_row_index(df, file_col) if row_index else df
    # Numbers and inferred types are of all files together; else those without breaks are left to Spark's own splits.
    together = row_index or schema is None
    records = csv_records(text_lines(spark, found.broken + found.plain if together else found.broken), found.splits)
    if schema is None:
        schema = _demote_times(_inferred_csv(spark, path, records))
    parsed = records.withColumn("_row", F.from_csv("record", schema.toDDL(), {"escape": '"'}))
    columns = [F.col("_row")[f.name].alias(f.name) for f in schema.fields]
    if row_index:
        return numbered(parsed, columns + _file(file_col))
    df = parsed.select(*columns)
    return df if together or not found.plain else df.unionByName(reader.schema(schema).csv([reader_path(f) for f in found.plain]))


def scan_parquet(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return spark.read.parquet(path) if isinstance(path, str) else spark.read.parquet(*path)


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def _first_extension(spark: SparkSession, directory: str) -> str:
    """The first supported extension among a directory's direct children, by format order."""
    for ext in FORMATS:
        if is_glob_matched(spark, f"{directory.rstrip('/')}/*.{ext}"):
            return ext
    raise SourceError(f"No supported data files in directory: {directory}")


def is_directory(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = _file_system(spark, path)
    return fs.exists(hadoop_path) and fs.getFileStatus(hadoop_path).isDirectory()


def is_glob_matched(spark: SparkSession, pattern: str) -> bool:
    fs, hadoop_path = _file_system(spark, pattern)
    found = fs.globStatus(hadoop_path)
    return found is not None and len(found) > 0


def is_whole_line(head: str, is_all: bool) -> bool:
    """Whether the first line of JSON that is not blank is one value by itself, or one too long to tell by its head."""
    lines = head.split("\n")
    for i, line in enumerate(lines):
        if line.strip():
            ends = brackets_end(line)
            return (not is_all and i == len(lines) - 1) or ends == 1
    return True


def json_shapes(spark: SparkSession, path: str | Sequence[str]) -> tuple[list[str], list[str]]:
    """The JSON files under a path with a value on every line, and those with values over several lines.

    Told by the first line of each file that is not blank, from the listing and the first bytes of the files; no job is run.
    """
    files = file_paths(spark, path)

    def is_lines(file: str) -> bool:
        fs, hadoop_path = _file_system(spark, file)
        stream = fs.open(hadoop_path)
        try:
            head = bytes(stream.readNBytes(HEAD_BYTES))
        finally:
            stream.close()
        return is_whole_line(head.decode("utf-8", "replace"), len(head) < HEAD_BYTES)

    with ThreadPoolExecutor(16) as pool:
        told = list(pool.map(is_lines, files))
    return [f for f, yes in zip(files, told) if yes], [f for f, yes in zip(files, told) if not yes]


def _file(file_col: str | None) -> list[Column]:
    return [F.col("file").alias(file_col)] if file_col else []


def _json_documents(spark: SparkSession, files: Sequence[str], schema: Schema, row_index: bool, file_col: str | None = None) -> DataFrame:
    """Files of any JSON values, each a record, or an array of records, split over tasks anywhere between lines."""
    lines = text_lines(spark, files)
    splits = json_splits(lines)
    ends = splits.groupBy("file").agg(F.bool_or("wrong").alias("wrong"), F.max_by("end", "at").alias("depth"))
    if bad := [plain_name(row["file"]) for row in ends.where("wrong OR depth <> 0").collect()]:
        raise SourceError(f"Malformed JSON: {_listed(bad)}")
    records = json_records(lines, splits)
    strict, schema = {"mode": "FAILFAST"}, _struct(schema)
    if schema is None:
        schema = _schema_of(spark.read.options(**strict)._jreader.json(_texts(records)))
    is_object = F.ltrim(F.translate("record", "\n\r\t", "   ")).startswith("{")
    wrong = F.raise_error(F.concat(F.lit("Malformed JSON, a record is no object: "), F.substring("record", 1, 80))).cast("string")
    checked = records.withColumn("record", F.when(is_object, F.col("record")).otherwise(wrong))
    # As an array of one, so that anything behind the object is an error too.
    in_array = F.from_json(F.concat(F.lit("["), "record", F.lit("]")), T.ArrayType(schema), strict)
    parsed = checked.withColumn("_row", in_array[0])
    columns = [F.col("_row")[f.name].alias(f.name) for f in schema.fields]
    return numbered(parsed, columns + _file(file_col)) if row_index else parsed.select(*columns)


def scan_json(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: Schema = None,
    lines: bool = True,
    row_index: bool = False,
    file_col: str | None = None,
) -> DataFrame:
    """JSON lines, or with ``lines`` off files of values over any number of lines. A record that is no JSON is an error.

    Either is split over tasks anywhere between lines; a value, and a line, must fit a row. ``row_index`` adds each row's number in file order, and then ``file_col`` the address of its file.
    """
    if not lines:
        return _json_documents(spark, file_paths(spark, path), schema, row_index, file_col)
    reader = spark.read.option("mode", "FAILFAST")
    df = (reader.schema(schema) if schema is not None else reader).json(path)
    return with_row_index(df, file_col) if row_index else df


def scan_json_files(
    spark: SparkSession, path: str | Sequence[str], schema: Schema = None, row_index: bool = False, file_col: str | None = None
) -> DataFrame:
    """JSON files under a path, each read by its own shape. Columns that some files lack are null there."""
    lines, documents = json_shapes(spark, path)
    if not documents:
        return scan_json(spark, path, schema, row_index=row_index, file_col=file_col)
    if row_index:
        # Lines are values too, and numbers are of all files together.
        return _json_documents(spark, lines + documents, schema, True, file_col)
    df = _json_documents(spark, documents, schema, False)
    return scan_json(spark, [reader_path(f) for f in lines], schema).unionByName(df, allowMissingColumns=True) if lines else df


def scan_source(
    spark: SparkSession,
    path: str | Sequence[str],
    ext: str,
    schema: Schema = None,
    line_breaks: bool = True,
    row_index: bool = False,
    file_col: str | None = None,
) -> DataFrame:
    """Files of a known format; see scan_csv for the arguments."""
    if ext == "csv":
        return scan_csv(spark, path, schema, line_breaks, row_index, file_col)
    if ext == "parquet":
        df = scan_parquet(spark, path)
        return with_row_index_parquet(df, file_col) if row_index else df
    return (scan_json if ext == "jsonl" else scan_json_files)(spark, path, schema, row_index=row_index, file_col=file_col)


def _suffix(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    return name.rsplit(".", 1)[-1] if "." in name.lstrip(".") else ""


def resolve_source(spark: SparkSession, source: str) -> tuple[str, str]:
    """The path or pattern of a source's files, and their extension: of a ``file://`` source or a path, a file, a directory or a glob."""
    if source.startswith(("http://", "https://")):
        raise SourceError(f"stage {source} on a file system the executors can read")
    path = source[len("file://") :] if source.startswith("file://") else source
    if any(c in path for c in "*?["):
        if not is_glob_matched(spark, path):
            raise SourceError(f"No files match pattern: {path}")
        ext = _suffix(path)
    elif is_directory(spark, path) and _suffix(path) not in FORMATS:
        ext = _first_extension(spark, path)
        # Direct children only; both spellings of JSON count, as one format.
        pattern = "*.{json,jsonl}" if FORMATS[ext] == "json" else f"*.{ext}"
        path = f"{path.rstrip('/')}/{pattern}"
    else:
        ext = _suffix(path)
    if ext not in FORMATS:
        raise SourceError(f"Unsupported format: .{ext}. {SUPPORTED}")
    return path, ext


def load_dataset(spark: SparkSession, source: str, schema: Schema = None, line_breaks: bool = True, row_index: bool = False) -> DataFrame:
    """A dataset from a ``file://`` source or a path: a file, a directory or a glob.

    ``schema`` and ``line_breaks`` are as for scan_csv; JSON takes the schema too. ``row_index`` adds each row's number in file order.
    """
    path, ext = resolve_source(spark, source)
    return scan_source(spark, path, ext, schema, line_breaks, row_index)
