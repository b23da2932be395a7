"""Sources, sinks and the catalog."""

from __future__ import annotations

from functools import reduce
from operator import add

import pyarrow as pa
from pyspark.sql import functions as F

from annolytics.session import scratch_path
from annolytics.sources.catalog import catalog_list, profile_all, seed_users
from annolytics.sources.export import export_annotations
from annolytics.sources.readers import detect_source, load_dataset, scan_csv, scan_json, scan_parquet
from annolytics.sources.ledger import ingest_files, read_ingested
from annolytics.sources.rowindex import ingest, with_row_index
from annolytics.operators.projects import role_map
from workload import fixtures as fx
from workload.registry import plain, query

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


@query(
    "detect_source",
    r"""WITH sources AS (SELECT unnest([url, url||'/rows.csv?v=2', 'file:///data/'||page_id||'.jsonl', 'org/name-'||page_id,
          url||'.PARQUET', 'file:///x/'||page_id||'.xlsx', 'http://files.test/'||page_id||'.json', 'name'||page_id]) AS source FROM pages),
      paths AS (SELECT source, CASE WHEN starts_with(source,'file://') THEN substr(source,8) ELSE source END AS path,
          CASE WHEN starts_with(source,'http://') OR starts_with(source,'https://') THEN 'http'
               WHEN starts_with(source,'file://') THEN 'file' ELSE 'huggingface' END AS source_type FROM sources),
      exts AS (SELECT *, lower(regexp_extract(split_part(split_part(path,'?',1),'/',-1),'.\.([^.]+)$',1)) AS ext FROM paths)
      SELECT source, source_type, path, CASE WHEN source_type<>'huggingface' THEN
          CASE ext WHEN 'csv' THEN 'csv' WHEN 'json' THEN 'json' WHEN 'jsonl' THEN 'json' WHEN 'parquet' THEN 'parquet' END END AS format,
        CASE WHEN source_type<>'huggingface' AND ext NOT IN ('csv','json','jsonl','parquet')
          THEN 'Unsupported format: .'||ext||'. Supported: .csv, .json, .jsonl, .parquet' END AS error FROM exts""",
)
def detect(spark, sf):
    page = F.col("page_id").cast("string")
    forms = F.array(
        F.col("url"),
        F.concat("url", F.lit("/rows.csv?v=2")),
        F.concat(F.lit("file:///data/"), page, F.lit(".jsonl")),
        F.concat(F.lit("org/name-"), page),
        F.concat("url", F.lit(".PARQUET")),
        F.concat(F.lit("file:///x/"), page, F.lit(".xlsx")),
        F.concat(F.lit("http://files.test/"), page, F.lit(".json")),
        F.concat(F.lit("name"), page),
    )
    sources = fx.table(spark, sf, "pages").select(F.explode(forms).alias("source"))
    return sources.withColumn("d", detect_source(F.col("source"))).select("source", "d.*")


@query("scan_csv", "SELECT doc_id, lang, n_chars, md5(text) AS text_md5, length(text) AS text_length FROM documents")
def csv(spark, sf):
    path = scratch_path(spark, "csv")
    docs = fx.table(spark, sf, "documents")
    docs.write.options(
        header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)
    back = scan_csv(spark, path, docs.schema)
    return back.select("doc_id", "lang", "n_chars", F.md5("text").alias("text_md5"), F.length("text").alias("text_length"))


@query("scan_json", "SELECT doc_id, lang, n_chars, md5(text) AS text_md5 FROM documents")
def json(spark, sf):
    path = scratch_path(spark, "json")
    fx.table(spark, sf, "documents").write.json(path)
    return scan_json(spark, path).select("doc_id", "lang", "n_chars", F.md5("text").alias("text_md5"))


@query(
    "scan_json_mixed",
    """SELECT doc_id AS id, lang, md5(text) AS text_md5 FROM documents UNION ALL SELECT page_id, NULL, md5(html) FROM pages
       UNION ALL SELECT item_id, 'b', md5(text) FROM benchmark""",
)
def json_mixed(spark, sf):
    """One folder with files of lines, of an array on one line and of an array over several lines."""
    path = scratch_path(spark, "mixed")
    docs = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", "text")
    docs.write.mode("append").json(path)
    pages = fx.table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text"))
    rest = fx.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.lit("b").alias("lang"), "text")
    # The last table's arrays are over several lines.
    for rows, indented in ((pages, False), (rest, True)):
        _write_arrays(rows, path, indented)
    return load_dataset(spark, path).select("id", "lang", F.md5("text").alias("text_md5"))


#: Bytes of a written file: more than a split, so that records still cross borders. An array on one line is one value, which a reader holds whole.
FILE_BYTES, LINE_BYTES = 192 << 20, 32 << 20


def _files(rows, least, most_bytes=None):
    """How many files to write rows to: ``least``, and more where these would get larger than ``most_bytes`` (FILE_BYTES)."""
    sizes = [F.coalesce(F.octet_length(name), F.lit(0)) if kind == "string" else F.lit(8) for name, kind in rows.dtypes]
    total = rows.agg(F.sum(reduce(add, sizes).cast("bigint"))).first()[0] or 0
    return max(least, -(-total // (most_bytes or FILE_BYTES)))


def _in_order(rows, key, least, most_bytes=None):
    """Rows dealt to files by ranges of ``key``, in its order, so that the order of the files is that of the rows."""
    return rows.repartitionByRange(_files(rows, least, most_bytes), key).sortWithinPartitions(key)


def _write_arrays(rows, path, indented):
    """Rows as .json files of one array each, in the order of their id."""
    entry = F.to_json(F.struct(*rows.columns), {"pretty": str(indented).lower()})
    dealt = _in_order(rows, "id", 4, FILE_BYTES if indented else LINE_BYTES).select(entry.alias("value"))
    folder = scratch_path(rows.sparkSession, "arrays")
    dealt.mapInArrow(_array_by_entries if indented else _array_on_one_line, "value string").write.text(folder)
    _move_as_json(rows.sparkSession, folder, path)


def _array_by_entries(batches):
    """The entries of a file as those of one array, each in lines of its own."""
    ahead, held = "[", None
    for batch in batches:
        entries = batch.column("value").to_pylist()
        if held is not None and entries:
            yield _lines([ahead + held + ","])
            ahead = ""
        if len(entries) > 1:
            yield _lines([ahead + entries[0] + ",", *[entry + "," for entry in entries[1:-1]]])
            ahead = ""
        held = entries[-1] if entries else held
    if held is not None:
        yield _lines([ahead + held + "]"])


def _array_on_one_line(batches):
    entries = [entry for batch in batches for entry in batch.column("value").to_pylist()]
    if entries:
        yield _lines(["[" + ",".join(entries) + "]"])


def _lines(values):
    return pa.RecordBatch.from_arrays([pa.array(values, pa.string())], ["value"])


def _move_as_json(spark, source, target):
    """Move the text files of a folder into another as .json files."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(fs_path(target))
    for i, status in enumerate(fs.listStatus(fs_path(source))):
        name = status.getPath().getName()
        if name.endswith(".txt"):
            fs.rename(status.getPath(), fs_path(f"{target}/{name.removesuffix('.txt')}-{i}.json"))


@query("scan_parquet", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def parquet(spark, sf):
    return scan_parquet(spark, f"{sf}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query(
    "scan_directory",
    """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate,'%Y-%m-%d %H:%M:%S') AS o_orderdate,
       o_orderpriority FROM orders""",
)
def directory(spark, sf):
    # CSV comes before JSON in the search order, so the JSON files beside it are left alone.
    path = scratch_path(spark, "directory")
    orders = fx.table(spark, sf, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    orders.write.option("header", True).csv(path)
    fx.table(spark, sf, "customer").write.mode("append").json(path)
    return load_dataset(spark, f"file://{path}")


@query("scan_glob", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def glob(spark, sf):
    path = scratch_path(spark, "glob")
    customer = fx.table(spark, sf, "customer")
    customer.repartition(_files(customer, 4), "c_custkey").write.json(path)
    return load_dataset(spark, f"{path}/part-*.json").select("c_custkey", "c_name", "c_acctbal")


@query("row_index", "SELECT doc_id AS row_index, doc_id, lang, n_chars FROM documents")
def row_index(spark, sf):
    path = scratch_path(spark, "lines")
    docs = fx.table(spark, sf, "documents").select("doc_id", "lang", "n_chars", "text")
    _in_order(docs, "doc_id", 4).write.json(path)
    lines = scan_json(spark, path, docs.schema)
    return with_row_index(lines).select("row_index", "doc_id", "lang", "n_chars")


@query("row_index_csv", "SELECT doc_id AS row_index, doc_id, lang, md5(text) AS text_md5 FROM documents")
def row_index_csv(spark, sf):
    """Texts with line breaks inside quotes, numbered in file order."""
    path = scratch_path(spark, "csv")
    docs = fx.table(spark, sf, "documents").select("doc_id", "lang", "text")
    _in_order(docs, "doc_id", 4).write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    rows = load_dataset(spark, f"{path}/*.csv", docs.schema, row_index=True)
    return rows.select("row_index", "doc_id", "lang", F.md5("text").alias("text_md5"))


@query("row_index_json", "SELECT doc_id AS row_index, doc_id AS id, lang, md5(text) AS text_md5 FROM documents")
def row_index_json(spark, sf):
    """Indented arrays, numbered in file order."""
    path = scratch_path(spark, "json")
    docs = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", "text")
    _write_arrays(docs, path, True)
    rows = load_dataset(spark, path, docs.schema, row_index=True)
    return rows.select("row_index", "id", "lang", F.md5("text").alias("text_md5"))


@query("row_index_ledger", "SELECT row_number() OVER (ORDER BY doc_id % 3 = 1, doc_id) - 1 AS row_index, doc_id, lang FROM documents")
def row_index_ledger(spark, sf):
    """Files in two steps: the second step's sort before some of the first, and are numbered after them."""
    source, stored = scratch_path(spark, "growing"), scratch_path(spark, "ingested")
    docs = fx.table(spark, sf, "documents").select("doc_id", "lang", "text")
    for second in (False, True):
        part = docs.where((F.col("doc_id") % 3 == 1) == second)
        _in_order(part, "doc_id", 3).write.mode("append").json(source)
        ingest_files(spark, f"{source}/*.json", stored, docs.schema)
    return read_ingested(spark, stored).select("row_index", "doc_id", "lang")


@query("row_index_parquet", "SELECT o_orderkey AS row_index, o_orderkey, o_custkey FROM orders")
def row_index_parquet(spark, sf):
    raw, stored = scratch_path(spark, "raw"), scratch_path(spark, "stored")
    _in_order(fx.table(spark, sf, "orders"), "o_orderkey", 4).write.parquet(raw)
    ingest(scan_parquet(spark, raw), stored, parquet=True)
    return spark.read.parquet(stored).select("row_index", "o_orderkey", "o_custkey")


_PROFILE = " UNION ALL ".join(
    f"SELECT '{name}' AS dataset_id, (SELECT count(*) FROM {name}) AS num_rows, unnest(range(len(t))) AS position, unnest(t) AS type"
    f" FROM (SELECT [{types}] AS t)"
    for name, types in {
        "region": "'int32','string'",
        "nation": "'int32','string','int32'",
        "customer": "'int64','string','int32','float64','string'",
        "supplier": "'int64','string','int32','float64'",
        "part": "'int64','string','string','string','int32','float64'",
        "orders": "'int64','int64','string','float64','timestamp[us]','string'",
        "lineitem": "'int64','int64','int64','int32','float64','float64','float64','float64','string','string','timestamp[us]'",
        "events": "'int64','timestamp[us]','int64','string','float64','string'",
        "documents": "'int64','string','string','string','int64'",
        "embeddings": "'int64','list<float32>','int32'",
        "pages": "'int64','string','string'",
        "benchmark": "'int64','string'",
        "labels": "'int64','int32','int32'",
        "conversations": "'int64','int64','string','string'",
    }.items()
)


@query("dataset_profile", _PROFILE)
def profile(spark, sf):
    profiles = profile_all({name: fx.table(spark, sf, name) for name in TABLES})
    columns = profiles.select("dataset_id", "num_rows", F.posexplode("columns").alias("position", "c"))
    return columns.select("dataset_id", "num_rows", F.col("position").cast("bigint").alias("position"), F.col("c.type").alias("type"))


@query(
    "catalog_list",
    """SELECT dataset_id, source, num_rows, strftime(created_at,'%Y-%m-%d %H:%M:%S.%f') AS created_at,
       columns::json->0->>'$.name' AS first_column, json_array_length(columns) AS n_columns,
       row_number() OVER (ORDER BY created_at DESC, dataset_id) AS place FROM catalog""",
)
def catalogs(spark, sf):
    listed = catalog_list(fx.catalog(spark, sf)).select(
        "dataset_id", "source", "num_rows", "created_at", F.col("columns")[0]["name"].alias("first_column"),
        F.size("columns").cast("bigint").alias("n_columns"),
    )
    # The sort splits the rows into ranges, so numbering the ranges in order gives each row's place.
    path = scratch_path(spark, "listed")
    listed.write.parquet(path)
    from annolytics.sources.rowindex import with_row_index_parquet

    return plain(with_row_index_parquet(spark.read.parquet(path)).withColumn("place", F.col("row_index") + 1).drop("row_index"))


def _seed_file(spark, sf) -> str:
    """Users and their roles as a file of one seed document per line."""
    path = scratch_path(spark, "seed")
    people = role_map(fx.users(spark, sf), fx.permissions(spark, sf)).select(
        F.col("user_id").alias("id"), "name", "global_role", "project_roles"
    )
    people.select(F.array(F.struct("*")).alias("users")).write.json(path)
    return path


@query("seed_users", "SELECT user_id, name, global_role FROM users")
def seeded_users(spark, sf):
    return seed_users(spark, _seed_file(spark, sf), lines=True)[0]


@query("seed_permissions", "SELECT user_id, project_id, role FROM permissions")
def seeded_permissions(spark, sf):
    return seed_users(spark, _seed_file(spark, sf), lines=True)[1]


_EXPORT = """SELECT row_index, user_id, data, strftime(created_at,'%Y-%m-%d %H:%M:%S.%f') AS created_at,
  strftime(updated_at,'%Y-%m-%d %H:%M:%S.%f') AS updated_at FROM ann"""


@query("export_parquet", _EXPORT)
def exported_parquet(spark, sf):
    path = scratch_path(spark, "export")
    export_annotations(fx.annotations(spark, sf), fx.PROJECT, path)
    return plain(spark.read.parquet(path).withColumn("data", F.decode("data", "utf-8")))


@query("export_jsonl", _EXPORT)
def exported_jsonl(spark, sf):
    path = scratch_path(spark, "export")
    export_annotations(fx.annotations(spark, sf), fx.PROJECT, path, "jsonl")
    schema = "row_index bigint, user_id string, data string, created_at timestamp_ntz, updated_at timestamp_ntz"
    return plain(spark.read.schema(schema).json(path))
