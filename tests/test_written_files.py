"""The files that queries about sources write first: more of them for larger tables, none that grows with the table."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import SMOKE_DIR as SF
from workload import source_queries
from workload.registry import QUERIES


@pytest.mark.parametrize(
    ("name", "files", "key"),
    [
        ("row_index", "lines/*.json", "doc_id"),
        ("row_index_csv", "csv/*.csv", "doc_id"),
        ("row_index_json", "json/*.json", "id"),
        ("row_index_ledger", "growing/*.json", "doc_id"),
    ],
)
def test_files_do_not_grow_with_the_table(spark, tmp_path, monkeypatch, name, files, key):
    most = 20_000
    monkeypatch.setattr(source_queries, "FILE_BYTES", most)
    monkeypatch.setattr(source_queries, "scratch_path", lambda spark, label: str(tmp_path / label))
    found = [tuple(r) for r in QUERIES[name](spark, SF).select("row_index", key).collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id")
    ids = [r.doc_id for r in docs.collect()]
    if name == "row_index_ledger":
        ids.sort(key=lambda i: (i % 3 == 1, i))
    assert sorted(found) == list(enumerate(ids))
    total, longest = docs.agg(F.sum(F.octet_length("text")), F.max(F.octet_length("text"))).first()
    sizes = [os.path.getsize(f) for f in glob.glob(str(tmp_path / files))]
    assert total > 8 * most and max(sizes) <= 2 * most + 2 * longest and len(sizes) >= total / (2 * most)
