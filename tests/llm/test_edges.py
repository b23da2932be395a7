"""Empty tables and clashing column names of operators whose other tests have none."""

import pytest
from pyspark.sql import functions as F

from annolytics.llm import line_quality as lq
from annolytics.llm import masked_lm as lm
from annolytics.llm import token_scan as ts
from annolytics.llm.warc import read_warc, write_warc
from annolytics.session import scratch_path
from tests.llm.test_corpus import WORDS


def test_quality_of_no_documents(documents):
    assert lq.quality_lines(documents([])).count() == 0 and lq.clean_documents(documents([])).count() == 0


def test_scores_beside_columns_of_their_names(documents):
    docs = documents([(1, "one two"), (2, None), (2, None)]).withColumnsRenamed({"source": "score", "n_chars": "_part"}).withColumn("_text", F.lit("x"))
    rows = lm.score_documents(docs).collect()
    assert sorted((r._rest.doc_id, r._rest["score"], r._rest["_text"], r.n_tokens) for r in rows) == [(1, "s", "x", 2), (2, "s", "x", 0), (2, "s", "x", 0)]


def test_token_files_of_no_documents(spark, documents):
    files, listed = ts.write_token_files(documents([]), scratch_path(spark, "t"), WORDS, 49407)
    assert listed.count() == 0 and ts.count_tokens(spark, files, 49407).count() == 0


def test_pages_with_more_columns(spark):
    pages = spark.createDataFrame([(1, "u", "x" * 1200, "a", "b"), (2, "u", "x" * 1200, "a", None)], "page_id bigint, url string, html string, payload string, record_type string")
    records = read_warc(spark, write_warc(pages, scratch_path(spark, "w"))).where("record_type IN ('response', 'revisit')")
    assert sorted(r.record_type for r in records.collect()) == ["response", "revisit"]


@pytest.mark.parametrize("n", [0, 1])
def test_few_texts_have_a_network(documents, n):
    docs = documents([(i, "a b c") for i in range(n)])
    assert lm.score_documents(docs).count() == n
