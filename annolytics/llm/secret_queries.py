"""Secrets of all documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from annolytics.llm.registry import query, table
from annolytics.llm.secret_scan import find_secrets


def digest(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined in their order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


# What a primed compressor finds is beyond SQL; tests compare the spans with a search of their own.
@query("op11_primed_secret_scan")
def primed_secret_scan(spark, sf):
    found = find_secrets(table(spark, sf, "documents").select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("_spans", lambda s: s["kind"] != "novel")
    return found.select(
        "_rest.doc_id", of("assign"), of("access"), of("hex"), F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("_spans")).alias("spans"), of("novel")
    )
