"""All pages written as archives and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from annolytics.llm.registry import query, table
from annolytics.llm.warc import page_id_of, read_warc, write_warc
from annolytics.session import scratch_path

OP3_SQL = """WITH p AS (SELECT page_id, coalesce(html,'') AS h FROM pages),
  m AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest, max(page_id) OVER (PARTITION BY h) AS last FROM p)
  SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to FROM m"""


@query("op3_warc_round_trip", OP3_SQL)
def warc_round_trip(spark, sf):
    files = write_warc(table(spark, sf, "pages"), scratch_path(spark, "warc"))
    records = read_warc(spark, files).where("record_type IN ('response', 'revisit')")
    found = F.when(F.col("record_type") == "response", F.sha1("payload")).otherwise(F.col("payload_digest"))
    length = F.when(F.col("record_type") == "response", F.octet_length("payload")).otherwise(F.col("http_length"))
    checked = F.when(found == F.col("payload_digest"), found).otherwise(F.raise_error(F.concat(F.lit("damaged record "), "record_id")))
    return records.select(
        page_id_of(F.col("record_id")).alias("page_id"),
        length.cast("bigint").alias("payload_bytes"),
        checked.alias("payload_digest"),
        "record_type",
        page_id_of(F.col("refers_to")).alias("refers_to"),
    )
