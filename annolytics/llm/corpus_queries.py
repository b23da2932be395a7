"""Sharding, packing and mixing of all documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from annolytics.llm.mixing import mix_sources, taken_words, word_count
from annolytics.llm.packing import pack_documents, piece_columns
from annolytics.llm.registry import query, table
from annolytics.llm.sharding import assign_shards, byte_size
from annolytics.llm.token_scan import count_tokens, write_token_files
from annolytics.session import scratch_path



def _crc_step(value: int, bits: int) -> int:
    for _ in range(bits):
        value = (value >> 1) ^ (0xEDB88320 if value & 1 else 0)
    return value


# The checksum in SQL: four bits at a time, lowest first, over the hex digits of the bytes.
CRC_TABLE = ",".join(str(_crc_step(n, 4)) for n in range(16))
CRC_SQL = f"""list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(regexp_extract_all(h, '..'),
    lambda b: [instr('123456789ABCDEF', b[2])::BIGINT, instr('123456789ABCDEF', b[1])::BIGINT]))),
    lambda acc, nib: xor(acc >> 4, [{CRC_TABLE}][1 + (xor(acc, nib) & 15)]))"""


def crc32(text):
    return F.crc32(F.coalesce(F.encode(text, "UTF-8"), F.lit(b"")))


OP2_SQL = (
    r"""WITH d AS (SELECT doc_id, (strlen(coalesce(text,'')) + 16)::BIGINT AS size, hex(encode(coalesce(text,''))) AS h, text FROM documents),
  n AS (SELECT doc_id, size, xor("""
    + CRC_SQL
    + r""", 4294967295) AS text_crc32 FROM d),
  s AS (SELECT *, coalesce(sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
      sum(size) OVER () AS total, row_number() OVER (ORDER BY doc_id, text_crc32, size) AS pos FROM n),
  c AS (SELECT *, ((2*before + size) * 40 // (2*total))::INTEGER AS shard FROM s)
  SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, (pos - min(pos) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM c"""
)


@query("op2_byte_balanced_shards", OP2_SQL)
def byte_balanced_shards(spark, sf):
    docs = table(spark, sf, "documents")
    rows = docs.select("doc_id", byte_size(F.col("text")).alias("size"), crc32(F.col("text")).alias("text_crc32"))
    placed = assign_shards(rows, ["doc_id"], "size", 40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op6_source_mix")
def source_mix(spark, sf):
    docs = table(spark, sf, "documents")
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    mixed = mix_sources(rows, "source", "size", ["doc_id"])
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), taken_words().alias("taken"))


@query("op4_vector_packing")
def vector_packing(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    packed = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return packed.select("_rest.doc_id", *piece_columns())


@query("op7_separator_scan")
def separator_scan(spark, sf):
    """Tokens of every document, counted in flat files of ids."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    end_id = 49407
    files, listed = write_token_files(docs, scratch_path(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json"), end_id)
    counted = count_tokens(spark, files, end_id)
    return listed.join(counted, ["path", "ordinal"]).select("_rest.doc_id", F.col("tokens").alias("n_tokens"))
