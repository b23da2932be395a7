"""The prefix trie of rebuilt conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolytics.llm.burst_trie import ID, prefix_trie, turn_sequences
from annolytics.llm.corpus_queries import CRC_SQL
from annolytics.llm.registry import query, table
from annolytics.session import settle

#: Conversations are rebuilt on the first turns, fewer than SHARED, of the first of their FAMILY.
FAMILY, SHARED = 5, 9

OP12_SQL = (
    """WITH t AS (SELECT conv_id, turn, coalesce(role,'') AS role, coalesce(text,'') AS text FROM conversations WHERE conv_id IS NOT NULL),
  k AS (SELECT *, md5(strlen(role)||':'||role||text) AS id, strlen(text)::BIGINT AS size FROM t),
  o AS (SELECT conv_id, list({'id': id, 'size': size} ORDER BY turn NULLS FIRST, role, id) AS ts, hex(encode(conv_id::VARCHAR)) AS h FROM k GROUP BY conv_id),
  c AS (SELECT conv_id, ts, (xor("""
    + CRC_SQL
    + f""", 4294967295) % {SHARED})::BIGINT AS n FROM o),
  r AS (SELECT c.conv_id, list_concat(coalesce(b.ts[1:c.n], []), c.ts[c.n+1:]) AS ts FROM c LEFT JOIN o b ON b.conv_id = c.conv_id - c.conv_id % {FAMILY}),
"""
    + """  p AS (SELECT conv_id, unnest(range(0, len(ts)+1)) AS depth, ts FROM r),
  m AS (SELECT conv_id, depth, len(ts) AS turns, array_to_string(list_transform(ts[1:depth], lambda x: x.id), '') AS node,
      CASE WHEN depth > 0 THEN array_to_string(list_transform(ts[1:depth-1], lambda x: x.id), '') END AS up, coalesce(ts[depth].size, 0) AS size FROM p),
  n AS (SELECT node, any_value(up) AS up, depth, any_value(size) AS size, min(conv_id) AS conv_id, count(*) AS n_convs,
      sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE turns = depth), '')) AS ends FROM m GROUP BY node, depth),
  l AS (SELECT n.*, (SELECT count(*) FROM n ch WHERE ch.up = n.node) AS n_children FROM n),
  a AS (SELECT node AS below, unnest(range(0, depth+1)) AS d, n_children, (n_convs-1)*size AS saved FROM l),
  s AS (SELECT substr(below, 1, 32*d) AS node, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM a GROUP BY 1)
  SELECT l.conv_id, l.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, l.n_convs, l.n_children, s.n_leaves, s.saved_tokens, l.ends AS ends_sha256
  FROM l JOIN s USING (node) LEFT JOIN l u ON u.node = l.up"""
)


def rebuilt(sequences: DataFrame) -> DataFrame:
    """Every conversation c with its first h turns taken from conversation c - c % 5 (none where that is absent), h = crc32 of its id modulo 9."""
    first = F.col("conv") - F.col("conv") % FAMILY
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(SHARED)).cast("int")
    lent = sequences.where(F.col("conv") % FAMILY == 0).select(
        F.col("conv").alias("first"), F.substring("path", 1, (SHARED - 1) * ID).alias("lent"), F.slice("sizes", 1, SHARED - 1).alias("lent_sizes")
    )
    joined = sequences.withColumns({"first": first, "h": h}).join(lent, "first", "left")
    taken = F.coalesce(F.substring("lent", F.lit(1), F.col("h") * ID), F.lit(b""))
    sizes = F.coalesce(F.slice("lent_sizes", F.lit(1), F.col("h")), F.array().cast("array<bigint>"))
    own = F.substring("path", F.col("h") * ID + 1, F.octet_length("path"))
    return joined.select("conv", F.concat(taken, own).alias("path"), F.concat(sizes, F.slice("sizes", F.col("h") + 1, F.size("sizes"))).alias("sizes"))


@query("op12_burst_trie", OP12_SQL)
def burst_trie(spark, sf):
    return prefix_trie(rebuilt(settle(turn_sequences(table(spark, sf, "conversations")), "conversation-turns")))
