"""Near-duplicates of all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from annolytics.llm.minmax_dedup import NearDupSettings, near_duplicates
from annolytics.llm.registry import query, table

OP1_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),
      '[^\x20\x09-\x0D]+') AS ws FROM documents),
  s AS (SELECT doc_id, CASE WHEN len(ws)=0 THEN [] WHEN len(ws)<3 THEN [array_to_string(ws,' ')]
      ELSE list_distinct([ws[i]||' '||ws[i+1]||' '||ws[i+2] FOR i IN range(1,len(ws)-1)]) END AS sh FROM w),
  n AS (SELECT doc_id, len(sh) AS n FROM s), u AS (SELECT doc_id, unnest(sh) AS g FROM s),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM u a JOIN u b ON a.g=b.g AND a.doc_id<b.doc_id GROUP BY ALL),
  l AS (SELECT a, b FROM p JOIN n x ON x.doc_id=a JOIN n y ON y.doc_id=b WHERE 100*m >= 85*(x.n+y.n-m)),
  e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
  r(doc_id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a=r.reached),
  c AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
  SELECT doc_id, n.n::BIGINT AS n_shingles, component_id, doc_id=component_id AS kept FROM n JOIN c USING (doc_id)"""


@query("op1_minmax_near_dedup", OP1_SQL)
def near_dedup(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = near_duplicates(docs, settings=NearDupSettings(shingle=3, numerator=85, denominator=100))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("is_first") & F.col("component_id").isNull())
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))
