"""Nearest neighbours and hard negatives among all embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from annolytics.llm.registry import query, table
from annolytics.llm.rp_forest import nearest
from annolytics.llm.zone_negatives import mine_negatives


@query("op8_projection_forest")
def projection_forest(spark, sf):
    return nearest(table(spark, sf, "embeddings"), "vec_id", "embedding", F.col("id") % 20 == 0)


OP13_SQL = """WITH v AS (SELECT DISTINCT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, list_inner_product(a.v, b.v)::BIGINT AS score
    FROM v a JOIN v b ON (a.vec_id <> b.vec_id OR a.label <> b.label OR a.v <> b.v) AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
  p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
  n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
  SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""


def quantised(embeddings):
    """``(id, label, vector)`` of the rows that take part: ids divisible by 7 with the next label, components as whole numbers of 1/256."""
    whole = embeddings.where(
        "vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
    )
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("bigint")
    return whole.select(
        F.col("vec_id").cast("bigint").alias("id"), label.alias("label"), F.transform("embedding", lambda x: F.floor(256 * x.cast("double"))).alias("vector")
    )


@query("op13_zone_negatives", OP13_SQL)
def zone_negatives(spark, sf):
    return mine_negatives(quantised(table(spark, sf, "embeddings")), F.col("id") % 100 == 0)
