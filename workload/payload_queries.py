"""Annotation payloads, text models and pre-labelling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annolytics.functions import text as tx
from annolytics.operators import payloads as pl
from annolytics.operators import prefill as pf
from annolytics.operators.pyramid import pyramid_envelope, write_pyramid
from annolytics.plans.ranking import blocked_positions
from annolytics.session import scratch_path
from annolytics.streaming.prefill_job import run_prefill_job
from annolytics.streaming.store import ProjectStore
from workload import fixtures as fx
from workload.registry import query

EVENT_LABELS = T.StructType().add("label", "string").add("score", "double").add("rating", "integer")


@query(
    "payload_typed",
    """SELECT event_id, CASE WHEN good THEN data::json->>'$.label' END AS label, CASE WHEN good THEN (data::json->>'$.score')::double END AS score,
         CASE WHEN good THEN (data::json->>'$.rating')::int END AS rating, NOT good AS bad_payload
       FROM (SELECT event_id, data, event_id%10<>0 AS good FROM submissions)""",
)
def payload_typed(spark, sf):
    cut = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("["), F.col("data"))).otherwise(F.col("data"))
    broken = fx.submissions(spark, sf).select("event_id", cut.alias("data"))
    return pl.payload_typed(broken, EVENT_LABELS)


@query(
    "payload_fields",
    """SELECT project_id, row_index, user_id, unnest(['label','score','rating']) AS field,
         unnest([data::json->>'$.label', data::json->>'$.score', data::json->>'$.rating']) AS value FROM annotations""",
)
def payload_fields(spark, sf):
    return pl.payload_fields(fx.annotations(spark, sf).select("project_id", "row_index", "user_id", "data"))


@query(
    "preview_merge",
    """WITH l AS (SELECT row_index, arg_max(data, row(created_at,user_id)) AS data FROM ann GROUP BY 1)
       SELECT row_index, unnest(['lang','label','score','rating']) AS field,
         unnest([lang, data::json->>'$.label', data::json->>'$.score', data::json->>'$.rating']) AS value,
         unnest([false,true,true,true]) AS from_label FROM dataset JOIN l USING (row_index)
       UNION ALL SELECT row_index, 'lang', lang, false FROM dataset WHERE row_index NOT IN (SELECT row_index FROM l)
       UNION ALL SELECT row_index, 'source', source, false FROM dataset""",
)
def preview_merge(spark, sf):
    return pl.preview_merge(fx.dataset(spark, sf), ["lang", "source"], fx.project_rows(spark, sf))


@query(
    "entity_mentions",
    """SELECT row_index, CASE no WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS mention_no, s AS start, e AS "end", entity,
         substr(text, s+1, e-s) AS mention FROM entity_spans""",
)
def entity_mentions(spark, sf):
    return pl.entity_mentions(fx.entities(spark, sf), ["row_index"])


@query(
    "text_segments",
    """WITH p AS (
         SELECT row_index, text, s AS place, 1 AS k, 'marked' AS kind, entity, s, e FROM entity_spans
         UNION ALL SELECT row_index, text, 20, 0, 'plain', NULL, 9, 20 FROM entity_spans WHERE no=0
         UNION ALL SELECT row_index, text, 1000000000, 0, 'plain', NULL, CASE WHEN row_index%5=0 THEN 35 ELSE 30 END, length(text)
           FROM entity_spans WHERE no=0 AND length(text) > CASE WHEN row_index%5=0 THEN 35 ELSE 30 END)
       SELECT row_index, row_number() OVER (PARTITION BY row_index ORDER BY place, k)-1 AS segment_no, kind, entity, substr(text, s+1, e-s) AS piece FROM p""",
)
def text_segments(spark, sf):
    cut = pl.text_segments(fx.entities(spark, sf), ["row_index"])
    return cut.withColumn("segment_no", F.col("segment_no").cast("bigint"))


_BOX = "round(x,6) AS x, round(y,6) AS y, round(w,6) AS w, round(h,6) AS h"


def _box_rows(rows: DataFrame) -> DataFrame:
    exploded = rows.select("vec_id", F.explode("boxes").alias("b"))
    return exploded.select("vec_id", *[F.round(F.col("b")[c], 6).alias(c) for c in "xywh"], F.col("b.category").alias("category"))


@query("bbox_from_corners", f"SELECT vec_id, {_BOX}, category FROM boxes")
def bbox_from_corners(spark, sf):
    return _box_rows(fx.corners(spark, sf).select("vec_id", pl.boxes_from_corners(F.col("corners")).alias("boxes")))


@query(
    "bbox_clamp",
    f"""SELECT vec_id, {_BOX}, category FROM (SELECT vec_id, greatest(0,least(1-w,x*3-0.2)) AS x, greatest(0,least(1-h,y*3-0.2)) AS y,
          w, h, category FROM boxes)""",
)
def bbox_clamp(spark, sf):
    moved = lambda b: b.withField("x", b["x"] * 3 - 0.2).withField("y", b["y"] * 3 - 0.2)
    boxes = F.transform(pl.boxes_from_corners(F.col("corners")), moved)
    return _box_rows(fx.corners(spark, sf).select("vec_id", pl.clamp_boxes(boxes).alias("boxes")))


_SEGMENTS = """SELECT event_id, greatest(0,least(30,s)) AS s, greatest(0,least(30,e)) AS e, s=e AS point, event_type AS label FROM
  (SELECT event_id, event_type, value/10 AS s, value/10+(event_id%7)*0.02::double AS e FROM events)"""


@query(
    "segment_clean",
    f"""SELECT event_id, round(s,6) AS start, round(e,6) AS "end", label FROM ({_SEGMENTS}) WHERE point OR e-s>=0.05::double""",
)
def segment_clean(spark, sf):
    cleaned = fx.segments(spark, sf).select("event_id", F.explode(pl.clean_segments(F.col("segments"), F.col("duration"))).alias("s"))
    return cleaned.select(
        "event_id", F.round("s.start", 6).alias("start"), F.round("s.end", 6).alias("end"), F.col("s.label").alias("label")
    )


def _clock(column: str) -> str:
    return f"floor({column}/60)::int||':'||lpad(floor({column}%60)::int::varchar,2,'0')"


@query(
    "format_time",
    f"""SELECT event_id, {_clock('value')} AS clock, CASE WHEN s=e THEN '@ '||{_clock('s')} ELSE {_clock('s')}||' – '||{_clock('e')} END AS segment
        FROM (SELECT event_id, value, value AS s, value+(event_id%7)*20 AS e FROM events)""",
)
def format_time(spark, sf):
    end = F.col("value") + (F.col("event_id") % 7) * 20
    return fx.table(spark, sf, "events").select(
        "event_id", tx.format_time(F.col("value")).alias("clock"), tx.format_segment(F.col("value"), end).alias("segment")
    )


@query(
    "peak_envelope",
    """WITH s AS (SELECT event_type AS clip, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id)-1 AS p FROM events),
       w AS (SELECT clip, count(*)//300 AS width FROM s GROUP BY 1)
       SELECT clip, t.bar::int AS bar, coalesce(max(abs(value)),0) AS peak FROM w CROSS JOIN range(300) t(bar)
         LEFT JOIN s ON s.clip=w.clip AND p>=t.bar*width AND p<(t.bar+1)*width GROUP BY 1,2""".replace(
        "SELECT clip, t.bar", "SELECT w.clip AS clip, t.bar"
    ),
)
def peak_envelope(spark, sf):
    events = fx.table(spark, sf, "events").select(F.col("event_type").alias("clip"), "event_id", "value")
    return pl.peak_envelope(blocked_positions(events, ["clip"], "event_id"), "clip", "position", "value")


_SAMPLES = """s AS (SELECT event_type AS clip, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id)-1 AS p FROM events),
  n AS (SELECT clip, count(*) AS n FROM s GROUP BY 1)"""


def _pyramid(spark, sf):
    """The pyramid of all clips, stored once per session."""
    events = fx.table(spark, sf, "events").select(F.col("event_type").alias("clip"), "event_id", "value")
    placed = lambda: blocked_positions(events, ["clip"], "event_id")
    return fx.stored(spark, sf, "pyramid", lambda path: write_pyramid(placed(), "clip", "position", "value", path))


@query(
    "peak_pyramid",
    f"""WITH {_SAMPLES}, w AS (SELECT clip, n//300 AS width FROM n)
       SELECT w.clip AS clip, t.bar::int AS bar, coalesce(max(abs(value)),0) AS peak FROM w CROSS JOIN range(300) t(bar)
         LEFT JOIN s ON s.clip=w.clip AND p>=t.bar*width AND p<(t.bar+1)*width GROUP BY 1,2""",
)
def peak_pyramid(spark, sf):
    return pyramid_envelope(spark, _pyramid(spark, sf), "clip", T.StringType()).select("clip", "bar", "peak")


@query(
    "peak_zoom",
    f"""WITH {_SAMPLES}, r AS (SELECT clip, z AS lo, least(z + 3*z + 41, n) AS hi FROM n CROSS JOIN (SELECT unnest([0, 10, 77, 300]) AS z)),
       w AS (SELECT *, greatest(hi-lo, 0)//20 AS width FROM r)
       SELECT w.clip AS clip, lo AS start, hi AS "end", t.bar::int AS bar, coalesce(max(abs(value)),0) AS peak FROM w CROSS JOIN range(20) t(bar)
         LEFT JOIN s ON s.clip=w.clip AND p>=lo+t.bar*width AND p<lo+(t.bar+1)*width GROUP BY 1,2,3,4""",
)
def peak_zoom(spark, sf):
    """Twenty bars of four ranges of every clip."""
    clips = fx.table(spark, sf, "events").select(F.col("event_type").alias("clip")).distinct()
    start = F.explode(F.array(*[F.lit(z) for z in (0, 10, 77, 300)]))
    ranges = clips.select("clip", start.alias("start")).withColumn("end", F.col("start") * 4 + 41)
    return pyramid_envelope(spark, _pyramid(spark, sf), "clip", T.StringType(), 20, ranges)


@query(
    "peak_envelope_array",
    """SELECT vec_id, bar::int AS bar, list_max(list_transform(embedding[bar*6+1:bar*6+6], lambda v: abs(v::double))) AS peak
       FROM embeddings, range(10) t(bar)""",
)
def peak_envelope_array(spark, sf):
    bars = pl.peak_envelope_array(F.col("embedding"), 10)
    return fx.table(spark, sf, "embeddings").select("vec_id", F.posexplode(bars).alias("bar", "peak"))


_TEMPLATE = r"""SELECT template_id, f AS field FROM (SELECT template_id, unnest(regexp_extract_all(source,
  '<(?:SelectField|TextField|CheckboxGroup|RatingField|NERField|BBoxField{audio})\s[^>]*?name="([^"]+)"',1)) AS f FROM templates)"""


@query("template_fields", _TEMPLATE.format(audio=""))
def template_fields(spark, sf):
    rows = fx.templates(spark, sf)
    return rows.select("template_id", F.explode(tx.template_fields(F.col("source"))).alias("field"))


@query("template_fields_audio", _TEMPLATE.format(audio="|AudioSegmentField"))
def template_fields_audio(spark, sf):
    rows = fx.templates(spark, sf)
    return rows.select("template_id", F.explode(tx.template_fields(F.col("source"), include_audio=True)).alias("field"))


# --- text models and pre-labelling -------------------------------------------------------------


@query(
    "pick_text",
    r"""SELECT 'documents' AS source_table, doc_id AS id, md5(CASE WHEN regexp_matches(text,'\S') THEN text WHEN length(text)>20 THEN text
          ELSE doc_id::varchar END) AS picked FROM documents
        UNION ALL SELECT 'pages', page_id, md5(CASE WHEN length(url)>20 THEN url ELSE html END) FROM pages
        UNION ALL SELECT 'part', p_partkey, md5(CASE WHEN length(p_name)>20 THEN p_name WHEN length(p_brand)>20 THEN p_brand
          WHEN length(p_type)>20 THEN p_type ELSE p_partkey::varchar END) FROM part""",
)
def pick_text(spark, sf):
    keys = {"documents": "doc_id", "pages": "page_id", "part": "p_partkey"}
    picked = []
    for name, key in keys.items():
        df = fx.table(spark, sf, name)
        picked.append(df.select(F.lit(name).alias("source_table"), F.col(key).alias("id"), F.md5(tx.pick_text(df.schema)).alias("picked")))
    return reduce(DataFrame.unionByName, picked)


def _sentiment_sql(text: str) -> str:
    words = f"list_distinct(regexp_extract_all(lower({text}),'[a-z'']+'))"
    count = lambda lexicon: f"len(list_intersect({words},{list(lexicon)!r}))"
    pos, neg = count(fx.POSITIVE), count(fx.NEGATIVE)
    return f"CASE WHEN {pos}>{neg} THEN 'positive' WHEN {neg}>{pos} THEN 'negative' ELSE 'neutral' END"


@query("lexicon_sentiment", f"SELECT doc_id, {_sentiment_sql('text')} AS sentiment FROM documents")
def lexicon_sentiment(spark, sf):
    return fx.table(spark, sf, "documents").select(
        "doc_id", tx.lexicon_sentiment(F.col("text"), fx.POSITIVE, fx.NEGATIVE).alias("sentiment")
    )


def _model(rows: DataFrame):
    return pf.lexicon_model(rows.schema, fx.POSITIVE, fx.NEGATIVE)


def count_marks(row: dict) -> dict | None:
    """A Python model: counts question marks; fails on French and on rows it has nothing to say about."""
    if row["lang"] == "fr":
        raise ValueError("language not supported")
    marks = row["text"].count("?")
    return {"marks": marks} if marks else None


_TODO = "SELECT * FROM dataset WHERE row_index NOT IN (SELECT row_index FROM ml_annotations)"


@query("rows_to_prefill", "SELECT row_index, lang FROM dataset WHERE row_index NOT IN (SELECT row_index FROM ml_annotations)")
def rows_to_prefill(spark, sf):
    return pf.rows_to_prefill(fx.dataset(spark, sf), fx.ml_annotations(spark, sf)).select("row_index", "lang")


@query(
    "rows_to_prefill_subset",
    f"SELECT row_index, lang FROM ({_TODO}) WHERE row_index IN (SELECT row_index FROM ann)",
)
def rows_to_prefill_subset(spark, sf):
    todo = pf.rows_to_prefill(fx.dataset(spark, sf), fx.ml_annotations(spark, sf), fx.project_rows(spark, sf))
    return todo.select("row_index", "lang")


@query(
    "prefill_batch",
    f"""SELECT 'p0' AS project_id, row_index, 'lexicon' AS annotator, to_json({{sentiment:{_sentiment_sql('text')}}})::varchar AS data, true AS ok
        FROM ({_TODO})""",
)
def prefill_batch(spark, sf):
    rows = fx.dataset(spark, sf)
    attempts = pf.prefill_batch(rows, fx.ml_annotations(spark, sf), _model(rows), fx.PROJECT, "lexicon", fx.NOW)
    return attempts.select("project_id", "row_index", "annotator", "data", "ok")


_MARKS = f"""SELECT row_index, n>0 AND lang<>'fr' AS ok, CASE WHEN n>0 AND lang<>'fr' THEN '{{"marks": '||n||'}}' END AS data
  FROM (SELECT *, length(text)-length(replace(text,'?','')) AS n FROM ({_TODO}))"""


@query("prefill_batch_python", _MARKS)
def prefill_batch_python(spark, sf):
    attempts = pf.prefill_batch(
        fx.dataset(spark, sf), fx.ml_annotations(spark, sf), count_marks, fx.PROJECT, "marks", fx.NOW, columns=["text", "lang"]
    )
    return attempts.select("row_index", "ok", "data")


@query(
    "prefill_summary",
    f"""SELECT (SELECT count(*) FROM dataset) AS total, count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS failed FROM ({_MARKS})""",
)
def prefill_summary(spark, sf):
    rows = fx.dataset(spark, sf)
    marks = F.length("text") - F.length(F.replace("text", F.lit("?"), F.lit("")))
    model = F.when((marks > 0) & (F.col("lang") != "fr"), F.to_json(F.struct(marks.alias("marks"))))
    attempts = pf.prefill_batch(rows, fx.ml_annotations(spark, sf), model, fx.PROJECT, "marks", fx.NOW)
    return pf.prefill_summary(rows, attempts)


@query(
    "prefill_lookup",
    f"""SELECT row_index, data, annotator, 'stored' AS source FROM ml_annotations WHERE row_index IN (SELECT row_index FROM submissions)
        UNION ALL SELECT row_index, to_json({{sentiment:{_sentiment_sql('text')}}})::varchar, 'fresh', 'computed'
        FROM ({_TODO}) WHERE row_index IN (SELECT row_index FROM submissions)""",
)
def prefill_lookup(spark, sf):
    rows = fx.dataset(spark, sf)
    return pf.prefill_lookup(fx.submissions(spark, sf), rows, fx.ml_annotations(spark, sf), _model(rows), "fresh")


@query(
    "prefill_job",
    f"""SELECT row_index, data, (SELECT count(*) FROM ({_MARKS}) WHERE ok) AS succeeded, (SELECT count(*) FROM ({_MARKS}) WHERE NOT ok) AS failed
        FROM ({_MARKS}) WHERE ok""",
)
def prefill_job(spark, sf):
    """A job in several batches, called again when it is done."""
    store, job = ProjectStore(spark, scratch_path(spark, "store")), scratch_path(spark, "job")
    made = {"ts": F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), "event_id": F.lit(0).cast("bigint")}
    store.upsert({"ml_annotations": fx.ml_annotations(spark, sf).withColumns(made)})
    for _ in range(2):
        summary = run_prefill_job(
            fx.dataset(spark, sf), store, count_marks, fx.PROJECT, "marks", fx.NOW, job, columns=["text", "lang"], calls=pf.Calls(at_once=4), file_rows=200, batch_files=4
        ).first()
    counts = [F.lit(summary[name]).cast("bigint").alias(name) for name in ("succeeded", "failed")]
    return store.read("ml_annotations").where("annotator = 'marks'").select("row_index", "data", *counts)


@query(
    "prefill_stored",
    f"""SELECT row_index, annotator, data FROM ml_annotations
        UNION ALL SELECT row_index, 'lexicon', to_json({{sentiment:{_sentiment_sql('text')}}})::varchar FROM ({_TODO})""",
)
def prefill_stored(spark, sf):
    """The model annotation table after a stored pre-labelling run."""
    path = scratch_path(spark, "prefill")
    fx.ml_annotations(spark, sf).write.parquet(path)
    rows = fx.dataset(spark, sf)
    pf.run_prefill(rows, path, _model(rows), fx.PROJECT, "lexicon", fx.NOW)
    return spark.read.parquet(path).select("row_index", "annotator", "data")
