"""Annotation payloads: typed access, long form, overlays, spans, boxes and audio segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annolytics.functions.jsontext import payload_entries

# The payload type each widget produces.
WIDGET_TYPES = {
    "SelectField": "STRING",
    "TextField": "STRING",
    "RatingField": "INT",
    "CheckboxGroup": "ARRAY<STRING>",
    "NERField": "ARRAY<STRUCT<start:INT,end:INT,entity:STRING>>",
    "BBoxField": "ARRAY<STRUCT<x:DOUBLE,y:DOUBLE,w:DOUBLE,h:DOUBLE,category:STRING>>",
    "AudioSegmentField": "ARRAY<STRUCT<start:DOUBLE,end:DOUBLE,label:STRING>>",
}

# The smallest box side, the shortest range in seconds, the bars of a waveform.
MIN_BOX_SIDE = 0.005
MIN_RANGE_SECONDS = 0.05
WAVEFORM_BARS = 300


def label_schema(fields: dict[str, str]) -> T.StructType:
    """The payload schema of a template: label field name to widget."""
    ddl = ", ".join(f"`{name}` {WIDGET_TYPES[widget]}" for name, widget in fields.items())
    return T.StructType.fromDDL(ddl)


def payload_typed(annotations: DataFrame, schema: T.StructType) -> DataFrame:
    """Payloads as typed columns, and ``bad_payload`` for text that is not JSON of the schema."""
    corrupt = "_bad_text"
    parsed = F.from_json(
        "data", T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())]), {"columnNameOfCorruptRecord": corrupt}
    )
    return annotations.withColumn("_p", parsed).select(
        *[c for c in annotations.columns if c != "data"],
        *[F.col("_p")[name].alias(name) for name in schema.names],
        F.col("_p")[corrupt].isNotNull().alias("bad_payload"),
    )


def payload_fields(annotations: DataFrame) -> DataFrame:
    """Long form: one row per annotation and payload field, the value as display text."""
    keep = [c for c in annotations.columns if c != "data"]
    return annotations.select(*keep, F.explode(payload_entries(F.col("data"))).alias("field", "value"))


def latest_fields(annotations: DataFrame) -> DataFrame:
    """Per (row, payload field) the value of the last annotation; ties go to the later user id."""
    recency = F.struct("created_at", "user_id")
    return (
        payload_fields(annotations)
        .groupBy("row_index", "field")
        .agg(F.max_by(F.struct("value"), recency).alias("_last"))
        .select("row_index", "field", F.col("_last.value").alias("value"))
    )


def overlay_fields(annotations: DataFrame) -> DataFrame:
    """``(row_index, _overlay)``: the latest payload values of a row by field name.

    The aggregate before it leaves one value per row and field, so a row's map has as many
    entries as the template has label fields.
    """
    entry = F.struct("field", "value")
    return (
        latest_fields(annotations)
        .groupBy("row_index")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("_overlay"))
    )


def preview_merge(dataset: DataFrame, fields: Sequence[str], annotations: DataFrame) -> DataFrame:
    """Row fields overlaid with payload fields: ``(row_index, field, value, from_label)``.

    A row's fields and its overlay meet as maps, in one join on row_index, and become rows after it. A label can only bring
    rows of the dataset, and may add fields the dataset lacks.
    """
    entry = lambda value, is_label: F.struct(value.alias("value"), F.lit(is_label).alias("from_label"))
    base = F.map_from_arrays(F.array(*[F.lit(name) for name in fields]), F.array(*[entry(F.col(name).cast("string"), False) for name in fields]))
    labels = F.transform_values("_overlay", lambda k, v: entry(v, True))
    own = F.map_filter("_base", lambda k, v: ~F.map_contains_key("_labels", k))
    joined = dataset.select("row_index", base.alias("_base")).join(overlay_fields(annotations).select("row_index", labels.alias("_labels")), "row_index", "left")
    merged = F.when(F.col("_labels").isNull(), F.col("_base")).otherwise(F.map_concat(own, "_labels"))
    return joined.select("row_index", F.explode(merged).alias("field", "_shown")).select("row_index", "field", "_shown.value", "_shown.from_label")


# --- text spans ------------------------------------------------------------------------------


def slice_text(text: Column, start: Column, end: Column) -> Column:
    """Characters ``start`` to ``end``; what lies outside the text is left out."""
    start, end = F.greatest(start, F.lit(0)), F.greatest(end, F.lit(0))
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))


def entity_mentions(rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per entity with the text it covers. ``rows`` has ``text`` and ``entities``."""
    spans = rows.select(*keep, "text", F.posexplode("entities").alias("mention_no", "_e"))
    return spans.select(
        *keep,
        "mention_no",
        F.col("_e.start").alias("start"),
        F.col("_e.end").alias("end"),
        F.col("_e.entity").alias("entity"),
        slice_text(F.col("text"), F.col("_e.start"), F.col("_e.end")).alias("mention"),
    )


def text_segments(rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """A text cut into plain and marked pieces, in reading order.

    Spans are taken by start (equal starts in payload order). A plain piece fills a gap after the
    previous span's end; overlapping spans repeat the text they share.
    """
    by_start = F.array_sort(
        F.transform(
            "entities",
            lambda e, i: F.struct(e["start"].alias("start"), i.alias("i"), e["end"].alias("end"), e["entity"].alias("entity")),
        )
    )

    def piece(kind: str, start: Column, end: Column, entity: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), start.cast("int").alias("start"), end.cast("int").alias("end"), entity.alias("entity")
        )

    nothing = F.lit(None).cast("string")

    def pieces(e: Column, i: Column) -> Column:
        cursor = F.when(i == 0, F.lit(0)).otherwise(F.try_element_at("_spans", i)["end"])
        marked = piece("marked", e["start"], e["end"], e["entity"])
        return F.when(e["start"] > cursor, F.array(piece("plain", cursor, e["start"], nothing), marked)).otherwise(F.array(marked))

    length = F.length("text")
    last = F.coalesce(F.try_element_at("_spans", F.lit(-1))["end"], F.lit(0))
    tail = F.when(last < length, F.array(piece("plain", last, length, nothing))).otherwise(
        F.array().cast("array<struct<kind:string,start:int,end:int,entity:string>>")
    )
    spans = rows.select(*keep, "text", F.coalesce(by_start, F.array().cast("array<struct<start:int,i:int,end:int,entity:string>>")).alias("_spans"))
    cut = spans.select(
        *keep, "text", F.posexplode(F.concat(F.flatten(F.transform("_spans", pieces)), tail)).alias("segment_no", "_p")
    )
    return cut.select(
        *keep,
        "segment_no",
        F.col("_p.kind").alias("kind"),
        F.col("_p.entity").alias("entity"),
        slice_text(F.col("text"), F.col("_p.start"), F.col("_p.end")).alias("piece"),
    )


# --- boxes and segments ----------------------------------------------------------------------


def boxes_from_corners(corners: Column) -> Column:
    """``[{x0,y0,x1,y1,category}]`` as boxes ``{x,y,w,h,category}``; boxes too small to see go."""
    boxes = F.transform(
        corners,
        lambda c: F.struct(
            F.least(c["x0"], c["x1"]).alias("x"),
            F.least(c["y0"], c["y1"]).alias("y"),
            F.abs(c["x1"] - c["x0"]).alias("w"),
            F.abs(c["y1"] - c["y0"]).alias("h"),
            c["category"].alias("category"),
        ),
    )
    return F.filter(boxes, lambda b: (b["w"] > MIN_BOX_SIDE) & (b["h"] > MIN_BOX_SIDE))


def clamp_boxes(boxes: Column) -> Column:
    """Boxes moved inside the unit square, their size kept."""

    def inside(at: Column, size: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(1 - size, at))

    return F.transform(
        boxes,
        lambda b: F.struct(
            inside(b["x"], b["w"]).alias("x"),
            inside(b["y"], b["h"]).alias("y"),
            b["w"].alias("w"),
            b["h"].alias("h"),
            b["category"].alias("category"),
        ),
    )


def clean_segments(segments: Column, duration: Column) -> Column:
    """Segments with ordered ends inside ``[0, duration]``.

    Points (equal ends as given) stay; ranges shorter than the minimum after clamping go.
    """

    def inside(t: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(duration, t))

    cleaned = F.transform(
        segments,
        lambda s: F.struct(
            inside(F.least(s["start"], s["end"])).alias("start"),
            inside(F.greatest(s["start"], s["end"])).alias("end"),
            s["label"].alias("label"),
            (s["start"] == s["end"]).alias("point"),
        ),
    )
    kept = F.filter(cleaned, lambda s: s["point"] | (s["end"] - s["start"] >= MIN_RANGE_SECONDS))
    return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label")))


# --- waveforms -------------------------------------------------------------------------------


def peak_envelope(samples: DataFrame, clip: str, position: str, sample: str, bars: int = WAVEFORM_BARS) -> DataFrame:
    """``(clip, bar, peak)`` from one row per sample with its 0-based position in the clip.

    A bar is ``floor(samples / bars)`` samples wide and the remainder is left out; a clip with
    fewer samples than bars has all-zero bars. Samples are reduced map-side, so a clip of any
    length sends at most ``bars`` values per task.
    """
    widths = samples.groupBy(clip).agg(F.floor(F.count("*") / F.lit(bars)).cast("bigint").alias("_width"))
    bar = F.floor(F.col(position) / F.nullif("_width", F.lit(0))).cast("int")
    peaks = (
        samples.join(widths, clip)
        .where((F.col("_width") > 0) & (F.col(position) < F.col("_width") * bars))
        .groupBy(clip, bar.alias("bar"))
        .agg(F.max(F.abs(sample)).alias("_peak"))
    )
    frame = widths.select(clip, F.explode(F.sequence(F.lit(0), F.lit(bars - 1))).alias("bar"))
    return frame.join(peaks, [clip, "bar"], "left").select(clip, "bar", F.coalesce("_peak", F.lit(0.0)).alias("peak"))


def peak_envelope_array(samples: Column, bars: int = WAVEFORM_BARS) -> Column:
    """The bars of a clip whose samples are one array."""
    width = F.floor(F.size(samples) / F.lit(bars)).cast("int")
    return F.transform(
        F.sequence(F.lit(0), F.lit(bars - 1)),
        lambda i: F.when(
            width > 0,
            F.array_max(F.transform(F.slice(samples, i * width + 1, width), lambda v: F.abs(v).cast("double"))),
        ).otherwise(F.lit(0.0)),
    )
