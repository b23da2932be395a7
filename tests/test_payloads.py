import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annolytics.functions import text as tx
from annolytics.operators import payloads as pl
from annolytics.operators import projections as pj

SENTENCE = "In May the Norvik ferry left Tarn for Ostby."
SPANS = [(3, 6, "DATE"), (11, 23, "SHIP"), (29, 33, "PORT"), (38, 99, "PORT")]
ENTITIES = "row_index bigint, text string, entities array<struct<start:int,end:int,entity:string>>"


def segments_by_hand(text, spans):
    pieces, at = [], 0
    for start, end, entity in sorted(spans, key=lambda s: s[0]):
        if start > at:
            pieces.append(("plain", None, text[at:start]))
        pieces.append(("marked", entity, text[start:end]))
        at = end
    if at < len(text):
        pieces.append(("plain", None, text[at:]))
    return pieces


@pytest.mark.parametrize(
    ("text", "spans"),
    [
        (SENTENCE, SPANS),
        (SENTENCE, list(reversed(SPANS))),
        (SENTENCE, []),
        (SENTENCE, [(0, 45, "ALL")]),
        (SENTENCE, [(5, 20, "A"), (10, 15, "B"), (12, 30, "C")]),
        (SENTENCE, [(3, 7, "A"), (3, 5, "B")]),
        ("héé “q” ∑", [(1, 3, "X")]),
        ("", []),
    ],
)
def test_text_segments(spark, text, spans):
    df = spark.createDataFrame([(0, text, spans)], ENTITIES)
    got = pl.text_segments(df, ["row_index"]).orderBy("segment_no").collect()
    assert [(r["kind"], r["entity"], r["piece"]) for r in got] == segments_by_hand(text, spans)


def test_entity_mentions(spark):
    got = pl.entity_mentions(spark.createDataFrame([(0, SENTENCE, SPANS)], ENTITIES), ["row_index"]).orderBy("mention_no").collect()
    assert [r["mention"] for r in got] == [SENTENCE[s:e] for s, e, _ in SPANS]


def test_payload_typed(spark):
    schema = pl.label_schema({"sentiment": "SelectField", "rating": "RatingField", "tags": "CheckboxGroup", "entities": "NERField"})
    good = {"sentiment": "positive", "rating": 4, "tags": ["a", "b"], "entities": [{"start": 0, "end": 9, "entity": "ORG"}]}
    df = spark.createDataFrame([(0, json.dumps(good)), (1, "{oops"), (2, "{}")], "row_index bigint, data string")
    rows = {r["row_index"]: r for r in pl.payload_typed(df, schema).collect()}
    assert rows[0]["tags"] == ["a", "b"]
    assert rows[0]["entities"][0]["entity"] == "ORG"
    assert [rows[i]["bad_payload"] for i in range(3)] == [False, True, False]
    assert rows[2]["rating"] is None


def test_boxes(spark):
    corner = "array<struct<x0:double,y0:double,x1:double,y1:double,category:string>>"
    rows = [([(0.5, 0.2, 0.1, 0.6, "a"), (0.1, 0.1, 0.104, 0.9, "thin"), (0.1, 0.1, 0.9, 0.105, "flat")],)]
    boxes = spark.createDataFrame(rows, f"c {corner}").select(pl.boxes_from_corners(F.col("c")).alias("b"))
    assert [tuple(round(v, 9) if isinstance(v, float) else v for v in b) for b in boxes.first()["b"]] == [(0.1, 0.2, 0.4, 0.4, "a")]
    moved = [([(-0.5, 0.9, 0.25, 0.5, "a"), (0.3, 0.3, 0.1, 0.1, "b")],)]
    clamped = spark.createDataFrame(moved, "b array<struct<x:double,y:double,w:double,h:double,category:string>>")
    assert [tuple(b) for b in clamped.select(pl.clamp_boxes(F.col("b")).alias("b")).first()["b"]] == [
        (0.0, 0.5, 0.25, 0.5, "a"), (0.3, 0.3, 0.1, 0.1, "b"),
    ]


def test_segments(spark):
    raw = [([(5.0, 2.0, "swapped"), (3.0, 3.0, "point"), (1.0, 1.04, "short"), (29.0, 99.0, "over"), (-1.0, 0.5, "under"), (31.0, 40.0, "outside")],)]
    df = spark.createDataFrame(raw, "s array<struct<start:double,end:double,label:string>>")
    got = df.select(pl.clean_segments(F.col("s"), F.lit(30.0)).alias("s")).first()["s"]
    assert [tuple(s) for s in got] == [(2.0, 5.0, "swapped"), (3.0, 3.0, "point"), (29.0, 30.0, "over"), (0.0, 0.5, "under")]


@pytest.mark.parametrize("count", [0, 3, 4, 10, 17])
def test_peaks(spark, count):
    values = [((-1) ** i) * (i * 7 % 13) / 2 for i in range(count)]
    width = count // 4
    expected = [max((abs(v) for v in values[i * width : (i + 1) * width]), default=0.0) for i in range(4)]
    array = spark.createDataFrame([(values,)], "v array<double>").select(pl.peak_envelope_array(F.col("v"), 4).alias("p")).first()["p"]
    assert array == expected
    long = spark.createDataFrame([("c", i, v) for i, v in enumerate(values)], "clip string, at bigint, v double")
    got = {r["bar"]: r["peak"] for r in pl.peak_envelope(long, "clip", "at", "v", 4).collect()}
    assert got == (dict(enumerate(expected)) if count else {})


def test_times(spark):
    cases = [(0.0, 0.0, "0:00", "@ 0:00"), (59.9, 61.0, "0:59", "0:59 – 1:01"), (3605.2, 3605.2, "60:05", "@ 60:05")]
    df = spark.createDataFrame([c[:2] for c in cases], "a double, b double")
    got = df.select(tx.format_time(F.col("a")), tx.format_segment(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [c[2:] for c in cases]


def test_template_fields(spark):
    source = '<div>{data.text}</div><SelectField labels={["a"]} name="one" /><NERField name="two"/><AudioSegmentField name="three" /><TextField name="one" />'
    df = spark.createDataFrame([(source,), (None,)], "s string")
    assert [r[0] for r in df.select(tx.template_fields(F.col("s"))).collect()] == [["one", "two", "one"], []]
    assert [r[0] for r in df.select(tx.template_fields(F.col("s"), True)).collect()] == [["one", "two", "three", "one"], []]


def test_pick_text(spark):
    def pick(row, schema):
        df = spark.createDataFrame([row], schema)
        return df.select(tx.pick_text(df.schema)).first()[0]

    assert pick(("  ", "fine", "x" * 30), "text string, body string, other string") == "fine"
    assert pick((1, "short", "y" * 21), "id int, a string, b string") == "y" * 21
    assert pick((7, "short"), "id int, a string") == "7"


def test_sentiment(spark):
    texts = ["A GREAT, great film", "awful but best, awful", "good bad", "", "goodness badly", "don't hate"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(tx.lexicon_sentiment(F.col("t"))).collect()] == ["positive", "neutral", "neutral", "neutral", "neutral", "negative"]


def test_row_output(spark):
    schema = "row_index bigint, s string, d date, m decimal(5,2), n struct<t:timestamp_ntz,l:array<date>>, b binary, e int, f int"
    df = spark.sql(
        """SELECT 1L AS row_index, 'x' AS s, date'2024-01-02' AS d, 1.50BD AS m, named_struct('t', timestamp_ntz'2024-01-02 03:04:05',
           'l', array(date'2024-01-03')) AS n, cast('raw' AS binary) AS b, cast(null AS int) AS e, 6 AS f"""
    )
    assert T.StructType.fromDDL(schema).names == df.columns
    refs = pj.with_binary_refs(df, F.lit("ds"))
    assert refs.first()["b"] == "/api/v1/datasets/ds/rows/1/columns/b"
    row = json.loads(refs.select(pj.row_json(refs, df.columns[1:])).first()[0])
    assert row == {"s": "x", "d": "2024-01-02", "m": "1.50", "n": {"t": "2024-01-02 03:04:05", "l": ["2024-01-03"]},
                   "b": "/api/v1/datasets/ds/rows/1/columns/b", "e": None, "f": 6}
    shown = refs.select(*pj.row_preview(refs, df.columns[1:], (5, 10))).first()
    assert [(p["name"], p["text"]) for p in shown["preview"]][3] == ("n", '{"t":"2024…')
    assert shown["more_fields"] == 2


def test_labels_and_tags(spark):
    df = spark.createDataFrame([(True, True, ["a"]), (False, True, ["a", "b"]), (False, False, []), (None, None, None)], "m boolean, y boolean, a array<string>")
    got = [r[0] for r in df.select(pj.status_label(F.col("m"), F.col("y"), F.col("a"))).collect()]
    assert got == ["Annotated by me", "a, b", "Unannotated", "Unannotated"]
    tags = spark.createDataFrame([("x, y ,z",), ("",)], "t string").select(pj.tag_list(F.col("t"))).collect()
    assert [r[0] for r in tags] == [["x", "y", "z"], []]
