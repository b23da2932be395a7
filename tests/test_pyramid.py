import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annolytics.operators import pyramid as pm
from annolytics.operators.payloads import peak_envelope

CLIPS = {"long": 3000, "exact": 64, "short": 5, "one": 1, "edge": 65, "third": 4096}


@pytest.fixture(scope="module")
def clips(spark):
    rng = random.Random(8)
    values = {clip: [rng.uniform(-5, 5) for _ in range(n)] for clip, n in CLIPS.items()}
    values["long"][100:200] = [None] * 100
    rows = [(clip, i, v) for clip, vs in values.items() for i, v in enumerate(vs)]
    rng.shuffle(rows)
    return values, spark.createDataFrame(rows, "clip string, at bigint, v double").repartition(5).cache()


def by_hand(values, bars, start=0, end=None):
    end = len(values) if end is None else min(end, len(values))
    start = max(start, 0)
    width = max(end - start, 0) // bars
    part = lambda i: [abs(v) for v in values[start + i * width : start + (i + 1) * width] if v is not None]
    return [max(part(i), default=0.0) for i in range(bars)]


@pytest.fixture(scope="module", params=[256, 16])
def stored(spark, clips, tmp_path_factory, request):
    path = str(tmp_path_factory.mktemp("pyramid"))
    before, pm.FAN_OUT = pm.FAN_OUT, request.param
    pm.write_pyramid(clips[1], "clip", "at", "v", path)
    yield path
    pm.FAN_OUT = before


@pytest.mark.parametrize("bars", [1, 7, 300])
def test_bars_equal_those_of_the_samples(spark, clips, stored, bars):
    values, samples = clips
    got = {(r.clip, r.bar): r.peak for r in pm.pyramid_envelope(spark, stored, "clip", T.StringType(), bars).collect()}
    assert got == {(clip, i): peak for clip, vs in values.items() for i, peak in enumerate(by_hand(vs, bars))}
    flat = {(r.clip, r.bar): r.peak for r in peak_envelope(samples, "clip", "at", "v", bars).collect()}
    assert got == flat


def test_ranges(spark, clips, stored):
    values, _ = clips
    ranges = [("long", 17, 2950), ("long", 17, 2950), ("long", 255, 257), ("long", -5, 99_999), ("third", 1, 4095), ("short", 2, 4), ("short", 4, 2), ("exact", 0, 64), ("nobody", 0, 9)]
    asked = spark.createDataFrame(ranges, "clip string, start bigint, end bigint")
    got = {}
    for r in pm.pyramid_envelope(spark, stored, "clip", T.StringType(), 13, asked).collect():
        got.setdefault((r.clip, r.start, r.end), {})[r.bar] = r.peak
    want = {(c, max(s, 0), min(e, len(values[c]))): dict(enumerate(by_hand(values[c], 13, s, e))) for c, s, e in ranges if c in values}
    assert got == want


def test_a_bar_is_few_pieces(spark, stored):
    _, pieces, levels = pm.pyramid_pieces(spark, stored, "clip", T.StringType(), 10, None)
    most = pieces.groupBy("clip", "_from", "bar").count().agg(F.max("count")).first()[0]
    assert most <= 2 * levels


def test_no_samples(spark, tmp_path):
    empty = spark.createDataFrame([], "clip string, at bigint, v double")
    pm.write_pyramid(empty, "clip", "at", "v", str(tmp_path))
    assert pm.pyramid_envelope(spark, str(tmp_path), "clip", T.StringType(), 10).count() == 0
