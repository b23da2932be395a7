import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from annolytics.llm.vector_queries import quantised
from annolytics.llm.zone_negatives import NO_HIGH, NO_LOW, NONE, ZoneSettings, blocks_to_read, hilbert_keys, mine_negatives, score_bounds

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain_negatives(rows, every=100):
    """All pairs of different rows."""
    usable = {(i, v is not None and tuple(v), label) for i, v, label in rows if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v)}
    poisoned = lambda i, label: (label + 1) % 10 if i % 7 == 0 else label
    whole = sorted({(i, poisoned(i, label), tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v, label in usable})
    out = []
    for anchor in whole:
        if anchor[0] % every:
            continue
        scored = [(-sum(a * b for a, b in zip(anchor[2], o[2])), o[0], o[1] == anchor[1]) for o in whole if o != anchor and len(o[2]) == len(anchor[2])]
        for score, pos, _ in sorted(s for s in scored if s[2])[:5]:
            fitting = sorted(s for s in scored if not s[2] and 80 * -score <= 100 * -s[0] <= 100 * -score)[:5]
            out += [(anchor[0], pos, rank, neg, -score, -n) for rank, (n, neg, _) in enumerate(fitting, 1)]
    return sorted(out)


def mined(spark, rows, settings=ZoneSettings(), every=100):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    return sorted(map(tuple, mine_negatives(quantised(df), F.col("id") % every == 0, settings).collect()))


def clustered(n, rng, dims=16, clusters=12):
    centres = rng.normal(size=(clusters, dims))
    vectors = centres[rng.integers(clusters, size=n)] + 0.15 * rng.normal(size=(n, dims))
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


SMALL = ZoneSettings(block=13, shelf=60, curve_dims=4, curve_bits=3, zones=5)


@pytest.mark.parametrize("settings", [ZoneSettings(), SMALL, ZoneSettings(block=1, shelf=40, curve_dims=1, curve_bits=1, zones=1)])
def test_against_all_pairs(spark, settings):
    rng = np.random.default_rng(1)
    # One label holds a third of the rows, and many vectors are equal.
    vectors = clustered(900, rng)
    vectors[200:400] = vectors[200]
    rows = [(i, [float(x) for x in v], int(rng.choice([0, 0, 1, 2, 3, 9]))) for i, v in enumerate(vectors)]
    want = plain_negatives(rows, 30)
    assert mined(spark, rows, settings, 30) == want and len(want) > 300


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (0, [0.5, 1.0], 1), (0, [0.5, 1.0], 2), (1, [1.0, 0.4], 1), (2, [0.9, 0.4], 3), (3, None, 1), (4, [1.0, None], 1), (5, [nan, 1.0], 1)]
    rows += [(6, [inf, 1.0], 2), (None, [1.0, 1.0], 1), (8, [1.0, 1.0], None), (9, [], 1), (100, [], 1), (11, [], 2), (12, [1.0], 1), (200, [1.0], 1), (13, [0.9], 4), (300, [-1.0, -1.0], 1)]
    rows += [(7, [1.0, 0.5], 0), (14, [1.0, 0.45], 9), (15, [0.0, 0.0], 5), (400, [0.0, 0.0], 5), (16, [0.0, 0.0], 6), (16, [0.0, 0.0], 6)]
    for settings in (ZoneSettings(), SMALL):
        assert mined(spark, rows, settings) == plain_negatives(rows)
    assert mined(spark, []) == []
    only = [(i, [1.0], 1) for i in range(0, 300, 50)]
    assert mined(spark, only) == plain_negatives(only)


def test_large_components(spark):
    """Products beyond what doubles hold exactly go through longs, and beyond those they are an error."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=4) * 2.0**20], i % 3) for i in range(0, 300, 10)]
    assert mined(spark, rows, SMALL) == plain_negatives(rows)
    with pytest.raises(ValueError, match="do not fit"):
        mined(spark, [(0, [1e30], 1), (1, [1e30], 2)])


def test_curve_steps_to_neighbours():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3), axis=-1).reshape(-1, 3)
    keys = hilbert_keys(cells, 3)
    assert sorted(keys) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_and_spare_blocks():
    """No block with a wanted score is left out, and on clustered vectors most others are."""
    rng = np.random.default_rng(7)
    vectors = np.floor(256 * clustered(4000, rng, clusters=30))
    order = np.argsort(hilbert_keys(np.clip((vectors + 256) / 16, 0, 31)[:, np.argsort(-vectors.var(axis=0))[:8]], 5))
    blocks = [vectors[order[i : i + 40]] for i in range(0, 4000, 40)]
    anchors = vectors[::200]
    low, high = np.array([b.min(0) for b in blocks]), np.array([b.max(0) for b in blocks])
    least, most = score_bounds(anchors, low, high)
    scores = np.stack([anchors @ b.T for b in blocks], axis=1).astype(np.int64)
    assert (least <= scores.min(axis=2)).all() and (most >= scores.max(axis=2)).all()
    ends = np.sort(scores.reshape(len(anchors), -1), axis=1)
    windows = [(np.full((len(anchors), 1), NO_LOW), np.full((len(anchors), 1), NO_HIGH)), (ends[:, -50:-49] * 4 // 5, ends[:, -50:-49])]
    for lows, highs in windows:
        need = blocks_to_read(least, most, np.full(len(blocks), 40), lows, highs, 6)
        inside = np.where((scores >= lows[:, :, None]) & (scores <= highs[:, :, None]), scores, NONE)
        edge = np.sort(inside.reshape(len(anchors), -1), axis=1)[:, -6:-5]
        holds = (inside.max(axis=2) >= edge) & (inside.max(axis=2) > NONE)
        assert not (holds & ~need).any()
    assert need.mean() < 0.7
