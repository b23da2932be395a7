"""Waveforms at any zoom: block maxima of a clip's samples, in levels of ever larger blocks.

One pass over the samples builds level 0, in rows of 256 samples; each further level holds the maxima of 256 blocks of the one
below. A bar is then a few whole blocks and the ends of a few others, two rows of each level at most, whatever its width.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annolytics.operators.payloads import WAVEFORM_BARS

FAN_OUT = 256


def write_pyramid(samples: DataFrame, clip: str, position: str, sample: str, path: str) -> None:
    """Store the pyramid of clips, one row per sample with its 0-based position in the clip, below ``path``.

    A row is ``(clip, block, peaks)``; the levels are folders, sorted by clip and block, so that a few rows of a clip are found by
    the ranges of files. A clip of any length is many blocks, of 256 values each. Every level but the first is made of the stored one below.
    """
    spark = samples.sparkSession
    keyed = samples.select(F.col(clip).alias("clip"), F.col(position).cast("bigint").alias("_at"), F.abs(F.col(sample).cast("double")).alias("_peak"))
    block = F.floor(F.col("_at") / F.lit(FAN_OUT)).cast("bigint").alias("block")
    item = F.struct((F.col("_at") % FAN_OUT).alias("place"), F.col("_peak").alias("peak"))
    kind = samples.schema[clip].dataType
    rows, level = keyed.groupBy("clip", block).agg(F.array_sort(F.collect_list(item)).alias("items")), 0
    while True:
        made = rows.select("clip", "block", F.transform("items", lambda i: i["peak"]).alias("peaks"))
        _write_level(made, path, level)
        stored = read_level(spark, path, level, kind)
        if level == 0:
            lengths = stored.groupBy("clip").agg(F.sum(F.size("peaks")).cast("bigint").alias("samples"))
            lengths.write.mode("overwrite").parquet(f"{path}/lengths")
        if stored.agg(F.max("block")).first()[0] in (None, 0):
            break
        level += 1
        item = F.struct((F.col("block") % FAN_OUT).alias("place"), F.array_max("peaks").alias("peak"))
        above = F.floor(F.col("block") / F.lit(FAN_OUT)).cast("bigint").alias("block")
        rows = stored.groupBy("clip", above).agg(F.array_sort(F.collect_list(item)).alias("items"))
    spark.createDataFrame([(level + 1,)], "levels int").coalesce(1).write.mode("overwrite").json(f"{path}/made")


def _write_level(rows: DataFrame, path: str, level: int) -> None:
    rows.repartitionByRange("clip", "block").sortWithinPartitions("clip", "block").write.mode("overwrite").parquet(f"{path}/level={level}")


def read_level(spark: SparkSession, path: str, level: int, clip_type: T.DataType) -> DataFrame:
    fields = [T.StructField("clip", clip_type), T.StructField("block", T.LongType()), T.StructField("peaks", T.ArrayType(T.DoubleType()))]
    return spark.read.schema(T.StructType(fields)).parquet(f"{path}/level={level}")


def _pieces(start: Column, end: Column, levels: int) -> Column:
    """``{level, block, from, to}`` of the runs of values that samples ``start`` to ``end`` are made of."""
    fan, runs = F.lit(FAN_OUT).cast("bigint"), []
    piece = lambda level, block, first, last: F.struct(F.lit(level).alias("level"), block.alias("block"), first.alias("first"), last.alias("last"))
    whole = lambda x: F.floor(x / fan).cast("bigint")
    for level in range(levels):
        some, last_block = start < end, whole(end - 1)
        one = some & (whole(start) == last_block)
        head, tail = some & ~one & (start % fan != 0), some & ~one & (end % fan != 0)
        runs += [
            F.when(one, piece(level, whole(start), start % fan, end - last_block * fan)),
            F.when(head, piece(level, whole(start), start % fan, fan)),
            F.when(tail, piece(level, whole(end), F.lit(0).cast("bigint"), end % fan)),
        ]
        # What is left are whole blocks, which are values of the next level; nothing where one block held all.
        following = F.ceil(start / fan).cast("bigint")
        start, end = following, F.when(one, following).otherwise(whole(end))
    return F.filter(F.array(*runs), lambda r: r.isNotNull())


def pyramid_pieces(spark: SparkSession, path: str, clip: str, clip_type: T.DataType, bars: int, ranges: DataFrame | None) -> tuple[DataFrame, DataFrame, int]:
    """The frame of bars, with their pieces, and the number of levels."""
    levels = spark.read.schema("levels int").json(f"{path}/made").first()["levels"]
    lengths = spark.read.schema(T.StructType([T.StructField("clip", clip_type), T.StructField("samples", T.LongType())])).parquet(f"{path}/lengths")
    if ranges is None:
        spans = lengths.select("clip", F.lit(0).cast("bigint").alias("_from"), F.col("samples").alias("_to"))
    else:
        asked = ranges.select(F.col(clip).alias("clip"), F.col("start").cast("bigint").alias("_from"), F.col("end").cast("bigint").alias("_to"))
        spans = asked.join(lengths, "clip").select("clip", F.greatest("_from", F.lit(0)).alias("_from"), F.least("_to", "samples").alias("_to"))
    width = F.floor(F.greatest(F.col("_to") - F.col("_from"), F.lit(0)) / F.lit(bars)).cast("bigint")
    frame = spans.withColumn("_width", width).select("*", F.explode(F.sequence(F.lit(0), F.lit(bars - 1))).alias("bar"))
    start = F.col("_from") + F.col("bar") * F.col("_width")
    pieces = frame.select("clip", "_from", "_to", "bar", F.explode(_pieces(start, start + F.col("_width"), levels)).alias("p"))
    return frame, pieces.select("clip", "_from", "_to", "bar", "p.*"), levels


def pyramid_envelope(
    spark: SparkSession, path: str, clip: str, clip_type: T.DataType, bars: int = WAVEFORM_BARS, ranges: DataFrame | None = None
) -> DataFrame:
    """``(clip, start, end, bar, peak)`` of all clips, or of ``ranges (clip, start, end)`` of samples, cut to the clip.

    As payloads.peak_envelope: a bar is ``floor(samples / bars)`` wide, the remainder is left out, and bars of no width are zero. Ranges may overlap or
    repeat; a repeated one is answered once, and one of a clip that is not there gets no bars.
    """
    if ranges is not None:
        ranges = ranges.distinct()
    frame, pieces, levels = pyramid_pieces(spark, path, clip, clip_type, bars, ranges)
    found = None
    for level in range(levels):
        rows = read_level(spark, path, level, clip_type)
        at_level = pieces.where(F.col("level") == level).join(rows, ["clip", "block"])
        part = at_level.select(
            "clip", "_from", "_to", "bar", F.array_max(F.slice("peaks", (F.col("first") + 1).cast("int"), (F.col("last") - F.col("first")).cast("int"))).alias("peak")
        )
        found = part if found is None else found.unionByName(part)
    key = ["clip", "_from", "_to", "bar"]
    peaks = found.groupBy(*key).agg(F.max("peak").alias("peak"))
    return frame.select(*key).distinct().join(peaks, key, "left").select(
        F.col("clip").alias(clip), F.col("_from").alias("start"), F.col("_to").alias("end"), "bar", F.coalesce("peak", F.lit(0.0)).alias("peak")
    )
