"""Token counts of documents in flat token files that have no index, by a scan for separators."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annolytics.llm.prefix import partitions_for
from annolytics.llm.token_ids import PieceIds, ended_ids
from annolytics.llm.warc import open_store
from annolytics.llm.words import chunks
from annolytics.session import settle

#: Ids in a file: little-endian unsigned 16-bit.
ID = np.dtype("<u2")


def _write_tokens(folder: str, tokenizer_path: str, end_id: int, file_bytes: int):
    """Write the texts of a partition; a row for each document and, with ordinal -1, for each file.

    Files are named anew for every attempt, so what a repeated task leaves behind is listed nowhere.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        pieces = PieceIds(tokenizer_path, special_as_text=True)
        context = TaskContext.get()
        out, path, size, ordinal = None, "", 0, 0

        def ended(rest: pa.StructArray) -> pa.RecordBatch:
            nothing = pa.nulls(1, rest.type)
            return pa.RecordBatch.from_arrays([nothing, pa.array([path]), pa.array([-1], pa.int64()), pa.array([size], pa.int64())], names)

        names = ["_rest", "path", "ordinal", "bytes"]
        for batch in batches:
            rest = batch.column("_rest")
            for chunk in chunks(batch.column("_text")):
                ids, counts = ended_ids(chunk, pieces, end_id)
                if out is None:
                    name = f"part-{context.partitionId() if context else 0:05d}-{uuid.uuid4().hex}.tokens"
                    path, size, ordinal = os.path.join(folder, name), 0, 0
                    out = store.open_output_stream(os.path.join(root, name), compression=None)
                if len(ids) and ids.max() > np.iinfo(ID).max:
                    raise ValueError(f"id {ids.max()} does not fit the files' 16 bits")
                size += out.write(ids.astype(ID).tobytes())
                n = len(counts)
                yield pa.RecordBatch.from_arrays(
                    [rest.slice(chunk.first, n), pa.array([path] * n), pa.array(np.arange(ordinal, ordinal + n)), pa.nulls(n, pa.int64())], names
                )
                ordinal += n
                if size >= file_bytes:
                    out.close()
                    out = None
                    yield ended(rest)
        if out is not None:
            out.close()
            yield ended(rest)

    return run


def write_token_files(
    docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, text_col: str = "text", file_bytes: int = 1 << 30
) -> tuple[DataFrame, DataFrame]:
    """Write the ids of all texts, ``end_id`` after each; give the files ``(path, bytes)`` and the documents.

    Documents are listed as ``(_rest, path, ordinal)``: their other columns and which document of which file
    each is. The files hold ids alone. Ids must be below 65,536. A null text is an empty one. The strings of special tokens in
    a text are ordinary text, so ``end_id`` stands nowhere but at ends.
    """
    if end_id >= 1 << 16:
        raise ValueError("ids are stored in 16 bits")
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    base = docs.select(F.struct(*(rest or [F.lit(1).alias("_")])).alias("_rest"), F.col(f"`{text_col}`").alias("_text"))
    schema = T.StructType(
        [T.StructField("_rest", base.schema["_rest"].dataType), T.StructField("path", T.StringType()), T.StructField("ordinal", T.LongType()), T.StructField("bytes", T.LongType())]
    )
    store, root = open_store(folder)
    store.create_dir(root, recursive=True)
    written = settle(base.mapInArrow(_write_tokens(folder, tokenizer_path, end_id, file_bytes), schema), "token-files")
    return written.where("ordinal < 0").select("path", "bytes"), written.where("ordinal >= 0").select("_rest", "path", "ordinal")


def _scan_blocks(end_id: int):
    """The separators of each block, as places in the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, start, end in zip(*(batch.column(c).to_pylist() for c in ("path", "bytes", "start", "end"))):
                store, place = open_store(path)
                with store.open_input_file(place) as file:
                    ids = np.frombuffer(file.read_at((end - start) * ID.itemsize, start * ID.itemsize), dtype=ID)
                places = np.flatnonzero(ids == end_id) + start
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path]), pa.array([size]), pa.array([start]), pa.array([places.tolist()], pa.list_(pa.int64()))],
                    ["path", "bytes", "start", "places"],
                )

    return run


def count_tokens(spark: SparkSession, files: DataFrame, end_id: int, block_tokens: int = 4 << 20) -> DataFrame:
    """``(path, ordinal, first, tokens, ended)`` of every document in the files ``(path, bytes)``.

    Each block of a file is searched for itself. What lies before it, how many separators and where the
    last of them is, comes from a scan over the few numbers that each block gives. A document
    may span any number of blocks. ``tokens`` leaves the separator out. Ids after the last separator
    are a document that is not ``ended``. An empty file has no documents; two separators in a row enclose an empty one.
    """
    total = F.col("bytes").cast("bigint") / F.lit(ID.itemsize)
    blocks = files.where("bytes > 0").withColumn("total", total.cast("bigint"))
    blocks = blocks.select("path", "bytes", "total", F.explode(F.expr(f"sequence(0L, total - 1, {block_tokens}L)")).alias("start"))
    blocks = blocks.select("path", "bytes", "start", F.least(F.col("start") + block_tokens, "total").alias("end"))
    found = blocks.repartition(partitions_for(spark)).mapInArrow(_scan_blocks(end_id), "path string, bytes bigint, start bigint, places array<bigint>")
    found = settle(found, "token-blocks")
    small = found.select(
        "path", "bytes", "start", F.size("places").cast("bigint").alias("n"), F.expr("try_element_at(places, -1)").alias("last")
    )
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("path")
    carried = small.select(
        "path",
        "start",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"),
        F.coalesce(F.max("last").over(before), F.lit(-1)).alias("carry"),
        F.sum("n").over(whole).alias("all"),
        F.coalesce(F.max("last").over(whole), F.lit(-1)).alias("end"),
        F.max("start").over(whole).alias("last_start"),
        (F.col("bytes") / ID.itemsize).cast("bigint").alias("total"),
    )
    carried = settle(carried, "token-carried")
    stitched = found.join(carried, ["path", "start"]).select(
        "path", F.posexplode(F.expr("transform(places, (p, i) -> struct(p, if(i = 0, carry, places[i - 1]) AS previous))")).alias("i", "s"), "earlier"
    )
    documents = stitched.select(
        "path",
        (F.col("earlier") + F.col("i")).alias("ordinal"),
        (F.col("s.previous") + 1).alias("first"),
        (F.col("s.p") - F.col("s.previous") - 1).alias("tokens"),
        F.lit(True).alias("ended"),
    )
    tail = carried.where("start = last_start AND total > end + 1").select(
        "path", F.col("all").alias("ordinal"), (F.col("end") + 1).alias("first"), (F.col("total") - F.col("end") - 1).alias("tokens"), F.lit(False).alias("ended")
    )
    return documents.union(tail)
