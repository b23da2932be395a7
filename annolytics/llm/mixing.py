"""Mixing sources to target weights by apportioning equal blocks of words."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annolytics.llm.prefix import running_sums
from annolytics.llm.words import chunks, words_of
from annolytics.session import settle

WORD = r"[^\x20\x09-\x0D]+"


class MixSettings(NamedTuple):
    """``weights`` go to the sources in code-point order, null last, over and over.

    The mix takes ``share_percent`` of all words; no source gives more than ``most`` times its
    own. Words are apportioned in blocks of about ``block`` words and dealt to ``shards`` shards.
    """

    weights: Sequence[int] = (5, 2, 1)
    share_percent: int = 150
    most: int = 2
    block: int = 128
    shards: int = 16
    seed: int = 11


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, settings: MixSettings) -> DataFrame:
    """Add ``rank`` and ``target``, in words, to ``sizes (source, source_size)``.

    Targets share out the words by weight; one that would pass its limit, ``most`` times its
    source's size, stops there and the excess is shared by weight among the others until none is
    above. Taking sources by rising limit per weight, each finds the level that those before it
    leave if all of these are at their limits. It is at its own limit if the level reaches that, and the first that
    is not sets the level of all that follow. The table has a row per source and is sorted in one task.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weights = F.array(*[F.lit(w) for w in settings.weights])
    ranked = sizes.withColumn("rank", (F.row_number().over(by_name) - 1).cast("bigint"))
    ranked = ranked.withColumn("weight", F.element_at(weights, (F.col("rank") % len(settings.weights) + 1).cast("int")))
    ranked = ranked.withColumn("limit", (F.col("source_size") * settings.most).cast("double"))
    rising = Window.orderBy(F.col("limit") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * F.lit(settings.share_percent / 100) - F.coalesce(F.sum("limit").over(rising), F.lit(0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(rising), F.lit(0))
    levels = ranked.withColumn("level", left / open_weight)
    full = F.col("level") * F.col("weight") >= F.col("limit")
    level = F.max(F.when(~full, F.col("level"))).over(everything)
    return levels.withColumn("target", F.when(full, F.col("limit")).otherwise(F.col("weight") * level)).select(
        "source", "source_size", "rank", "target"
    )


def block_quotas(targets: DataFrame, settings: MixSettings) -> DataFrame:
    """Add ``blocks`` (of one pass over the source), ``quota`` and ``bounds`` to ``source_targets``.

    A source of S words has max(1, round(S / block)) blocks of equal size. As many blocks as the
    targets hold together are given out by the method of Sainte-Lague: the next always goes to
    the highest quotient of a source's target (in its blocks) by 2 * blocks so far + 1. All
    blocks that a divisor just too large gives are taken at once; those still missing, at most
    one per source, go to the highest quotients that follow.

    ``bounds`` cuts a source's quota into whole blocks per shard. Blocks are dealt to the shards in turn, each source going on
    where the one before it ended, so that neither a shard's blocks nor its blocks of one
    source differ from the mean by more than one.
    """
    everything = Window.partitionBy()
    sized = targets.withColumn("blocks", F.greatest(F.lit(1), F.round(F.col("source_size") / settings.block)).cast("bigint"))
    share = F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(0.0)
    sized = sized.withColumn("share", share).withColumn("votes", F.sum("share").over(everything))
    sized = sized.withColumn("seats", F.round("votes").cast("bigint")).withColumn("m", F.count("*").over(everything))
    free = F.greatest(F.col("seats") - F.col("m") / 2, F.lit(0.0))
    most = F.col("blocks") * settings.most
    sized = sized.withColumn(
        "base", F.when(F.col("votes") > 0, F.least(most, F.floor(F.col("share") * free / F.col("votes") + 0.5))).otherwise(0).cast("bigint")
    )
    sized = settle(sized.withColumn("missing", F.col("seats") - F.sum("base").over(everything)), "quota-base")
    reach = F.least(most - F.col("base"), F.ceil(F.col("share") * F.col("m") / F.col("votes")) + 2)
    more = sized.where("votes > 0").withColumn("reach", reach.cast("bigint")).where("reach > 0")
    more = more.select("rank", "missing", "share", F.explode(F.expr("sequence(base, base + reach - 1)")).alias("had"))
    quotient = F.col("share") / (2 * F.col("had") + 1)
    more = more.withColumn("turn", F.row_number().over(Window.orderBy(quotient.desc(), "rank", "had"))).where("turn <= missing")
    more = more.groupBy("rank").agg(F.count("*").alias("extra"))
    full = sized.join(more, "rank", "left").withColumn("quota", F.col("base") + F.coalesce("extra", F.lit(0)))
    dealt = F.coalesce(F.sum("quota").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    k = settings.shards
    per_shard = F.expr(f"transform(sequence(0, {k - 1}), i -> (quota + pmod({k - 1} - i + dealt, {k})) div {k})")
    bounds = F.expr(f"transform(sequence(0, {k}), i -> aggregate(slice(per_shard, 1, i), 0L, (a, x) -> a + x))")
    full = full.withColumn("dealt", dealt).withColumn("per_shard", per_shard).withColumn("bounds", bounds)
    return full.select("source", "source_size", "target", "blocks", "quota", "bounds")


SPANS = """
filter(flatten(transform(sequence(0L, {most}L), pass ->
  flatten(transform(array(
      struct(_at AS x, 0L AS start, least(_size, source_size - _at) AS length),
      struct(0L AS x, source_size - _at AS start, _size - (source_size - _at) AS length)), part ->
    transform(sequence(0, {last}), shard -> struct(
      shard AS shard,
      part.start + greatest(0L, _cuts[shard] - pass * source_size - part.x) AS start,
      least(part.length, _cuts[shard + 1] - pass * source_size - part.x)
        - greatest(0L, _cuts[shard] - pass * source_size - part.x) AS length)))))),
  s -> s.length > 0)
"""


def mix_sources(docs: DataFrame, source_col: str, size_col: str, order: Sequence[str], settings: MixSettings = MixSettings()) -> DataFrame:
    """Add ``source_size``, ``target`` and ``spans`` to every row of ``docs``.

    ``spans`` is a list of ``(shard, start, length)`` in words of the row: what the mix takes of
    it, by shard; empty where it takes nothing. A row taken in several passes has spans for each.

    The rows of a source, in an order drawn from the seed, are a ring of words, which starts
    anywhere, also by the seed. The quota of blocks is taken from there onwards, around the ring
    as often as needed, so documents stay whole but where a quota or shard ends, and no word is taken more than
    ``most`` times. Sums over range partitions place every row, however large its source.
    Reruns give the same spans: the order is a hash of the ``order`` columns and the size.

    A null source is a source of its own; a row of no words (or of null size) has no spans; rows
    equal in all columns are interchangeable; an empty table gives an empty table. A column that is named as one
    that is added is replaced. Pass narrow rows: all columns are shuffled.
    """
    size = F.coalesce(F.col(f"`{size_col}`"), F.lit(0)).cast("bigint")
    keys = [F.col(f"`{c}`").alias(f"_key{i}") for i, c in enumerate(order)]
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_rest")
    settled = settle(
        docs.select(rest, F.col(f"`{source_col}`").alias("_source"), size.alias("_size"), *keys, F.monotonically_increasing_id().alias("_row")),
        "mix-rows",
    )
    sizes = settled.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size"))
    quotas = settle(block_quotas(source_targets(settle(sizes, "mix-sizes"), settings), settings), "mix-quotas")
    names = [f"_key{i}" for i in range(len(order))]
    keyed = settled.withColumn("_turn", F.xxhash64(F.lit(settings.seed), *names, "_size"))
    placed = running_sums(keyed, "_source", ["_turn", *names, "_size", "_row"], "_size", "mix-sums")
    wide = placed.join(quotas, F.col("_source").eqNullSafe(F.col("source")))
    begin = F.pmod(F.xxhash64(F.lit(settings.seed), F.coalesce(F.col("source"), F.lit("\0"))), F.greatest("source_size", F.lit(1)))
    wide = wide.withColumn("_at", F.when(F.col("source_size") > 0, F.pmod(F.col("before") - begin, F.col("source_size"))).otherwise(F.lit(0)))
    # Decimals: a source's words times its blocks leave 64 bits from some terabytes on.
    cuts = F.expr("transform(bounds, b -> cast(cast(b AS decimal(19,0)) * cast(source_size AS decimal(19,0)) div blocks AS bigint))")
    spans = F.expr(SPANS.format(most=settings.most, last=settings.shards - 1))
    added = {"source_size": F.col("source_size"), "target": F.col("target"), "spans": spans}
    kept = [F.col("_rest")[c].alias(c) for c in docs.columns if c not in added]
    return wide.withColumn("_cuts", cuts).select(*kept, *[column.alias(name) for name, column in added.items()])


def taken_words() -> Column:
    return F.expr("aggregate(spans, 0L, (a, s) -> a + s.length)")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each run of words taken; a run that has all words of a text gives it unchanged."""
    for batch in batches:
        spans = batch.column("_runs").to_pylist()
        rows, texts = [], []
        for chunk in chunks(batch.column("_text")):
            words = words_of(chunk)
            raw = chunk.data.tobytes()
            for i in range(len(chunk.bounds) - 1):
                at, n = words.first[i], words.first[i + 1] - words.first[i]
                for start, length in spans[chunk.first + i]:
                    whole = length == n
                    lo = chunk.bounds[i] if whole else words.start[at + start]
                    hi = chunk.bounds[i + 1] if whole else words.end[at + start + length - 1]
                    rows.append(chunk.first + i)
                    texts.append(raw[lo:hi].decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays(
            [batch.column("_rest").take(pa.array(rows, pa.int64())), pa.array(texts, pa.string())], ["_rest", "_piece"]
        )


def mixed_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    length_col: str | None = "n_chars",
    settings: MixSettings = MixSettings(shards=1),
) -> DataFrame:
    """The mix as documents: the columns of ``docs``, a row for each run of words that is taken.

    A document taken whole keeps its text; of one at the end of a quota the words taken remain,
    with ``length_col`` recounted. One taken twice gives two rows. Documents without words are no part of a mix.
    """
    names = docs.columns
    kept = settle(
        docs.select(
            F.monotonically_increasing_id().alias("_doc"),
            F.col(f"`{text_col}`").alias("_text"),
            F.struct(*[F.col(f"`{c}`") for c in names if c != text_col]).alias("_rest"),
        ),
        "mix-documents",
    )
    narrow = kept.select(
        "_doc", F.col("_rest")[source_col].alias("source"), F.col("_rest")[id_col].alias("id"), word_count(F.col("_text")).alias("size")
    )
    spans = mix_sources(narrow, "source", "size", ["id"], settings).where("size(spans) > 0")
    runs = F.expr("transform(spans, s -> struct(s.start AS start, s.length AS length))")
    chosen = kept.join(spans.select("_doc", runs.alias("_runs")), "_doc").drop("_doc")
    schema = f"_rest {kept.schema['_rest'].dataType.simpleString()}, _piece string"
    listed = chosen.select("_text", "_rest", F.expr("transform(_runs, r -> array(r.start, r.length))").alias("_runs"))
    pieces = listed.mapInArrow(_pieces, schema)

    def column(name: str) -> Column:
        if name == text_col:
            return F.col("_piece").alias(name)
        if name == length_col:
            return F.length("_piece").cast(docs.schema[name].dataType).alias(name)
        return F.col("_rest")[name].alias(name)

    return pieces.select(*[column(c) for c in names])
