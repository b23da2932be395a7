"""Near-duplicate documents by min-max hashing.

Under each of a set of random permutations of the shingle hashes the smallest and the largest
value of a document are both kept. Either agrees between two documents with a probability that
equals their Jaccard similarity, so half as many permutations have to be evaluated as for a
signature of minima alone, and the two values of one permutation, being negatively correlated,
give an estimate of lower variance. Bands of minima and bands of maxima propose candidate pairs,
and full shingle sets decide.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annolytics.llm.components import connected_components
from annolytics.llm.words import byte_codes, chunks, combined, shingle_hashes, word_hashes, words_of
from annolytics.session import settle


DESCRIPTION = {"_key": T.BinaryType(), "_size": T.LongType(), "_signature": T.BinaryType(), "_bands": T.ArrayType(T.LongType())}


class NearDupSettings(NamedTuple):
    """``numerator / denominator`` is the least Jaccard similarity of a link.

    ``miss`` bounds the chance that a pair of just that similarity shares no band; pairs above
    it are missed far less often. Blocks hold about ``block`` texts and ``block_shingles`` shingles.
    """

    shingle: int = 5
    numerator: int = 80
    denominator: int = 100
    rows: int = 4
    miss: float = 1e-6
    seed: int = 7
    block: int = 256
    block_shingles: int = 1 << 17

    @property
    def bands(self) -> int:
        """An even number of bands, half of minima and half of maxima."""
        hit = (self.numerator / self.denominator) ** self.rows
        return 2 * math.ceil(math.log(self.miss) / math.log(1 - hit) / 2) if hit < 1 else 2

    @property
    def permutations(self) -> int:
        return self.rows * self.bands // 2


def min_max_signatures(hashes: np.ndarray, counts: np.ndarray, permutations: int, seed: int) -> np.ndarray:
    """Minima, then maxima, of each non-empty run of ``hashes`` under each permutation (32 bits each)."""
    rng = np.random.default_rng(seed)
    factors = rng.integers(0, 1 << 64, size=permutations, dtype=np.uint64) | np.uint64(1)
    shifts = rng.integers(0, 1 << 64, size=permutations, dtype=np.uint64)
    filled = counts > 0
    at = (np.cumsum(counts) - counts)[filled]
    out = np.zeros((2 * permutations, len(at)), dtype=np.uint32)
    for i in range(permutations if len(at) else 0):
        permuted = hashes * factors[i]
        permuted += shifts[i]
        out[i] = np.minimum.reduceat(permuted, at) >> np.uint64(32)
        out[permutations + i] = np.maximum.reduceat(permuted, at) >> np.uint64(32)
    return out.T


def _text_key(text: bytes | None) -> bytes:
    return hashlib.md5(b" ".join((text or b"").lower().split())).digest()


def _describe(settings: NearDupSettings):
    """Per text: the key of its word sequence, the size of its shingle set, its signature and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = byte_codes(fold_case=True)
        rows, bands = settings.rows, settings.bands
        for batch in batches:
            texts = batch.column("_text")
            for chunk in chunks(texts):
                words = words_of(chunk)
                hashes, counts = shingle_hashes(word_hashes(chunk, words, codes), words.first, settings.shingle)
                signature = min_max_signatures(hashes, counts, settings.permutations, settings.seed)
                n = len(chunk.bounds) - 1
                size = np.zeros(n, dtype=np.int64)
                ends = np.cumsum(counts)
                for i in np.flatnonzero(counts):
                    size[i] = len(np.unique(hashes[ends[i] - counts[i] : ends[i]]))
                keys = np.zeros((n, bands), dtype=np.int64)
                filled = np.flatnonzero(counts)
                for b in range(bands):
                    parts = [signature[:, b * rows + r].astype(np.uint64) for r in range(rows)]
                    keys[filled, b] = combined([np.full(len(filled), b, dtype=np.uint64), *parts]).view(np.int64)
                lengths = np.where(counts > 0, bands, 0)
                raw = chunk.data.tobytes()
                per_text = np.where(counts > 0, signature.shape[1] * 4, 0)
                part = batch.slice(chunk.first, n)
                columns = [
                    *part.columns,
                    pa.array([_text_key(raw[s:e]) for s, e in zip(chunk.bounds[:-1], chunk.bounds[1:])], pa.binary()),
                    pa.array(size),
                    pa.BinaryArray.from_buffers(
                        pa.binary(),
                        n,
                        [None, pa.py_buffer(_offsets(per_text)), pa.py_buffer(np.ascontiguousarray(signature).tobytes())],
                    ),
                    pa.ListArray.from_arrays(pa.array(_offsets(lengths)), pa.array(keys[filled].ravel())),
                ]
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, "_key", "_size", "_signature", "_bands"])

    return run


def _offsets(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)


def _shingle_set(text: bytes | None, codes: np.ndarray, k: int) -> np.ndarray:
    (chunk,) = chunks(pa.array([text or b""], pa.binary()))
    words = words_of(chunk)
    return np.unique(shingle_hashes(word_hashes(chunk, words, codes), words.first, k)[0])


def _confirm(settings: NearDupSettings):
    """Keep the pairs whose full shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = byte_codes(fold_case=True)
        # Pairs arrive sorted by ``a``: a text with many partners is cut into shingles once.
        held: tuple[int | None, np.ndarray] = (None, np.zeros(0, np.uint64))
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            ok = np.zeros(len(a), dtype=bool)
            for i in range(len(a)):
                if held[0] != a[i]:
                    held = (a[i], _shingle_set(batch.column("text_a")[i].as_py(), codes, settings.shingle))
                other = _shingle_set(batch.column("text_b")[i].as_py(), codes, settings.shingle)
                both = len(np.intersect1d(held[1], other, assume_unique=True))
                ok[i] = settings.denominator * both >= settings.numerator * (len(held[1]) + len(other) - both) > 0
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], ["a", "b"])

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, settings: NearDupSettings) -> DataFrame:
    """The pairs ``(a, b)`` that are similar enough, by the texts ``(node, text)``.

    ``b`` is looked up first: the smaller node, of which a large group has one, stays out of
    the shuffle and is attached where its partners already are.
    """
    full = (
        pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        .join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        .select("a", "b", F.col("text_a").cast("binary").alias("text_a"), F.col("text_b").cast("binary").alias("text_b"))
    )
    return full.mapInArrow(_confirm(settings), "a bigint, b bigint")


def _forest(labels: np.ndarray, x: int, others: np.ndarray) -> np.ndarray:
    """Of ``others``, one of each label but that of ``x``; their labels become that of ``x``."""
    found = others[np.unique(labels[others], return_index=True)[1]]
    found = found[labels[found] != labels[x]]
    labels[np.isin(labels, labels[found])] = labels[x]
    return found


def _edges(node: np.ndarray, edges: list[tuple[int, np.ndarray]]) -> pd.DataFrame:
    a = np.concatenate([np.full(len(ys), node[x]) for x, ys in edges] or [np.zeros(0, np.int64)])
    b = np.concatenate([node[ys] for _, ys in edges] or [np.zeros(0, np.int64)])
    return pd.DataFrame({"a": a, "b": b}, dtype="int64")


def _by_signature(settings: NearDupSettings):
    """Nodes of a bucket block whose signatures come near the threshold, linked up as a forest.

    Signatures have some dozens of values; five standard deviations below the threshold lose
    fewer true links than the bands do.
    """
    t = settings.numerator / settings.denominator
    width = 2 * settings.permutations
    least = math.floor((t - 5 * math.sqrt(t * (1 - t) / width)) * width)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        signature = np.frombuffer(b"".join(rows["_signature"]), dtype=np.uint32).reshape(len(rows), -1)
        size, labels = rows["_size"].to_numpy(), rows["component"].to_numpy().copy()
        edges = []
        for x in range(len(rows) - 1):
            rest = slice(x + 1, len(rows))
            small, large = np.minimum(size[x], size[rest]), np.maximum(size[x], size[rest])
            ok = (labels[rest] != labels[x]) & (settings.denominator * small >= settings.numerator * large)
            at = np.flatnonzero(ok) + x + 1
            at = at[(signature[at] == signature[x]).sum(axis=1) >= least]
            edges.append((x, _forest(labels, x, at)))
        return _edges(rows["node"].to_numpy(), edges)

    return run


def _by_shingles(settings: NearDupSettings):
    """Links on full shingle sets between the components in a block of a cluster, as a forest.

    The sets are numbered once; marking those of one text and summing the marks over every
    other text gives all its intersections in one pass.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        codes = byte_codes(fold_case=True)
        sets = [_shingle_set(text, codes, settings.shingle) for text in rows["text"]]
        size = np.array([len(s) for s in sets])
        values, numbers = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.cumsum(size) - size
        labels = rows["component"].to_numpy().copy()
        mark = np.zeros(len(values), dtype=np.int32)
        largest = pd.Series(labels).mode().iloc[0]
        edges = []
        # Of two texts in different components one is outside the largest of the block.
        for x in np.flatnonzero(labels != largest):
            own = numbers[starts[x] : starts[x] + size[x]]
            mark[own] = 1
            both = np.add.reduceat(mark[numbers], starts)
            mark[own] = 0
            ok = (labels != labels[x]) & (settings.denominator * both >= settings.numerator * (size + size[x] - both))
            edges.append((x, _forest(labels, x, np.flatnonzero(ok))))
        return _edges(rows["node"].to_numpy(), edges)

    return run


def _block_pairs(rows: DataFrame, key: str, block: int, weight: str | None = None, block_weight: int = 1) -> DataFrame:
    """Rows of open groups in blocks ``(kind, i, j)`` in which every two rows of different components meet.

    ``rows`` holds ``key``, ``node`` and ``component``. All rows of a group's largest component, its core, are linked already, so only the others
    have to meet anyone: each other (kind 0, every pair of their blocks) and the core (kind 1, their blocks by those of the core). A group of n rows of
    which m are outside the core is thus n m / block copies of rows. Blocks hold ``block`` rows, or ``block_weight`` of ``weight``, on average.
    """
    sum_of = F.sum(weight) if weight else F.lit(0).cast("bigint")
    parts = rows.groupBy(key, "component").agg(F.count("*").alias("n"), sum_of.alias("w"))
    core = parts.groupBy(key).agg(
        F.max(F.struct("n", (-F.col("component")).alias("last"))).alias("most"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.max_by("w", F.struct("n", -F.col("component"))).alias("core_w")
    )
    blocks = lambda n, w: F.greatest(F.lit(1), F.ceil(F.greatest(n / block, w / block_weight))).cast("bigint")
    sizes = core.select(
        key,
        (-F.col("most.last")).alias("core"),
        blocks(F.col("n") - F.col("most.n"), F.col("w") - F.col("core_w")).alias("others"),
        blocks(F.col("most.n"), F.col("core_w")).alias("cores"),
    )
    known = rows.join(settle(sizes, "block-sizes"), key).withColumn("is_core", F.col("component") == F.col("core"))
    known = known.withColumn("part", F.pmod(F.xxhash64("node"), F.when(F.col("is_core"), F.col("cores")).otherwise(F.col("others"))))
    up_to = lambda n: F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)
    place = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    part = F.col("part")
    among = F.transform(up_to("others"), lambda o: place(0, F.least(part, o), F.greatest(part, o)))
    against = F.transform(up_to("cores"), lambda c: place(1, part, c))
    of_core = F.transform(up_to("others"), lambda o: place(1, o, part))
    places = F.when(F.col("is_core"), of_core).otherwise(F.concat(among, against))
    return known.withColumn("_place", F.explode(places)).select(*rows.columns, "_place.kind", "_place.i", "_place.j")


def _links_across(members: DataFrame, links: DataFrame, classes: DataFrame, texts: DataFrame, settings: NearDupSettings) -> DataFrame:
    """The links that the star round left out: between components that share a bucket.

    Buckets whose members already are one component need nothing more. In the others signatures
    tell which texts come near the threshold; those are gathered into clusters, and within a
    cluster full sets are compared across components. Both steps cut a large group into blocks
    and let those outside its largest component meet all, so a group of any size is spread over tasks of bounded
    size, and both hand on a forest of at most one edge per row, never the pairs themselves.
    """
    block = settings.block
    components = settle(connected_components(links), "components")
    placed = settle(
        members.join(components, "node", "left").select("band", "node", F.coalesce("component", "node").alias("component")), "placed"
    )
    mixed = (
        placed.groupBy("band")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"))
        .where("low < high and n > 2")
        .select("band")
    )
    mixed = settle(mixed, "mixed")
    if mixed.isEmpty():
        return links.where(F.lit(False))
    rows = placed.join(mixed, "band").join(classes.select("node", "_signature", "_size"), "node")
    near = _block_pairs(rows, "band", block).groupBy("band", "kind", "i", "j")
    near = settle(near.applyInPandas(_by_signature(settings), "a bigint, b bigint"), "near")
    clusters = connected_components(near.union(links)).withColumnRenamed("component", "cluster")
    grouped = settle(
        clusters.join(components, "node", "left")
        .join(classes.select("node", "_size"), "node")
        .select("cluster", "node", F.coalesce("component", "node").alias("component"), "_size"),
        "clusters",
    )
    open_clusters = (
        grouped.groupBy("cluster").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("cluster")
    )
    open_clusters = settle(open_clusters, "open")
    if open_clusters.isEmpty():
        return links.where(F.lit(False))
    rows = grouped.join(open_clusters, "cluster")
    dealt = _block_pairs(rows, "cluster", block, "_size", settings.block_shingles).drop("_size")
    # Texts come last, to the blocks that want them.
    return dealt.join(texts, "node").groupBy("cluster", "kind", "i", "j").applyInPandas(_by_shingles(settings), "a bigint, b bigint")


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: NearDupSettings = NearDupSettings()) -> DataFrame:
    """The rows of ``docs`` that are first in their group of near-duplicates, with all their columns as they were."""
    return _grouped(docs, id_col, text_col, settings).where("is_first").select(*[_column(c, text_col) for c in docs.columns])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: NearDupSettings = NearDupSettings()) -> DataFrame:
    """Every row of ``docs`` with its shingle set's size and its group of near-duplicates.

    Gives the columns of ``docs`` and ``n_shingles``, ``component_id`` (the smallest id that can
    be reached over links, the row's own included) and ``is_first``, true for exactly one row of
    each group. Words are compared with A-Z folded to a-z.

    Equal word sequences are one node. Each bucket of a band links its members to its smallest
    one; links are confirmed on full shingle sets; buckets that still span several components
    are then searched for links across these, block by block. Exact copies are never paired, a
    hot bucket is never collected, and what the driver holds does not grow.

    Defined cases: a null text counts as empty; a text without words links with nothing, not
    even another such, and is first in a group of its own. Rows with equal ids are separate rows, of which those with
    equal words are copies. A null id counts as the largest in its group; ``component_id`` is
    null if all ids of a group are. Other columns pass through, whatever their names, but for those
    named as one that is added, which are replaced.
    """
    added = ("n_shingles", "component_id", "is_first")
    kept = [_column(c, text_col) for c in docs.columns if c not in added]
    return _grouped(docs, id_col, text_col, settings).select(
        *kept, F.col("_size").alias("n_shingles"), F.col("component").alias("component_id"), "is_first"
    )


def _grouped(docs: DataFrame, id_col: str, text_col: str, settings: NearDupSettings) -> DataFrame:
    """The described rows with ``component`` and ``is_first``."""
    names = docs.columns
    base = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        F.col(f"`{id_col}`").cast("bigint").alias("_id"),
        F.col(f"`{text_col}`").cast("binary").alias("_text"),
        F.struct(*([F.col(f"`{c}`") for c in names if c != text_col] or [F.lit(1).alias("_")])).alias("_rest"),
    )
    schema = T.StructType([*base.schema.fields, *(T.StructField(name, kind) for name, kind in DESCRIPTION.items())])
    described = settle(base.mapInArrow(_describe(settings), schema), "described")
    by_key = described.select("_row", "_id", "_key", "_size").where("_size > 0")
    # The first row of each word sequence stands for it; nulls sort last.
    order = F.struct(F.col("_id").isNull(), F.col("_id"), F.col("_row"))
    firsts = settle(by_key.groupBy("_key").agg(F.min(order).alias("o")).select("_key", F.col("o._row").alias("node")), "firsts")
    nodes = described.join(firsts.select(F.col("node").alias("_row")), "_row", "left_semi")
    classes = settle(nodes.select(F.col("_row").alias("node"), "_size", "_signature", "_bands"), "classes")
    members = settle(_bucket_members(classes), "members")
    centers = settle(members.groupBy("band").agg(F.min("node").alias("a")), "centers")
    sizes = classes.select("node", "_size")
    star = members.join(centers, "band").where("a < node").select("a", F.col("node").alias("b")).distinct()
    star = settle(_near_sizes(star, sizes, settings), "star")
    texts = described.select(F.col("_row").alias("node"), F.col("_text").alias("text"))
    links = settle(confirmed(star, texts, settings), "links")
    links = links.union(settle(_links_across(members, links, classes, texts, settings), "links-across"))
    components = connected_components(links)
    grouped = settle(
        by_key.join(firsts, "_key").join(components, "node", "left").select("_row", "_id", F.coalesce("component", "node").alias("group")),
        "grouped",
    )
    heads = grouped.groupBy("group").agg(F.min(F.struct(F.col("_id").isNull(), F.col("_id"), F.col("_row"))).alias("head"))
    heads = settle(heads.select("group", F.col("head._id").alias("component"), F.col("head._row").alias("first")), "heads")
    result = grouped.join(heads, "group").select("_row", "component", (F.col("_row") == F.col("first")).alias("is_first"))
    full = described.join(result, "_row", "left")
    return full.select(
        "_text",
        "_rest",
        "_size",
        F.when(F.col("is_first").isNull(), F.col("_id")).otherwise(F.col("component")).alias("component"),
        F.coalesce("is_first", F.lit(True)).alias("is_first"),
    )


def _column(name: str, text_col: str) -> Column:
    return F.col("_text").cast("string").alias(name) if name == text_col else F.col("_rest")[name].alias(name)


def _bucket_members(classes: DataFrame) -> DataFrame:
    """``(band, node)`` of the buckets with at least two nodes."""
    rows = classes.select("node", F.explode("_bands").alias("band"))
    shared = rows.groupBy("band").count().where("count > 1").select("band")
    return rows.join(shared, "band", "left_semi")


def _near_sizes(pairs: DataFrame, sizes: DataFrame, settings: NearDupSettings) -> DataFrame:
    """Drop pairs whose sets differ in size by more than the similarity allows."""
    both = pairs.join(sizes.withColumnsRenamed({"node": "a", "_size": "size_a"}), "a").join(
        sizes.withColumnsRenamed({"node": "b", "_size": "size_b"}), "b"
    )
    small, large = F.least("size_a", "size_b"), F.greatest("size_a", "size_b")
    return both.where(settings.denominator * small >= settings.numerator * large).select("a", "b")
