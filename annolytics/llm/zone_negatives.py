"""Hard negatives, searched exactly in blocks of a Hilbert order whose bounds tell which of them a window must read."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Over
from pyspark.sql import functions as F

from annolytics.llm.prefix import partitions_for
from annolytics.session import scratch_path, settle

#: Scores are within 2^62. No score, which is below every window's low end, and the ends of a window that takes all.
NONE = -(1 << 62)
NO_LOW, NO_HIGH = NONE + 1, -NONE - 1
EMPTY = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


class ZoneSettings(NamedTuple):
    """A block holds at most ``block`` vectors, and a shelf, which one task loads, about ``shelf``.

    Blocks follow a Hilbert curve through the ``curve_dims`` components of the greatest variance, each cut into
    ``2 ** curve_bits`` cells; at most 62 bits together. Bounds are tested for up to ``zones`` blocks in one group.
    """

    positives: int = 5
    negatives: int = 5
    low_percent: int = 80
    high_percent: int = 100
    block: int = 512
    shelf: int = 65_536
    curve_dims: int = 12
    curve_bits: int = 5
    zones: int = 4096


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on a Hilbert curve of cells ``(n, dims)`` with ``bits`` bits a component, by Skilling's transform (AIP 2004)."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        for i in range(dims):
            is_set = (x[i] & q) != 0
            x[0] ^= np.where(is_set, q - 1, 0)
            swap = np.where(is_set, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= swap
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = top
    while q > 1:
        turn ^= np.where((x[dims - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def _matrices(vectors: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and matrix of the vectors of each length."""
    offsets = vectors.offsets.to_numpy()
    values, lengths = vectors.values.to_numpy(), np.diff(vectors.offsets.to_numpy())
    for dims in np.unique(lengths):
        at = np.flatnonzero(lengths == dims)
        yield at, values[offsets[at][:, None] + np.arange(dims)]


class Spread(NamedTuple):
    """Components the curve goes through, with the least and greatest value of each, and the greatest absolute value and length of all."""

    dims: list[int]
    low: list[float]
    high: list[float]
    largest: int
    length: int


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["at", "n", "total", "squares", "low", "high"]
    for batch in batches:
        for _, rows in _matrices(batch.column("vector")):
            if rows.shape[1]:
                real = rows.astype(np.float64)
                columns = [np.arange(rows.shape[1]), np.full(rows.shape[1], len(rows)), real.sum(0), (real * real).sum(0), rows.min(0), rows.max(0)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def measured_spread(rows: DataFrame, n_dims: int) -> Spread:
    """Of all vectors; only a row per component reaches the driver."""
    moments = rows.select("vector").mapInArrow(_moments, "at bigint, n bigint, total double, squares double, low bigint, high bigint")
    sums = moments.groupBy("at").agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares")], F.min("low").alias("low"), F.max("high").alias("high"))
    found = sums.withColumn("variance", F.col("squares") / F.col("n") - F.pow(F.col("total") / F.col("n"), 2)).collect()
    chosen = sorted(found, key=lambda r: (-r["variance"], r["at"]))[:n_dims]
    largest = max((max(abs(r["low"]), abs(r["high"])) for r in found), default=0)
    return Spread([r["at"] for r in chosen], [r["low"] for r in chosen], [r["high"] for r in chosen], largest, len(found))


def score_type(spread: Spread) -> type:
    """Numbers that hold every sum of products exactly: doubles, whose products are fast, or else longs."""
    bound = spread.largest * spread.largest * max(1, spread.length)
    if bound >= 1 << 62:
        raise ValueError("inner products of these vectors do not fit a long")
    return np.float64 if bound < 1 << 52 else np.int64


def _with_keys(spread: Spread, bits: int):
    low = np.array(spread.low, np.float64)
    width = np.maximum(np.array(spread.high, np.float64) - low, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.zeros(batch.num_rows, np.int64)
            for at, rows in _matrices(batch.column("vector")):
                held = np.zeros((len(at), len(spread.dims)))
                for i, dim in enumerate(spread.dims):
                    if dim < rows.shape[1]:
                        held[:, i] = (rows[:, dim] - low[i]) / width[i]
                if spread.dims:
                    keys[at] = hilbert_keys(np.clip(held * (1 << bits), 0, (1 << bits) - 1), bits)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys)], [*batch.schema.names, "curve"])

    return run


def _with_blocks(size: int):
    """Number the blocks of a sorted partition, which is a shelf. A block is of one label and length and of ``size`` vectors at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelf = TaskContext.get().partitionId()
        block, held, last = -1, 0, None
        for batch in batches:
            kinds = zip(batch.column("label").to_pylist(), np.diff(batch.column("vector").offsets.to_numpy()).tolist())
            numbers = np.empty(batch.num_rows, np.int32)
            for i, kind in enumerate(kinds):
                if kind != last or held == size:
                    block, held, last = block + 1, 0, kind
                held += 1
                numbers[i] = block
            columns = [pa.array(np.full(batch.num_rows, shelf, np.int32)), pa.array(numbers)]
            yield pa.RecordBatch.from_arrays([*columns, *(batch.column(c) for c in ("id", "label", "vector"))], ["shelf", "block", "id", "label", "vector"])

    return run


def _zones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least and greatest value of every component in each block's part of a batch."""
    for batch in batches:
        shelf, block, label = (batch.column(c).to_numpy() for c in ("shelf", "block", "label"))
        out = []
        for at, rows in _matrices(batch.column("vector")):
            place = shelf[at].astype(np.int64) << 32 | block[at]
            for key in np.unique(place):
                here = place == key
                first = at[np.flatnonzero(here)[0]]
                out.append((shelf[first], block[first], label[first], int(here.sum()), rows[here].min(0), rows[here].max(0)))
        if out:
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types)], ["shelf", "block", "label", "n", "low", "high"])


class Blocks(NamedTuple):
    """The stored candidates ``(shelf, block, id, label, vector)``, one folder a shelf, and a row per block with its bounds."""

    rows: DataFrame
    zones: DataFrame
    n_shelves: int
    n_blocks: int


def hilbert_blocks(rows: DataFrame, total: int, spread: Spread, settings: ZoneSettings) -> Blocks:
    """Store ``rows (id, label, vector)`` in the order of label and curve, cut into shelves and blocks, with zone maps.

    The order goes on to the id, so that one label, or any number of equal vectors, is spread over as many shelves as it needs.
    """
    spark = rows.sparkSession
    shelves = max(partitions_for(spark), -(-total // settings.shelf))
    kind = "id bigint, label bigint, vector array<bigint>"
    keyed = rows.mapInArrow(_with_keys(spread, settings.curve_bits), f"{kind}, curve bigint")
    order = ["label", F.size("vector"), "curve", "id"]
    dealt = keyed.repartitionByRange(shelves, *order).sortWithinPartitions(*order)
    path = scratch_path(spark, "zone-blocks")
    schema = f"shelf int, block int, {kind}"
    dealt.mapInArrow(_with_blocks(settings.block), schema).write.partitionBy("shelf").parquet(path)
    stored = spark.read.schema(schema).parquet(path).select("shelf", "block", "id", "label", "vector")
    parts = stored.select("shelf", "block", "label", "vector").mapInArrow(
        _zones, "shelf int, block int, label bigint, n bigint, low array<bigint>, high array<bigint>"
    )
    # A block that two batches share has two parts; they are combined component by component.
    merged = lambda name, pick: F.aggregate(F.slice(name, 2, F.size(name)), F.col(name)[0], lambda a, b: F.zip_with(a, b, lambda x, y: pick(x, y)))
    zones = parts.groupBy("shelf", "block", "label").agg(F.sum("n").alias("n"), F.collect_list("low").alias("low"), F.collect_list("high").alias("high"))
    zones = settle(zones.select("shelf", "block", "label", "n", merged("low", F.least).alias("low"), merged("high", F.greatest).alias("high")), "zone-maps")
    return Blocks(stored, zones, shelves, zones.count())


def score_bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each anchor with any vector within each pair of bounds."""
    above, below = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return (above @ low.T + below @ high.T).astype(np.int64), (above @ high.T + below @ low.T).astype(np.int64)


def blocks_to_read(least: np.ndarray, most: np.ndarray, counts: np.ndarray, lows: np.ndarray, highs: np.ndarray, wanted: int) -> np.ndarray:
    """Which blocks may hold one of the ``wanted`` highest scores within one of an anchor's windows.

    ``least`` and ``most`` bound the scores ``(anchors, blocks)``; windows are ``(anchors, windows)``, unused ones with a low end above the high one. A block
    need not be read if it lies outside of every window, or if others hold enough vectors within the window that are all above it.
    """
    need = np.zeros(least.shape, bool)
    for w in range(lows.shape[1]):
        low, high = lows[:, w : w + 1], highs[:, w : w + 1]
        # Blocks that lie in the window whole, the highest first, until they hold enough.
        whole = np.where((least >= low) & (most <= high) & (least <= most), least, NONE)
        order = np.argsort(-whole, axis=1, kind="stable")
        ranked = np.take_along_axis(whole, order, axis=1)
        held = np.cumsum(np.where(ranked == NONE, 0, counts[order]), axis=1)
        enough = held >= wanted
        first = np.where(enough.any(axis=1), ranked[np.arange(len(ranked)), enough.argmax(axis=1)], NONE)[:, None]
        need |= (most >= np.maximum(low, first)) & (least <= high) & (low <= high)
    return need


_REQUEST = "anchor bigint, id bigint, label bigint, vector array<bigint>, lows array<bigint>, highs array<bigint>"
_ASKED = f"shelf int, {_REQUEST}, blocks array<int>"


def _windows(batch: pa.RecordBatch, name: str, at: np.ndarray) -> np.ndarray:
    return np.array(batch.column(name).take(pa.array(at)).to_pylist(), dtype=np.int64)


def _chosen(same_label: bool, wanted: int, kind: type):
    """For every anchor, the shelves and their blocks it must read; the zones of its group come before the anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, zones = None, []
        for batch in batches:
            groups, is_zone = batch.column("group").to_numpy(), batch.column("is_anchor").to_numpy() == 0
            for g in np.unique(groups):
                if g != group:
                    group, zones = g, []
                here = groups == g
                if (here & is_zone).any():
                    part = batch.take(pa.array(np.flatnonzero(here & is_zone)))
                    held = [part.column(c).to_numpy() for c in ("shelf", "block", "label", "n")]
                    for at, low in _matrices(part.column("vector")):
                        high = np.array(part.column("highs").take(pa.array(at)).to_pylist(), np.int64).reshape(low.shape)
                        zones.append((*(h[at] for h in held), low.astype(kind), high.astype(kind)))
                asked = np.flatnonzero(here & ~is_zone)
                for start in range(0, len(asked), 512):
                    yield from _requests(batch.take(pa.array(asked[start : start + 512])), zones, same_label, wanted, kind)

    return run


def _requests(anchors: pa.RecordBatch, zones: list, same_label: bool, wanted: int, kind: type) -> Iterator[pa.RecordBatch]:
    labels = anchors.column("label").to_numpy()
    for at, vectors in _matrices(anchors.column("vector")):
        fitting = [z for z in zones if z[4].shape[1] == vectors.shape[1]]
        if not fitting:
            continue
        shelf, block, label, n, low, high = (np.concatenate(c) for c in zip(*fitting))
        least, most = score_bounds(vectors.astype(kind), low, high)
        lows, highs = (_windows(anchors, c, at) for c in ("lows", "highs"))
        fits = (labels[at][:, None] == label) == same_label
        # Blocks of no use are never read, and with bounds the wrong way round do not count as enough.
        need = fits & blocks_to_read(np.where(fits, least, -NONE), np.where(fits, most, NONE), n, lows, highs, wanted)
        row, column = np.nonzero(need)
        order = np.lexsort((block[column], shelf[column], row))
        row, column = row[order], column[order]
        if not len(row):
            continue
        starts = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(shelf[column]) != 0)])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(row)], pa.int32()), pa.array(block[column], pa.int32()))
        source = pa.array(at[row[starts]])
        kept = [anchors.column(c).take(source) for c in ("anchor", "id", "label", "vector", "lows", "highs")]
        yield pa.RecordBatch.from_arrays(
            [pa.array(shelf[column[starts]], pa.int32()), *kept, lists], ["shelf", "anchor", "id", "label", "vector", "lows", "highs", "blocks"]
        )


class _Shelf:
    """The blocks of a shelf that were asked for, and the search in them."""

    def __init__(self, kind: type):
        self.kind, self.parts, self.blocks = kind, {}, {}

    def add(self, batch: pa.RecordBatch) -> None:
        numbers, ids, labels = (batch.column(c).to_numpy() for c in ("block", "id", "label"))
        for at, rows in _matrices(batch.column("vector")):
            for number in np.unique(numbers[at]):
                here = at[numbers[at] == number]
                self.parts.setdefault(int(number), []).append((ids[here], rows[numbers[at] == number], int(labels[here[0]])))

    def block(self, number: int):
        """Ids ascending, vectors, bounds and label of a block."""
        if number not in self.blocks:
            parts = self.parts.pop(number)
            ids, rows = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            order = np.argsort(ids, kind="stable")
            rows = rows[order].astype(self.kind)
            self.blocks[number] = ids[order], rows, rows.min(0)[None], rows.max(0)[None], parts[0][2]
        return self.blocks[number]

    def search(self, asked: pa.RecordBatch, same_label: bool, k: int) -> Iterator[pa.RecordBatch]:
        """The ``k`` highest scores of each anchor in each of its windows, smaller ids first among equal ones."""
        ids = asked.column("id").to_numpy()
        lists = asked.column("blocks").to_pylist()
        for at, vectors in _matrices(asked.column("vector")):
            vectors = vectors.astype(self.kind)
            lows, highs = (_windows(asked, c, at) for c in ("lows", "highs"))
            n, n_windows = lows.shape
            best = np.full((n, n_windows, k), NONE)
            names = np.zeros((n, n_windows, k), np.int64)
            wanted: dict[int, list[int]] = {}
            for i, row in enumerate(at):
                for number in lists[row]:
                    wanted.setdefault(number, []).append(i)
            bounds = {b: score_bounds(vectors[rows], *self.block(b)[2:4]) for b, rows in wanted.items()}
            # The most promising blocks first, so that the later ones may be passed over.
            for number in sorted(wanted, key=lambda b: -int(bounds[b][1].max())):
                block_ids, block_rows, *_ = self.block(number)
                rows, (least, most) = np.array(wanted[number]), bounds[number]
                floor = np.maximum(lows[rows], best[rows, :, -1])
                open_rows = ((most >= floor) & (least <= highs[rows]) & (lows[rows] <= highs[rows])).any(axis=1)
                rows = rows[open_rows]
                if not len(rows):
                    continue
                scores = (vectors[rows] @ block_rows.T).astype(np.int64)
                if same_label:
                    self._hide_own(scores, ids[at[rows]], vectors[rows], block_ids, block_rows)
                for w in range(n_windows):
                    fits = np.where((scores >= lows[rows, w : w + 1]) & (scores <= highs[rows, w : w + 1]), scores, NONE)
                    found, places = _top(fits, k)
                    merged = np.concatenate([best[rows, w], found], axis=1)
                    merged_names = np.concatenate([names[rows, w], block_ids[places]], axis=1)
                    order = np.lexsort((merged_names, -merged), axis=1)[:, :k]
                    best[rows, w] = np.take_along_axis(merged, order, axis=1)
                    names[rows, w] = np.take_along_axis(merged_names, order, axis=1)
            row, window, place = np.nonzero(best != NONE)
            anchors = asked.column("anchor").to_numpy()[at[row]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchors), pa.array(window, pa.int32()), pa.array(names[row, window, place]), pa.array(best[row, window, place])],
                ["anchor", "window", "id", "score"],
            )

    @staticmethod
    def _hide_own(scores: np.ndarray, ids: np.ndarray, vectors: np.ndarray, block_ids: np.ndarray, block_rows: np.ndarray) -> None:
        """Rows are different, so of those with the anchor's id (and label) only one has its vector."""
        for i in range(len(ids)):
            for j in range(*np.searchsorted(block_ids, [ids[i], ids[i] + 1])):
                if np.array_equal(vectors[i], block_rows[j]):
                    scores[i, j] = NONE


def _top(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` highest of each row (``NONE`` where there are fewer), the first column first among equal ones, and their columns."""
    n = scores.shape[1]
    if n > k:
        # Those above the k-th highest all stay, of those equal to it the first ones.
        edge = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        above, equal = scores > edge, scores == edge
        room = k - above.sum(axis=1, keepdims=True)
        stays = above | (equal & (np.cumsum(equal, axis=1) <= room))
        places = np.nonzero(stays)[1].reshape(-1, k)
    else:
        places = np.broadcast_to(np.minimum(np.arange(k), max(n - 1, 0)), (len(scores), k))
    found = np.take_along_axis(scores, places, axis=1)
    if n < k:
        found = np.where(np.arange(k) < n, found, NONE)
    return found, places


def _searched(same_label: bool, k: int, kind: type):
    """Search shelf by shelf; the vectors of a shelf come before the anchors that read it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shelf = None, None
        for batch in batches:
            shelves, is_row = batch.column("shelf").to_numpy(), batch.column("is_anchor").to_numpy() == 0
            for s in np.unique(shelves):
                if s != number:
                    number, shelf = s, _Shelf(kind)
                here = shelves == s
                if (here & is_row).any():
                    shelf.add(batch.take(pa.array(np.flatnonzero(here & is_row))))
                asked = np.flatnonzero(here & ~is_row)
                for start in range(0, len(asked), 512):
                    yield from shelf.search(batch.take(pa.array(asked[start : start + 512])), same_label, k)

    return run


def search_blocks(blocks: Blocks, anchors: DataFrame, same_label: bool, k: int, kind: type, settings: ZoneSettings) -> DataFrame:
    """``(anchor, window, id, score, rank)``: the ``k`` highest scores within each window of each anchor.

    ``anchors`` holds ``_REQUEST``; candidates are of the anchor's label or of the others, and of its length. First every anchor meets the zone maps, in groups of
    them, which name the blocks it must read; blocks nobody asks for are not read on. Then shelves and the anchors that read them meet. Either side is streamed past the other.
    """
    spark = anchors.sparkSession
    groups = max(-(-blocks.n_blocks // settings.zones), min(blocks.n_shelves, partitions_for(spark)))
    none = lambda kind: F.lit(None).cast(kind)
    zones = blocks.zones.select(
        F.pmod(F.xxhash64("shelf"), F.lit(groups)).alias("group"), F.lit(0).alias("is_anchor"), "shelf", "block", "n",
        none("bigint").alias("anchor"), none("bigint").alias("id"), "label", F.col("low").alias("vector"), none("array<bigint>").alias("lows"), F.col("high").alias("highs"),
    )
    copies = anchors.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))).alias("group"))
    copies = copies.select(
        "group", F.lit(1).alias("is_anchor"), none("int").alias("shelf"), none("int").alias("block"), none("bigint").alias("n"),
        "anchor", "id", "label", "vector", "lows", "highs",
    )
    met = zones.unionByName(copies).repartition("group").sortWithinPartitions("group", "is_anchor")
    # A vector of the anchor's own may be among those that count as enough.
    asked = settle(met.mapInArrow(_chosen(same_label, k + 1, kind), _ASKED), "zone-requests")
    read = asked.select("shelf", F.explode("blocks").alias("block")).distinct()
    rows = blocks.rows.join(read, ["shelf", "block"], "left_semi").select(
        "shelf", F.lit(0).alias("is_anchor"), "block", none("bigint").alias("anchor"), "id", "label", "vector",
        none("array<bigint>").alias("lows"), none("array<bigint>").alias("highs"), none("array<int>").alias("blocks"),
    )
    readers = asked.select("shelf", F.lit(1).alias("is_anchor"), none("int").alias("block"), "anchor", "id", "label", "vector", "lows", "highs", "blocks")
    met = rows.unionByName(readers).repartition("shelf").sortWithinPartitions("shelf", "is_anchor")
    found = met.mapInArrow(_searched(same_label, k, kind), "anchor bigint, window int, id bigint, score bigint")
    best = Over.partitionBy("anchor", "window").orderBy(F.col("score").desc(), "id")
    return settle(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "zone-found")


def mine_negatives(rows: DataFrame, is_anchor: Column, settings: ZoneSettings = ZoneSettings()) -> DataFrame:
    """Hard negatives of every anchor and each of its positives: ``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``rows`` holds ``(id bigint, label bigint, vector array<bigint>)`` without nulls; ``is_anchor`` is a condition on them. Scores are inner products, higher ones first,
    smaller ids first among equal ones. Positives are the first ``positives`` other rows of the anchor's label; the negatives of a positive are the first ``negatives`` rows of
    other labels whose score is between ``low_percent`` and ``high_percent`` of the positive's. A positive with a negative score, or nothing in its window, has none.
    Rows that repeat in all three columns count once; rows that share only an id are rows of their own. Vectors meet only those of their length.
    An empty table gives an empty one; products beyond a long are an error. The result is exact, whatever the bounds let pass.
    """
    spark = rows.sparkSession
    rows = settle(rows.select("id", "label", "vector").distinct(), "zone-rows")
    total = rows.count()
    if total == 0:
        return spark.createDataFrame([], EMPTY)
    spread = measured_spread(rows, settings.curve_dims)
    kind = score_type(spread)
    blocks = hilbert_blocks(rows, total, spread, settings)
    anchors = rows.where(is_anchor).select(F.xxhash64("id", "label", "vector").alias("anchor"), "id", "label", "vector")
    everything = [F.array(F.lit(x).cast("bigint")).alias(c) for x, c in ((NO_LOW, "lows"), (NO_HIGH, "highs"))]
    positives = search_blocks(blocks, anchors.select("*", *everything), True, settings.positives, kind, settings).drop("window")
    # Percents of whole numbers, hundreds and the rest apart, so that nothing overflows.
    hundreds, rest = "((score - pmod(score, 100)) div 100)", "pmod(score, 100)"
    ends = {
        "lows": F.expr(f"{settings.low_percent} * {hundreds} + ({settings.low_percent} * {rest} + 99) div 100"),
        "highs": F.expr(f"{settings.high_percent} * {hundreds} + {settings.high_percent} * {rest} div 100"),
    }
    windows = positives.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", *[e.alias(c) for c, e in ends.items()]))).alias("w"))
    # Unused windows end before they begin.
    padded = lambda name, rest: F.expr(f"transform(sequence(0, {settings.positives - 1}), i -> coalesce(get(w, i).{name}, {rest}L))").alias(name)
    windows = windows.select("anchor", padded("lows", 1), padded("highs", 0))
    negatives = search_blocks(blocks, anchors.join(windows, "anchor"), False, settings.negatives, kind, settings)
    pairs = positives.select("anchor", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = anchors.select("anchor", F.col("id").alias("anchor_id"))
    return (
        negatives.withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
        .join(pairs, ["anchor", "window"])
        .join(named, "anchor")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
