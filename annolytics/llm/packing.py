"""Packing examples into sequences under several limits at once by the dot-product heuristic."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annolytics.llm.token_ids import PieceIds
from annolytics.llm.words import chunks


class PackLimits(NamedTuple):
    """What a sequence may hold: tokens, segments, and tokens that bear loss. All three hold for every sequence.

    ``block`` is the number of pieces that are packed together. A sequence that is less than
    ``least_fill`` full is cut into sequences whose lengths are powers of two, which need no padding.
    """

    tokens: int = 2048
    segments: int = 256
    loss_tokens: int = 2048
    block: int = 4096
    least_fill: float = 0.98

    @property
    def capacity(self) -> np.ndarray:
        return np.array([self.tokens, self.segments, self.loss_tokens], dtype=np.float64)


def dot_product_bins(demands: np.ndarray, capacity: np.ndarray) -> list[np.ndarray]:
    """Bins of item numbers for items of several demands each, none of which may pass ``capacity``.

    One bin is open at a time. It takes, of the items that still fit, the one whose demands, as
    shares of the capacities, have the largest dot product with the bin's free shares, so that what a bin has
    most of is used first; ties go to the earlier item. A bin that no item fits is closed. Every
    item must fit an empty bin.
    """
    share = demands / capacity
    if (share > 1).any():
        raise ValueError("an item is larger than a bin")
    left = np.lexsort((np.arange(len(share)), -share[:, 0]))
    bins = []
    while len(left):
        items, taken = share[left], np.zeros(len(left), dtype=bool)
        free, own = np.ones(share.shape[1]), []
        # Demands sorted by the first: what fits it is a tail of the list, found by bisection.
        first = -items[:, 0]
        while True:
            low = int(np.searchsorted(first, -(free[0] + 1e-12)))
            tail = items[low:]
            fits = ~taken[low:] & (tail <= free + 1e-12).all(axis=1)
            if not fits.any():
                break
            best = low + int(np.argmax(np.where(fits, tail @ free, -1.0)))
            taken[best] = True
            free = free - items[best]
            own.append(left[best])
        bins.append(np.array(own))
        left = left[~taken]
    return bins


def powers_of_two(total: int) -> list[int]:
    """Lengths, each a power of two, that add up to ``total``, largest first."""
    return [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]


class _Piece(NamedTuple):
    """Part of a document: a row of rests, its first id and ids, which of these bear loss (all, if not told), and the document's number of ids."""

    rest: pa.StructArray
    start: int
    ids: np.ndarray
    mask: np.ndarray | None
    doc_tokens: int

    @property
    def loss(self) -> int:
        return len(self.ids) if self.mask is None else int(self.mask.sum())

    def part(self, start: int, end: int) -> _Piece:
        """The ids from ``start`` to ``end``, with the loss that falls on them."""
        mask = None if self.mask is None else self.mask[start:end]
        return self._replace(start=self.start + start, ids=self.ids[start:end], mask=mask)


PIECE = [
    ("start", T.LongType()),
    ("length", T.LongType()),
    ("ids", T.BinaryType()),
    ("doc_tokens", T.LongType()),
    ("sequence_id", T.LongType()),
    ("offset", T.LongType()),
    ("loss_tokens", T.LongType()),
]


class _Packer:
    """Packs the pieces of one partition, a block at a time."""

    def __init__(self, limits: PackLimits, first_id: int):
        self.limits, self.next_id = limits, first_id
        self.waiting: list[_Piece] = []
        self.out: list[tuple[_Piece, int, int]] = []

    def add(self, document: _Piece) -> None:
        """Cut a document into pieces that fit a sequence by tokens and loss; whole sequences are closed, other pieces wait."""
        for piece in self.fitting(document):
            if len(piece.ids) == self.limits.tokens:
                self.close([piece])
            else:
                self.waiting.append(piece)
                if len(self.waiting) >= self.limits.block:
                    self.pack(last=False)

    def fitting(self, document: _Piece) -> Iterator[_Piece]:
        n, limits = len(document.ids), self.limits
        if document.mask is None:
            step = min(limits.tokens, limits.loss_tokens)
            yield from (document.part(start, min(start + step, n)) for start in range(0, n, step))
            return
        loss = np.cumsum(document.mask)
        start = 0
        while start < n:
            before = loss[start - 1] if start else 0
            # The longest run with no more loss than a sequence takes.
            end = min(start + limits.tokens, int(np.searchsorted(loss, before + limits.loss_tokens, side="right")), n)
            yield document.part(start, end)
            start = end

    def close(self, pieces: list[_Piece]) -> None:
        """Make one sequence of the pieces."""
        offset = 0
        for piece in pieces:
            self.out.append((piece, self.next_id, offset))
            offset += len(piece.ids)
        self.next_id += 1

    def pack(self, last: bool) -> None:
        """Pack what waits. Sequences that stay too empty wait for the next block; at the end they are cut."""
        pieces, self.waiting = self.waiting, []
        if not pieces:
            return
        limits = self.limits
        demands = np.array([(len(p.ids), 1, p.loss) for p in pieces], dtype=np.float64)
        for own in dot_product_bins(demands, limits.capacity):
            held = [pieces[i] for i in own]
            total = sum(len(p.ids) for p in held)
            if total >= limits.least_fill * limits.tokens or not total & (total - 1):
                self.close(held)
            elif not last and len(self.waiting) + len(held) <= limits.block // 2:
                self.waiting.extend(held)
            else:
                for length in powers_of_two(total):
                    taken, held = _cut(held, length)
                    self.close(taken)

    def flush(self) -> Iterator[pa.RecordBatch]:
        out, self.out = self.out, []
        if out:
            lengths = np.array([len(p.ids) for p, _, _ in out], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([p.rest for p, _, _ in out]),
                    pa.array([p.start for p, _, _ in out], pa.int64()),
                    pa.array(lengths),
                    pa.array([p.ids.tobytes() for p, _, _ in out], pa.binary()),
                    pa.array([p.doc_tokens for p, _, _ in out], pa.int64()),
                    pa.array([s for _, s, _ in out], pa.int64()),
                    pa.array([o for _, _, o in out], pa.int64()),
                    pa.array([p.loss for p, _, _ in out], pa.int64()),
                ],
                ["_rest", *(name for name, _ in PIECE)],
            )


def _cut(pieces: list[_Piece], length: int) -> tuple[list[_Piece], list[_Piece]]:
    """The first ``length`` tokens of the pieces, and the rest."""
    taken: list[_Piece] = []
    for i, piece in enumerate(pieces):
        if length == 0:
            return taken, pieces[i:]
        if len(piece.ids) > length:
            return [*taken, piece.part(0, length)], [piece.part(length, len(piece.ids)), *pieces[i + 1 :]]
        taken.append(piece)
        length -= len(piece.ids)
    return taken, []


def loss_bytes(data: np.ndarray, ranges: list[dict | None] | None) -> np.ndarray:
    """Which bytes of a text lie in ranges ``{start, end}`` of code points, which may overlap or lie outside of it. One more tells of the text's end."""
    places = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    edge = np.zeros(len(data) + 2, dtype=np.int64)
    for span in ranges or []:
        if span is None or span["start"] is None or span["end"] is None:
            continue
        start, end = max(span["start"], 0), min(span["end"], len(places) - 1)
        if start < end:
            edge[places[start]] += 1
            # The end of the text bears loss with its last character.
            edge[places[end] + (end == len(places) - 1)] -= 1
    return np.cumsum(edge[:-1]) > 0


def _packed(tokenizer_path: str, end_id: int, limits: PackLimits, with_loss: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = PieceIds(tokenizer_path)
        context = TaskContext.get()
        packer = _Packer(limits, (context.partitionId() if context else 0) << 40)
        for batch in batches:
            rest = batch.column("_rest")
            ranges = batch.column("_loss").to_pylist() if with_loss else None
            for chunk in chunks(batch.column("_text")):
                ids, counts, starts = pieces.located_ids(chunk)
                at = 0
                for i, n in enumerate(counts.tolist()):
                    own, mask = np.append(ids[at : at + n], np.uint32(end_id)), None
                    if ranges is not None:
                        low, high = chunk.bounds[i], chunk.bounds[i + 1]
                        bears = loss_bytes(chunk.data[low:high], ranges[chunk.first + i])
                        mask = np.append(bears[starts[at : at + n] - low], bears[-1])
                    packer.add(_Piece(rest.slice(chunk.first + i, 1), 0, own, mask, n + 1))
                    at += n
                if len(packer.out) >= 2048:
                    yield from packer.flush()
        packer.pack(last=True)
        yield from packer.flush()

    return run


def pack_documents(
    docs: DataFrame, tokenizer_path: str, end_id: int, text_col: str = "text", limits: PackLimits = PackLimits(), loss_col: str | None = None
) -> DataFrame:
    """Tokenise ``docs`` and pack all ids into sequences.

    Gives a row for each piece: the other columns of ``docs`` in struct ``_rest``, and ``start`` (the document's ids before the piece), ``length``,
    ``ids`` (little-endian unsigned 32-bit), ``doc_tokens`` (all ids of the document, its
    ``end_id`` included), ``sequence_id`` and ``offset`` in the sequence, and ``loss_tokens`` (ids of the piece that bear loss). Each partition packs for
    itself, a block at a time, so nothing is shuffled and memory is bounded by a block and the
    longest text; sequence ids are unique, not consecutive.

    ``loss_col`` holds the ranges ``{start, end}`` of characters of a text that bear loss, as preference.format_preferences gives them; null is none. An id bears loss
    if its piece of a word begins in a range, and the end id if the last character is in one. Without ``loss_col`` all ids do.

    Documents that are too much for a sequence, in tokens or in loss, are cut into pieces that are not.
    A null text counts as empty and gives the end id alone. Equal rows are packed like any others; an empty table gives none.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    loss = [F.col(f"`{loss_col}`").alias("_loss")] if loss_col else []
    base = docs.select(F.struct(*(rest or [F.lit(1).alias("_")])).alias("_rest"), F.col(f"`{text_col}`").alias("_text"), *loss)
    schema = T.StructType([base.schema["_rest"], *(T.StructField(name, kind) for name, kind in PIECE)])
    return base.mapInArrow(_packed(tokenizer_path, end_id, limits, bool(loss_col)), schema)


def piece_columns() -> list[Column]:
    """The digest of each piece, with the checksum of its ids."""
    return [
        F.col("start"), F.col("length"), F.crc32("ids").alias("ids_crc32"), F.col("doc_tokens"), F.col("sequence_id"), F.col("offset"), F.col("loss_tokens"),
    ]
