"""Words, shingles and their hashes for whole Arrow batches of texts, without a Python loop per word.

A word is a maximal run of bytes that are not ASCII white space (0x20, 0x09-0x0D). In UTF-8 these
bytes never occur inside another character, so words of the bytes are words of the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
MULTIPLIER = 0x9E3779B97F4A7C15 | 1


def space_table() -> np.ndarray:
    """True for the bytes that separate words."""
    table = np.zeros(256, dtype=bool)
    table[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
    return table


def byte_codes(fold_case: bool, seed: int = 1) -> np.ndarray:
    """A random 64-bit number for each byte; with ``fold_case`` A-Z share those of a-z."""
    codes = np.random.default_rng(seed).integers(0, 1 << 64, size=256, dtype=np.uint64)
    if fold_case:
        codes[ord("A") : ord("Z") + 1] = codes[ord("a") : ord("z") + 1]
    return codes


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, which spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Chunk(NamedTuple):
    """Texts ``first .. first + len(bounds) - 2`` of a batch, as bytes and text bounds in them."""

    first: int
    data: np.ndarray
    bounds: np.ndarray


def chunks(texts: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a string array into runs of texts of about ``chunk_bytes``; a null is an empty text.

    A longer text is a run of its own, so what is held is bounded by the longest text.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = int(np.searchsorted(offsets, offsets[at] + chunk_bytes, side="right")) - 1
        end = min(max(end, at + 1), len(texts))
        yield Chunk(at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
        at = end


class Words(NamedTuple):
    """Byte ranges of the words of a chunk; words of text i are ``first[i] .. first[i + 1] - 1``."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def words_of(chunk: Chunk) -> Words:
    data, bounds = chunk.data, chunk.bounds
    solid = ~space_table()[data]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    # A word never runs on into the next text.
    filled = bounds[1:] > bounds[:-1]
    at = bounds[:-1][filled]
    begins[at] = solid[at]
    at = bounds[1:][filled] - 1
    ends[at] = solid[at]
    start = np.flatnonzero(begins)
    return Words(start, np.flatnonzero(ends) + 1, np.searchsorted(start, bounds))


def powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of an odd number modulo 2^64."""
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(chunk: Chunk, words: Words, codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial in its byte codes, found by a running sum."""
    n = len(chunk.data)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(codes[chunk.data] * powers(MULTIPLIER, n), out=total[1:])
    # Dividing by the power a word starts at makes equal words equal wherever they stand.
    level = powers(pow(MULTIPLIER, -1, 1 << 64), n)[words.start]
    return mixed((total[words.end] - total[words.start]) * level + (words.end - words.start).astype(np.uint64))


def combined(parts: list[np.ndarray]) -> np.ndarray:
    """One hash of aligned hashes, in order."""
    out = np.full(len(parts[0]), len(parts), dtype=np.uint64)
    for part in parts:
        out = mixed(out * np.uint64(MULTIPLIER) + part)
    return out


def shingle_hashes(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of every text, and the number of each text's shingles.

    A text of fewer words has its whole sequence as one shingle, one without words has none.
    Repeated shingles are not removed.
    """
    n_words = np.diff(first)
    counts = np.where(n_words >= k, n_words - k + 1, (n_words > 0).astype(n_words.dtype))
    starts = np.repeat(first[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    long = np.repeat(n_words >= k, counts)
    out = np.empty(len(starts), dtype=np.uint64)
    full = starts[long]
    out[long] = combined([hashes[full + j] for j in range(k)])
    for size in range(1, k):
        at = first[:-1][n_words == size]
        out[np.flatnonzero(~long)[n_words[(n_words > 0) & (n_words < k)] == size]] = combined(
            [hashes[at + j] for j in range(size)]
        )
    return out, counts
