"""Token ids of whole texts by a public tokenizer whose tokens never cross white space.

Words repeat, so each task asks the tokenizer once for every distinct piece of a word and then
only copies ids. The tokenizer must be built as ``word_bpe_49k.json`` is: it folds case, drops
white space, cuts words into runs of letters, single digits and runs of other marks, and joins
no tokens across these.
"""

from __future__ import annotations

import numpy as np
from tokenizers import Tokenizer

from annolytics.llm.words import Chunk, Words, byte_codes, mixed, space_table, word_hashes, words_of

# Classes of bytes. A plain word has printable ASCII and the Latin letters that UTF-8 writes as C3 80 to C3 BF; these have one lower
# case each and no other composed form. Words with anything else, with an apostrophe (contractions are pieces of their own) or
# with "<" (special tokens) go through the whole tokenizer.
SPACE, LETTER, DIGIT, MARK, ODD = range(5)


def byte_classes() -> np.ndarray:
    out = np.full(256, ODD, dtype=np.uint8)
    out[0x21:0x7F] = MARK
    out[ord("0") : ord("9") + 1] = DIGIT
    out[ord("A") : ord("Z") + 1] = LETTER
    out[ord("a") : ord("z") + 1] = LETTER
    out[[ord("'"), ord("<")]] = ODD
    out[space_table()] = SPACE
    return out


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if it prints, else the next from 256 on."""
    printing = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printing]
    return {b: chr(b) for b in printing} | {b: chr(256 + i) for i, b in enumerate(others)}


class HashTable:
    """Codes of 64-bit hashes by open addressing, looked up and filled whole arrays at a time."""

    def __init__(self, bits: int):
        self.mask = np.uint64((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, dtype=np.uint64)
        self.codes = np.full(1 << bits, -1, dtype=np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The code of each hash, or -1."""
        at = (hashes & self.mask).astype(np.int64)
        out = self.codes[at]
        open_ = np.flatnonzero((self.keys[at] != hashes) & (out >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & int(self.mask)
            slot = at[open_]
            out[open_] = self.codes[slot]
            open_ = open_[(self.keys[slot] != hashes[open_]) & (out[open_] >= 0)]
        return out

    def add(self, hashes: np.ndarray, codes: np.ndarray) -> None:
        """Enter distinct hashes that are not there yet."""
        at = (hashes & self.mask).astype(np.int64)
        left = np.arange(len(hashes))
        while len(left):
            slot = at[left]
            free = self.codes[slot] < 0
            self.keys[slot[free]], self.codes[slot[free]] = hashes[left[free]], codes[left[free]]
            left = left[self.codes[slot] != codes[left]]
            at[left] = (at[left] + 1) & int(self.mask)


class PieceIds:
    """Ids of the pieces of chunks of texts. At most ``2 * held`` distinct pieces are remembered; then it starts anew.

    Pieces are looked up in runs of at most ``held``, so a text may have any number of different ones.

    With ``special_as_text`` the strings of special tokens are ordinary text.
    """

    def __init__(self, tokenizer_path: str, held: int = 500_000, special_as_text: bool = False):
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.held = held
        self.letters = str.maketrans({chr(b): letter for b, letter in byte_letters().items()})
        self.hash_codes, self.classes = byte_codes(fold_case=False), byte_classes()
        self.clear()

    def clear(self) -> None:
        self.known = 0
        self.table = HashTable((4 * self.held).bit_length())
        self.flat, self.used = np.zeros(1 << 16, dtype=np.uint32), 0
        self.start, self.length = np.zeros(1 << 14, dtype=np.int64), np.zeros(1 << 14, dtype=np.int64)

    def _pieces(self, chunk: Chunk, words: Words) -> tuple[np.ndarray, Words, np.ndarray]:
        """The bytes with plain words in lower case, the pieces of all words, and which pieces are odd words."""
        data, n = chunk.data.copy(), len(chunk.data)
        kind = self.classes[data]
        pair = np.flatnonzero(data[:-1] == 0xC3)
        second = data[pair + 1]
        latin = (second >= 0x80) & (second <= 0xBF) & (second != 0x97) & (second != 0xB7)
        kind[pair[latin]] = LETTER
        kind[pair[latin] + 1] = LETTER
        odd = np.diff(np.concatenate(([0], np.cumsum(kind == ODD)))[np.stack([words.start, words.end])], axis=0)[0] > 0
        edge = np.zeros(n + 1, dtype=np.int8)
        edge[words.start[odd]] += 1
        np.subtract.at(edge, words.end[odd], 1)
        inside_odd = np.cumsum(edge[:-1], dtype=np.int8) > 0
        capital = pair[latin & (second >= 0x80) & (second <= 0x9E)] + 1
        lower = data + ((data >= ord("A")) & (data <= ord("Z"))) * np.uint8(32)
        lower[capital] += 32
        data = np.where(inside_odd, data, lower)
        begins = np.zeros(n, dtype=bool)
        begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        begins &= (kind != SPACE) & ~inside_odd
        begins[words.start] = True
        start = np.flatnonzero(begins)
        # A piece ends where the next one of its word starts, or with the word.
        first = np.searchsorted(start, words.start)
        end = np.append(start[1:], n)
        end[np.append(first[1:], len(start)) - 1] = words.end
        return data, Words(start, end, np.append(first, len(start))[words.first]), inside_odd[start]

    def _learn(self, raw: bytes, start: np.ndarray, end: np.ndarray, odd: np.ndarray) -> np.ndarray:
        """Codes of new pieces."""
        tokenize, ids = self.tokenizer.model.tokenize, []
        for s, e, is_odd in zip(start.tolist(), end.tolist(), odd.tolist()):
            piece = raw[s:e]
            if is_odd:
                ids.append(piece.decode("utf-8", "replace"))
            elif piece.isascii():
                ids.append([t.id for t in tokenize(piece.decode())])
            else:
                ids.append([t.id for t in tokenize(piece.decode("latin-1").translate(self.letters))])
        whole = [i for i, x in enumerate(ids) if isinstance(x, str)]
        for i, encoded in zip(whole, self.tokenizer.encode_batch_fast([ids[i] for i in whole], add_special_tokens=False)):
            ids[i] = encoded.ids
        lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        total, known = int(lengths.sum()), self.known
        self.flat = _room(self.flat, self.used + total)
        self.start, self.length = _room(self.start, known + len(ids)), _room(self.length, known + len(ids))
        self.flat[self.used : self.used + total] = np.fromiter((i for x in ids for i in x), dtype=np.uint32, count=total)
        self.start[known : known + len(ids)] = self.used + np.cumsum(lengths) - lengths
        self.length[known : known + len(ids)] = lengths
        self.used += total
        self.known += len(ids)
        return np.arange(known, known + len(ids))

    def ids(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts of a chunk, end to end, and how many each text has."""
        ids, counts, _ = self.located_ids(chunk)
        return ids, counts

    def located_ids(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, how many each text has, and for each id the byte of the chunk at which its piece of a word begins."""
        words = words_of(chunk)
        if not len(words.start):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(chunk.bounds) - 1, dtype=np.int64), np.zeros(0, dtype=np.int64)
        data, pieces, odd = self._pieces(chunk, words)
        hashes = word_hashes(Chunk(chunk.first, data, chunk.bounds), pieces, self.hash_codes)
        hashes = np.where(odd, mixed(hashes), hashes)
        raw, ids, lengths = b"", [], []
        for low in range(0, len(hashes), self.held):
            codes = self._codes(hashes[low : low + self.held])
            missing = np.flatnonzero(codes < 0)
            if len(missing):
                new, first, back = np.unique(hashes[low + missing], return_index=True, return_inverse=True)
                at = low + missing[first]
                raw = raw or data.tobytes()
                found = self._learn(raw, pieces.start[at], pieces.end[at], odd[at])
                self.table.add(new, found)
                codes[missing] = found[back]
            length = self.length[codes]
            before = np.cumsum(length) - length
            ids.append(self.flat[np.repeat(self.start[codes] - before, length) + np.arange(int(length.sum()))])
            lengths.append(length)
        length = np.concatenate(lengths)
        return np.concatenate(ids), np.diff(np.concatenate(([0], np.cumsum(length)))[pieces.first]), np.repeat(pieces.start, length)

    def _codes(self, hashes: np.ndarray) -> np.ndarray:
        """The codes of a run of pieces, -1 for new ones, for which there is room then."""
        if self.known > self.held:
            self.clear()
        return self.table.find(hashes)


def _room(array: np.ndarray, n: int) -> np.ndarray:
    """The array, or a copy with room for ``n`` entries."""
    return array if n <= len(array) else np.concatenate([array, np.zeros(max(n - len(array), len(array)), array.dtype)])


def ended_ids(chunk: Chunk, pieces: PieceIds, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a chunk's texts with ``end_id`` after each, and the number of each text's ids with that."""
    ids, counts = pieces.ids(chunk)
    return np.insert(ids, np.cumsum(counts), np.uint32(end_id)), counts + 1
