"""Secrets in texts: fixed patterns, and strings that a primed compressor finds new where a secret is due."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annolytics.session import settle

# The base kinds in their order, and their patterns; letters of ASCII only match in either case.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ASSIGN_VALUE = 6
ACCESS = re.compile("AKIA[A-Z0-9]{16,}")
HEX = re.compile("[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")
# Words after which a secret is due.
SENSITIVE = re.compile(
    r"(?i:(?<![a-z])(?:pass(?:word|wd|phrase|code)|pwd|secret|token|api[_ -]?key|(?:access|private|signing|encryption|account|license)[_ -]?key"
    r"|auth|authorization|bearer|basic|credential|webhook|client[_ -]?id|connection[_ -]?string|cookie|session[_ -]?id|otp|salt)s?(?![a-z]))",
    re.ASCII,
)
VALUE = re.compile(r"[A-Za-z0-9+/_~-]+(?:\.[A-Za-z0-9+/_~-]+)*={0,2}")
WORD = re.compile("[A-Za-z][a-z]{3,23}")


class NoveltySettings(NamedTuple):
    """What counts as new.

    A candidate is a run of at least ``least`` value characters that starts within ``reach`` characters after a sensitive word.
    It is reported if it adds at least ``overhead`` and ``share`` percent of its length in bytes to the compressed ``around`` characters on each side
    of it. Random strings of letters and digits add one byte a character or more, those of syllables and identifiers about half. The compressor is primed with identifiers of the corpus.
    The dictionary holds the ``identifiers`` commonest words that stand in at least about ``lines`` different lines.
    """

    least: int = 12
    reach: int = 48
    around: int = 512
    overhead: int = 3
    share: int = 72
    identifiers: int = 4096
    lines: int = 24
    level: int = 9


class Span(NamedTuple):
    start: int
    kind: int
    end: int
    novelty: float | None


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns, leftmost and without overlap within a kind, in code points."""
    lower, found = text.lower(), []
    if any(word in lower for word in ("passw", "secret", "token", "api")):
        found += [Span(m.start(), 0, m.end(), None) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    if "AKIA" in text:
        found += [Span(m.start(), 1, m.end(), None) for m in ACCESS.finditer(text)]
    found += [Span(m.start(), 2, m.end(), None) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, settings: NoveltySettings) -> Iterator[tuple[int, int]]:
    """Ranges of value characters that start soon after a sensitive word, without overlap. Bare words of prose count too."""
    done = 0
    for word in SENSITIVE.finditer(text):
        at = max(word.end(), done)
        while (m := VALUE.search(text, at)) and m.start() < word.end() + settings.reach:
            at = done = m.end()
            if m.end() - m.start() >= settings.least:
                yield m.start(), m.end()


class Novelty:
    """Compressed bytes that a string adds to the text around it, for a compressor primed with identifiers."""

    def __init__(self, identifiers: bytes, level: int):
        # A raw dictionary has eight bytes at least.
        known = zstandard.ZstdCompressionDict(identifiers, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(identifiers) >= 8 else None
        if known:
            known.precompute_compress(level=level)
        self._press = zstandard.ZstdCompressor(level=level, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)

    def size(self, text: str) -> int:
        return len(self._press.compress(text.encode("utf-8", "replace")))

    def marginal_bytes(self, candidate: str, before: str, after: str) -> int:
        return self.size(before + candidate + after) - self.size(before + after)


def novel_spans(text: str, base: list[Span], novelty: Novelty, settings: NoveltySettings) -> list[Span]:
    """Candidates that touch no base span and that the primed compressor cannot shorten enough."""
    found, at = [], 0
    ordered = sorted(base)
    reached = 0
    for start, end in candidates(text, settings):
        while at < len(ordered) and ordered[at].start < end:
            reached = max(reached, ordered[at].end)
            at += 1
        if reached > start:
            continue
        before, after = text[max(0, start - settings.around) : start], text[end : end + settings.around]
        added = novelty.marginal_bytes(text[start:end], before, after)
        if 100 * (added - settings.overhead) >= settings.share * (end - start):
            found.append(Span(start, 3, end, added / (end - start)))
    return found


def _line_words(texts: Iterator[str | None]) -> Iterator[dict[str, list[int]]]:
    """For each word, marks of the lines it stands in and their number; handed on whenever many words are held."""
    held: dict[str, list[int]] = {}
    for text in texts:
        for line in (text or "").split("\n"):
            words = set(WORD.findall(line))
            if not words:
                continue
            mark = 1 << zlib.crc32(line.encode("utf-8", "replace")) % 63
            for word in words:
                if (seen := held.get(word)) is None:
                    held[word] = [mark, 1]
                else:
                    seen[0] |= mark
                    seen[1] += 1
        if len(held) > 300_000:
            yield held
            held = {}
    yield held


def _counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts = (text.as_py() for batch in batches for text in batch.column(0))
    for held in _line_words(texts):
        marks, counts = [v[0] for v in held.values()], [v[1] for v in held.values()]
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(marks, pa.int64()), pa.array(counts, pa.int64())], ["word", "marks", "lines"])


def identifier_dictionary(docs: DataFrame, text_col: str = "text", settings: NoveltySettings = NoveltySettings()) -> bytes:
    """Words and parts of identifiers that are common in all texts, the commonest last.

    Different lines are told apart by 63 marks, combined before the shuffle, so that a secret in thousands of copies of a text stands in one line and
    stays out. Only the words chosen, of bounded number and length, reach the driver.
    """
    words = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(_counted_words, "word string, marks bigint, lines bigint")
    # 63 marks of which m are set stand for about -63 ln(1 - m / 63) lines.
    least = next(m for m in range(1, 64) if m == 63 or 63 * (1 - (1 - 1 / 63) ** settings.lines) <= m)
    common = words.groupBy("word").agg(F.bit_or("marks").alias("marks"), F.sum("lines").alias("lines")).where(F.bit_count("marks") >= least)
    # Written first: the candidates of all tasks then meet in a task, and only the chosen words in the driver.
    chosen = settle(common.select("word", "lines").orderBy(F.col("lines").desc(), "word").limit(settings.identifiers), "identifiers").collect()
    return "\n".join(row["word"] for row in sorted(chosen, key=lambda row: (row["lines"], row["word"]))).encode()


FOUND = T.StructType(
    [
        T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
        T.StructField("novelty", T.DoubleType()),
    ]
)
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("novelty", pa.float64())]))


def spans_of(text: str | None, novelty: Novelty, settings: NoveltySettings) -> list[Span]:
    """All spans of one text by start, then kind."""
    text = text or ""
    base = base_spans(text)
    return sorted(base + novel_spans(text, base, novelty, settings))


def find_secrets(
    docs: DataFrame, text_col: str = "text", settings: NoveltySettings = NoveltySettings(), identifiers: bytes | None = None, keep_text: bool = False
) -> DataFrame:
    """Every row of ``docs``, in struct ``_rest``, with ``_spans``, an array of ``(kind, start, end, novelty)``, end exclusive, in code points.

    Kinds: ``assign`` (a name, ``=`` or ``:`` and a value; the whole match), ``access`` and ``hex`` by pattern, and ``novel``, strings after sensitive words that stay
    incompressible for a compressor primed with the text around them and with the corpus's identifiers. Base spans are never changed by the novel ones, which
    do not overlap them. Whole texts are scanned, a row by itself, so equal rows get equal spans; a null or empty text has none.
    All columns but the text (with ``keep_text`` also it) are in ``_rest`` under their own names, so none can clash. An empty table stays empty.
    """
    known = identifier_dictionary(docs, text_col, settings) if identifiers is None else identifiers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(known, settings.level)
        for batch in batches:
            spans = [
                [{"kind": KINDS[s.kind], "start": s.start, "end": s.end, "novelty": s.novelty} for s in spans_of(text.as_py(), novelty, settings)]
                for text in batch.column("_text")
            ]
            yield pa.RecordBatch.from_arrays([batch.column("_rest"), pa.array(spans, _SPANS)], ["_rest", "_spans"])

    rest = [F.col(f"`{c}`") for c in docs.columns if keep_text or c != text_col]
    base = docs.select(F.struct(*(rest or [F.lit(1).alias("_")])).alias("_rest"), F.col(f"`{text_col}`").alias("_text"))
    return base.mapInArrow(run, T.StructType([base.schema["_rest"], T.StructField("_spans", T.ArrayType(FOUND))]))


def redacted(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]", settings: NoveltySettings = NoveltySettings()) -> DataFrame:
    """The columns of ``docs`` with every span of a secret replaced by ``mask``; overlapping spans are one."""
    found = find_secrets(docs, text_col, settings, keep_text=True)
    text = F.col("_rest")[text_col]
    # Ends of merged spans so far and the text put together up to there.
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    step = lambda a, s: F.struct(
        F.greatest(a["at"], s["end"]).alias("at"),
        F.when(s["start"] < a["at"], a["out"])
        .otherwise(F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit(mask)))
        .alias("out"),
    )
    tail = lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text)))
    clean = F.when(F.size("_spans") == 0, text).otherwise(F.aggregate("_spans", start, step, tail))
    return found.select(*[clean.alias(c) if c == text_col else F.col("_rest")[c].alias(c) for c in docs.columns])
