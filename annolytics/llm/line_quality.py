"""Line-first cleaning: rules judge lines, failing lines go, and a text that loses too much goes with them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annolytics.llm.words import Chunk, byte_codes, chunks, combined, space_table, word_hashes, words_of

# Phrases, in lower case, of lines that stand on every page of a site, in English, German, French and Spanish.
BOILERPLATE = (
    "all rights reserved",
    "accept cookies",
    "click here",
    "cookie policy",
    "distributed under",
    "enable javascript",
    "licensed under",
    "lorem ipsum",
    "privacy policy",
    "released under",
    "share this",
    "sign up",
    "subscribe to",
    "terms of service",
    "terms of use",
    "alle rechte vorbehalten",
    "cookies akzeptieren",
    "datenschutzerklärung",
    "hier klicken",
    "jetzt anmelden",
    "lizenziert unter",
    "nutzungsbedingungen",
    "veröffentlicht unter der",
    "abonnez-vous",
    "accepter les cookies",
    "cliquez ici",
    "conditions d'utilisation",
    "politique de confidentialité",
    "sous licence",
    "tous droits réservés",
    "aceptar cookies",
    "bajo la licencia",
    "haga clic aquí",
    "política de privacidad",
    "suscríbete",
    "términos de uso",
    "todos los derechos reservados",
)
# Marks that end a sentence, with the brackets and quotes that may follow it.
SENTENCE_END = ".!?…:;。！？\"'”’»)]"
# The symbols counted as n_symbols.
SYMBOLS = "#*$%&|<>"


class LineRules(NamedTuple):
    """Limits of the rules. Shares are in percent.

    A line with a word fails if

    * boilerplate: it has one of ``BOILERPLATE``;
    * navigation: at least ``separator_share`` of its words are nothing but ``|``, ``>``, ``»``, ``·`` or ``/``, however long it is;
    * symbols: ``SYMBOLS`` in it are more than ``symbol_share`` of its words;
    * shouting: it has at least ``shout_words`` words, and letters only in upper case;
    * punctuation: it has at least ``open_words`` words and no mark that ends a sentence, or at least ``shout_words`` words
      of which more than ``mark_share`` end in ``!`` or ``?``.

    A text is rejected if the failing lines hold more than ``lost_share`` of its words' code points.
    """

    separator_share: int = 20
    symbol_share: int = 30
    shout_words: int = 8
    open_words: int = 60
    mark_share: int = 60
    lost_share: int = 40


_SEPARATOR = re.compile("[|>»·/]+")
_SPACE = " \t\v\f\r\n"


def line_fails(line: str, rules: LineRules) -> bool:
    """Whether a rule rejects a line; one without words never fails. Costly tests come after cheap ones that rule them out."""
    if not line.strip(_SPACE):
        return False
    lower = line.lower()
    if any(phrase in lower for phrase in BOILERPLATE):
        return True
    words = [w.decode() for w in line.encode().split()]
    n = len(words)
    if any(c in line for c in "|>»·/"):
        separators = sum(bool(_SEPARATOR.fullmatch(w)) for w in words)
        if separators and 100 * separators >= rules.separator_share * n:
            return True
    if 100 * sum(line.count(c) for c in SYMBOLS) > rules.symbol_share * n:
        return True
    if n >= rules.shout_words:
        if line.isupper():
            return True
        if 100 * (line.count("!") + line.count("?")) > rules.mark_share * n and 100 * sum(w[-1] in "!?" for w in words) > rules.mark_share * n:
            return True
    return n >= rules.open_words and not any(c in line for c in SENTENCE_END)


def failing_lines(text: str, rules: LineRules, has_symbols: bool) -> set[str]:
    """The different lines of a text that fail. What the whole text has none of, no line is tested for."""
    lower = text.lower()
    plain = not has_symbols and not any(phrase in lower for phrase in BOILERPLATE)
    plain = plain and not any(c in text for c in "»·/!?") and not text.isupper()
    failing = set()
    for line in set(text.split("\n")):
        if plain and (len(line) < 2 * rules.open_words - 1 and len(line) < 2 * rules.shout_words - 1 or "." in line and not line.isupper()):
            continue
        if line_fails(line, rules):
            failing.add(line)
    return failing


def _total(marks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Number of marked bytes of each text."""
    return np.diff(np.concatenate(([0], np.cumsum(marks)))[bounds])


def base_measures(chunk: Chunk, codes: np.ndarray) -> dict[str, np.ndarray]:
    """Words, their code points, symbols and words in repeated 3-word windows of each text of a chunk.

    Windows are told apart by 64-bit hashes.
    """
    words = words_of(chunk)
    n_words = np.diff(words.first)
    data = chunk.data
    symbol = np.isin(np.arange(256), np.frombuffer(SYMBOLS.encode(), np.uint8))
    first_byte = (data & 0xC0) != 0x80
    hashes = word_hashes(chunk, words, codes)
    text_of = np.repeat(np.arange(len(n_words)), n_words)
    covered = np.zeros(len(hashes), dtype=bool)
    if len(hashes) > 2:
        # The text's number is part of the key, so that windows repeat only within a text.
        inside = np.flatnonzero(text_of[:-2] == text_of[2:])
        keys = combined([hashes[inside], hashes[inside + 1], hashes[inside + 2], text_of[inside].astype(np.uint64)])
        order = np.argsort(keys)
        equal = keys[order[1:]] == keys[order[:-1]]
        twice = np.zeros(len(keys), dtype=bool)
        twice[order[1:][equal]] = True
        twice[order[:-1][equal]] = True
        for j in range(3):
            covered[inside[twice] + j] = True
    return {
        "n_words": n_words,
        "word_chars": _total(first_byte & ~space_table()[data], chunk.bounds),
        "n_symbols": _total(symbol[data], chunk.bounds),
        "n_repeat_words": np.diff(np.concatenate(([0], np.cumsum(covered)))[words.first]),
    }


def measure(texts: pa.Array, rules: LineRules, with_text: bool = True) -> Iterator[tuple[int, dict[str, np.ndarray | list]]]:
    """All measures of whole texts, in runs: the first text of a run and a column per measure."""
    codes = byte_codes(fold_case=False)
    for chunk in chunks(texts):
        out: dict[str, np.ndarray | list] = dict(base_measures(chunk, codes))
        n = len(chunk.bounds) - 1
        dup, lost, cleaned = np.zeros(n, np.int64), np.zeros(n, np.int64), []
        raw = chunk.data.tobytes()
        for i in range(n):
            text = raw[chunk.bounds[i] : chunk.bounds[i + 1]].decode("utf-8", "replace")
            lines = text.split("\n")
            if len(set(lines)) < len(lines):
                filled = [line for line in lines if line.strip(_SPACE)]
                dup[i] = len(filled) - len(set(filled))
            failing = failing_lines(text, rules, bool(out["n_symbols"][i]))
            if failing:
                lost[i] = sum(len(line) - sum(line.count(c) for c in _SPACE) for line in lines if line in failing)
            if with_text:
                cleaned.append("\n".join(line for line in lines if line not in failing) if failing else text)
        failed = (out["n_words"] < 50) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
        out |= {"n_dup_lines": dup, "base_failed": failed, "lost_chars": lost, "cleaned": cleaned}
        out["kept"] = ~failed & (100 * lost <= rules.lost_share * out["word_chars"])
        yield chunk.first, out


MEASURED = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField(c, T.BooleanType()) for c in ("base_failed", "kept")]
    + [T.StructField("lost_chars", T.LongType()), T.StructField("cleaned", T.StringType())]
)


def _measured(rules: LineRules, with_text: bool):
    names = [f.name for f in MEASURED.fields if with_text or f.name != "cleaned"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, columns in measure(batch.column("_text"), rules, with_text):
                found = pa.StructArray.from_arrays([pa.array(columns[c], pa.string() if c == "cleaned" else None) for c in names], names)
                yield pa.RecordBatch.from_arrays([batch.column("_rest").slice(first, len(found)), found], ["_rest", "_found"])

    return run


def quality_lines(docs: DataFrame, text_col: str = "text", rules: LineRules = LineRules(), with_text: bool = True) -> DataFrame:
    """Every row of ``docs``, in struct ``_rest``, with its measures in struct ``_found``.

    Words are runs of anything but ASCII white space. One pass over whole texts without a
    shuffle; a row is judged by itself, so equal rows get equal results. A null or empty text has no words and fails. ``cleaned`` (with ``with_text``) is
    the text without its failing lines. All columns of ``docs`` are in ``_rest`` under their
    own names, so none can clash with a measure; without ``with_text`` the text is not among them.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if with_text or c != text_col]
    base = docs.select(F.struct(*(rest or [F.lit(1).alias("_")])).alias("_rest"), F.col(f"`{text_col}`").alias("_text"))
    found = T.StructType([f for f in MEASURED.fields if with_text or f.name != "cleaned"])
    schema = T.StructType([base.schema["_rest"], T.StructField("_found", found)])
    return base.mapInArrow(_measured(rules, with_text), schema)


def clean_documents(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", rules: LineRules = LineRules()) -> DataFrame:
    """The columns of ``docs`` for the rows kept, with texts cleaned and ``length_col`` (if there) recounted."""
    found = quality_lines(docs, text_col, rules).where("_found.kept")

    def column(name: str) -> Column:
        if name == text_col:
            return F.col("_found.cleaned").alias(name)
        if name == length_col:
            return F.length("_found.cleaned").cast(docs.schema[name].dataType).alias(name)
        return F.col("_rest")[name].alias(name)

    return found.select(*[column(c) for c in docs.columns])
