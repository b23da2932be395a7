"""Text helpers: choosing a text field, lexicon sentiment, times, template fields, float text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The field names a text model looks at first, in order.
TEXT_FIELDS = ("text", "review", "comment", "sentence", "content", "body")

# The default English sentiment word lists.
POSITIVE_WORDS = (
    "good", "great", "excellent", "amazing", "awesome", "fantastic", "wonderful",
    "love", "beautiful", "perfect", "brilliant", "outstanding", "superb",
    "impressive", "masterpiece", "enjoyable", "delightful", "remarkable",
    "best", "fun", "hilarious", "moving", "captivating", "stunning",
)
NEGATIVE_WORDS = (
    "bad", "terrible", "awful", "horrible", "worst", "boring", "dull",
    "disappointing", "poor", "mediocre", "trash", "garbage", "hate",
    "waste", "annoying", "ridiculous", "stupid", "unwatchable", "painful",
    "dreadful", "atrocious", "abysmal", "lame", "pointless",
)

# The widgets whose name attribute is a label field, and the pattern that finds it.
WIDGETS = ("SelectField", "TextField", "CheckboxGroup", "RatingField", "NERField", "BBoxField")
AUDIO_WIDGET = "AudioSegmentField"
NAME_ATTRIBUTE = r'\s[^>]*?name="([^"]+)"'


def quoted(name: str) -> Column:
    """A top-level column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def pick_text(schema: T.StructType) -> Column:
    """The field a text model reads: the first non-blank well-known field, else the first string
    longer than 20 characters, else the first field as text."""
    strings = [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)]
    options = [
        F.when(quoted(name).rlike(r"\S"), quoted(name)) for name in TEXT_FIELDS if name in strings
    ]
    options += [F.when(F.length(quoted(name)) > 20, quoted(name)) for name in strings]
    options.append(quoted(schema.fields[0].name).cast("string"))
    return F.coalesce(*options)


def lexicon_sentiment(
    text: Column,
    positive: Sequence[str] = POSITIVE_WORDS,
    negative: Sequence[str] = NEGATIVE_WORDS,
) -> Column:
    """positive, negative or neutral by which list has more distinct words in the whole text.

    Words are runs of the letters a-z and apostrophes in the lower-cased text.
    """
    words = F.split(F.lower(text), "[^a-z']+")

    def hits(lexicon: Sequence[str]) -> Column:
        return F.size(F.array_intersect(words, F.array(*[F.lit(word) for word in lexicon])))

    # One lookup by the sign of the balance keeps the words split once.
    verdicts = F.array(F.lit("negative"), F.lit("neutral"), F.lit("positive"))
    return F.element_at(verdicts, (F.signum(hits(positive) - hits(negative)) + 2).cast("int"))


def format_time(seconds: Column) -> Column:
    """Seconds as ``m:ss``."""
    minutes = F.floor(seconds / 60).cast("string")
    rest = F.floor(seconds % 60).cast("string")
    return F.concat(minutes, F.lit(":"), F.lpad(rest, 2, "0"))


def format_segment(start: Column, end: Column) -> Column:
    """``@ m:ss`` for a point, ``m:ss – m:ss`` for a range."""
    point = F.concat(F.lit("@ "), format_time(start))
    span = F.concat(format_time(start), F.lit(" – "), format_time(end))
    return F.when(start == end, point).otherwise(span)


def template_fields(source: Column, include_audio: bool = False) -> Column:
    """Label fields named in a template source, in order, duplicates kept; none for null."""
    widgets = WIDGETS + ((AUDIO_WIDGET,) if include_audio else ())
    pattern = "<(?:" + "|".join(widgets) + ")" + NAME_ATTRIBUTE
    return F.regexp_extract_all(F.coalesce(source, F.lit("")), F.lit(pattern), 1)


def float_text(value: Column) -> Column:
    """A double as Arrow prints it: 1, 0.1, 1e+20, nan, -inf.

    Spark writes 1.0 and 1.0E20. Numbers with a decimal exponent from -6 to 9 are written out,
    others keep one digit before the point.
    """
    text = value.cast("string")
    size = F.abs(value)
    # The cast to decimal goes through the shortest text of the double, so no digits are made up.
    digits = value.try_cast("decimal(38,24)").cast("string")
    written_out = F.regexp_replace(digits, r"\.?0+$", "")
    scientific = F.replace(F.replace(F.replace(text, F.lit(".0E"), F.lit("E")), F.lit("E-"), F.lit("e-")), F.lit("E"), F.lit("e+"))
    return (
        F.when(F.isnan(value), "nan")
        .when(size == float("inf"), F.when(value > 0, "inf").otherwise("-inf"))
        .when((size == 0) | ((size >= 1e-3) & (size < 1e7)), F.regexp_replace(text, r"\.0$", ""))
        .when((size >= 1e-6) & (size < 1e10), written_out)
        .otherwise(scientific)
    )
