"""Masked pseudo-likelihood: a small network predicts every word from the words on both sides of it."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annolytics.llm.words import byte_codes, chunks, mixed, word_hashes, words_of
from annolytics.session import settle

Params = dict[str, np.ndarray]


class LmSettings(NamedTuple):
    """Words are hashed to ``classes * members`` buckets, and predicted class first, member second, then word of the bucket.

    The network sees ``window`` words on each side. All words are dealt to masks of at most ``mask_percent`` of them, and
    the masks to ``rounds``, so that every word is a target at least once. Documents are dealt by their content to parts of about
    ``part_bytes`` of text. In each round a network goes over each part; then the parts' networks are averaged. The ``known`` commonest words go to every task with their counts;
    the others' counts are joined, which changes no score.
    """

    classes: int = 32
    members: int = 64
    hidden: int = 16
    window: int = 2
    rounds: int = 2
    mask_percent: int = 15
    batch: int = 2048
    rate: float = 0.15
    seed: int = 5
    known: int = 1 << 18
    part_bytes: int = 1 << 24

    @property
    def buckets(self) -> int:
        return self.classes * self.members

    @property
    def masks(self) -> int:
        return -(-100 // self.mask_percent)

    def masks_of(self, number: int) -> range:
        """The masks of a round; all rounds together have every one."""
        return range(number % self.masks, self.masks, self.rounds)


def new_network(s: LmSettings) -> Params:
    """Small random weights. Bucket ``buckets`` stands for what is outside the text."""
    rng = np.random.default_rng(s.seed)
    shapes = {
        "words": (2 * s.window, s.buckets + 1, s.hidden),
        "bias": (s.hidden,),
        "to_class": (s.hidden, s.classes),
        "class_bias": (s.classes,),
        "of_class": (s.classes, s.hidden),
        "to_member": (s.hidden, s.members),
        "member_bias": (s.members,),
    }
    return {name: (rng.standard_normal(shape) * 0.1).astype(np.float32) for name, shape in shapes.items()}


def flat(net: Params) -> np.ndarray:
    return np.concatenate([net[name].ravel() for name in sorted(net)])


def unflat(values: np.ndarray, like: Params) -> Params:
    out, at = {}, 0
    for name in sorted(like):
        n = like[name].size
        out[name] = values[at : at + n].reshape(like[name].shape).astype(np.float32)
        at += n
    return out


def contexts(bucket: np.ndarray, text_of: np.ndarray, at: np.ndarray, s: LmSettings) -> np.ndarray:
    """The buckets around the places ``at``, one row per offset; outside the text it is the outside bucket."""
    out = np.full((2 * s.window, len(at)), s.buckets, dtype=np.int64)
    offsets = [k for k in range(-s.window, s.window + 1) if k]
    for row, k in enumerate(offsets):
        near = at + k
        inside = (near >= 0) & (near < len(bucket))
        inside[inside] = text_of[near[inside]] == text_of[at[inside]]
        out[row, inside] = bucket[near[inside]]
    return out


def _softmax(hidden: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Shares of each row's outputs, from hidden values within 1."""
    logits = hidden @ weights + bias
    # No output is beyond this; where it is small, it keeps the exponentials in range for all rows at once.
    bound = float((np.abs(weights).sum(axis=0) + np.abs(bias)).max())
    logits -= bound if bound < 40 else logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= (logits @ np.ones(logits.shape[1], logits.dtype))[:, None]
    return logits


def _forward(net: Params, context: np.ndarray, target: np.ndarray, s: LmSettings):
    total = net["words"][0][context[0]] + net["bias"]
    for k in range(1, len(context)):
        total += net["words"][k][context[k]]
    hidden = np.tanh(total)
    kind, member = target // s.members, target % s.members
    first = _softmax(hidden, net["to_class"], net["class_bias"])
    inner = np.tanh(hidden + net["of_class"][kind])
    second = _softmax(inner, net["to_member"], net["member_bias"])
    rows = np.arange(len(target))
    log_p = np.log(first[rows, kind] + 1e-30) + np.log(second[rows, member] + 1e-30)
    return log_p, hidden, inner, first, second, kind, member


def log_likelihoods(net: Params, context: np.ndarray, target: np.ndarray, s: LmSettings) -> np.ndarray:
    """The log-probability of each target given its context."""
    parts = [
        _forward(net, context[:, i : i + 8192], target[i : i + 8192], s)[0].astype(np.float64) for i in range(0, len(target), 8192)
    ]
    return np.concatenate(parts) if parts else np.zeros(0)


def _add(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different rows and the sums of their values."""
    # Short numbers are sorted by their digits.
    is_short = rows.dtype == np.int64 and len(rows) > 0 and rows.min() >= 0 and rows.max() < 1 << 16
    order = np.argsort(rows.astype(np.uint16) if is_short else rows, kind="stable")
    ordered = rows[order]
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    return ordered[starts], np.add.reduceat(values[order], starts, axis=0)


def train_step(net: Params, seen: Params, context: np.ndarray, target: np.ndarray, s: LmSettings) -> None:
    """One step of Adagrad on the mean log-likelihood of a batch; ``seen`` holds the squares so far."""
    _, hidden, inner, first, second, kind, member = _forward(net, context, target, s)
    n = len(target)
    rows = np.arange(n)
    first[rows, kind] -= 1
    second[rows, member] -= 1
    first /= n
    second /= n
    back_inner = (second @ net["to_member"].T) * (1 - inner**2)
    back = (first @ net["to_class"].T + back_inner) * (1 - hidden**2)
    steps: list[tuple[str, tuple, np.ndarray]] = [
        ("to_class", (), hidden.T @ first),
        ("class_bias", (), first.sum(axis=0)),
        ("to_member", (), inner.T @ second),
        ("member_bias", (), second.sum(axis=0)),
        ("bias", (), back.sum(axis=0)),
    ]
    at, total = _add(kind, back_inner)
    steps.append(("of_class", (at,), total))
    for k in range(len(context)):
        at, total = _add(context[k], back)
        steps.append(("words", (k, at), total))
    for name, place, gradient in steps:
        seen[name][place] += gradient**2
        net[name][place] -= s.rate * gradient / np.sqrt(seen[name][place])


def _hashed(batches: Iterator[pa.RecordBatch]):
    """Hashes of the words of each run of texts, the text of each word, and the number of words of each text."""
    codes = byte_codes(fold_case=True)
    for batch in batches:
        for chunk in chunks(batch.column("_text")):
            words = words_of(chunk)
            counts = np.diff(words.first)
            yield batch, chunk.first, word_hashes(chunk, words, codes), np.repeat(np.arange(len(counts)), counts), counts


def _bucket_of(hashes: np.ndarray, s: LmSettings) -> np.ndarray:
    return (hashes % np.uint64(s.buckets)).astype(np.int64)


def _buckets(batches: Iterator[pa.RecordBatch], s: LmSettings):
    """As _hashed, with the words' buckets."""
    for batch, first, hashes, text_of, counts in _hashed(batches):
        yield batch, first, _bucket_of(hashes, s), text_of, counts


def mask_of(hashes: np.ndarray, counts: np.ndarray, s: LmSettings) -> np.ndarray:
    """The mask each word is dealt to: by the word and its place in the text, so the same in every round."""
    place = np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts)
    dealt = mixed(hashes ^ mixed(place.astype(np.uint64) + np.uint64(s.seed)))
    return (dealt % np.uint64(s.masks)).astype(np.int64)


def _parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """All texts of one part after the other, whatever batches they come in."""
    number, held = None, []

    def whole() -> tuple[int, pa.RecordBatch]:
        return number, pa.RecordBatch.from_arrays([pa.concat_arrays([t.cast(pa.large_string()) for t in held])], ["_text"])

    for batch in batches:
        parts = batch.column("_part").to_numpy()
        starts = np.flatnonzero(np.r_[True, parts[1:] != parts[:-1]]) if len(parts) else []
        for start, end in zip(starts, [*starts[1:], len(parts)]):
            if parts[start] != number:
                if held:
                    yield whole()
                number, held = int(parts[start]), []
            held.append(batch.column("_text").slice(start, end - start))
    if held:
        yield whole()


def _trained(net: Params, number: int, s: LmSettings):
    """The network after one pass over each part, times the number of its targets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _parts_of(batches):
            own = {name: values.copy() for name, values in net.items()}
            seen = {name: np.full_like(values, 1e-6) for name, values in net.items()}
            targets = 0
            for _, _, hashes, text_of, counts in _hashed(iter([texts])):
                bucket, mask = _bucket_of(hashes, s), mask_of(hashes, counts, s)
                for own_mask in s.masks_of(number):
                    masked = np.flatnonzero(mask == own_mask)
                    for i in range(0, len(masked), s.batch):
                        at = masked[i : i + s.batch]
                        train_step(own, seen, contexts(bucket, text_of, at, s), bucket[at], s)
                    targets += len(masked)
            if targets:
                values = (flat(own).astype(np.float64) * targets).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int64()), pa.array([targets], pa.int64()), pa.array([values], pa.binary())], ["part", "targets", "total"]
                )

    return run


def training_parts(texts: DataFrame, s: LmSettings) -> DataFrame:
    """``(_text, _part)`` of ``texts (_rest, _text)``: documents dealt to parts and put in order by a hash of whole rows, stored once.

    The number of parts follows the bytes of all texts. How the table was cut into tasks plays no role, and copies under different ids are spread.
    A part is a run of rows of one file, which one task reads.
    """
    size = texts.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    parts = max(1, round(size / s.part_bytes))
    place = F.xxhash64("_text", F.to_json("_rest"))
    keyed = texts.where("_text IS NOT NULL").select("_text", place.alias("_place"), F.pmod(place, F.lit(parts)).alias("_part"))
    # More partitions than parts, so that few of them share one; beyond some thousands a partition holds several.
    dealt = keyed.repartition(min(4 * parts, 20_000), "_part").sortWithinPartitions("_part", "_place", "_text")
    return settle(dealt.select("_text", "_part"), "lm-parts")


def _sum_networks(rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, dtype=np.float64) for x in rows.sort_values("part")["total"])
    return pd.DataFrame({"part": [rows["part"].iloc[0] // FAN_IN], "targets": [rows["targets"].sum()], "total": [total.tobytes()]})


#: Networks that one task adds up.
FAN_IN = 16


def train_network(texts: DataFrame, s: LmSettings) -> Params:
    """Fit the network on all texts of ``training_parts``.

    Each part gives one network; these are
    added up in a tree, at most ``FAN_IN`` at a time, so one network comes to the driver, whose size is fixed. What is
    gathered grows with the number of parts, as the input does. No text at all gives the network as it starts.
    """
    net = new_network(s)
    highest = texts.agg(F.max("_part")).first()[0]
    for number in range(s.rounds if highest is not None else 0):
        trained = texts.mapInArrow(_trained(net, number, s), "part bigint, targets bigint, total binary")
        parts = highest + 1
        while parts > 1:
            # Sums of doubles depend on their order.
            key = F.floor(F.col("part") / FAN_IN)
            trained = trained.groupBy(key).applyInPandas(_sum_networks, "part bigint, targets bigint, total binary")
            parts = -(-parts // FAN_IN)
        rows = sorted(trained.collect(), key=lambda row: row["part"])
        if not rows:
            return net
        total = sum(np.frombuffer(row["total"], dtype=np.float64) for row in rows)
        net = unflat(total / sum(row["targets"] for row in rows), net)
    return net


#: Different words that a task counts before it hands them on.
COUNTED = 1 << 20


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of a partition with their numbers; a word comes again where there are more than are held."""
    words, numbers, held = [], [], 0

    def summed() -> tuple[np.ndarray, np.ndarray]:
        every = np.concatenate(words)
        return _add(every, np.concatenate(numbers)) if len(every) else (every, np.zeros(0, np.int64))

    def out(found: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found[0].view(np.int64)), pa.array(found[1])], ["word", "n"])

    for _, _, hashes, _, _ in _hashed(batches):
        word, n = np.unique(hashes, return_counts=True)
        words.append(word)
        numbers.append(n.astype(np.int64))
        held += len(word)
        if held > 2 * COUNTED:
            found = summed()
            words, numbers, held = [found[0]], [found[1]], len(found[0])
            if held > COUNTED:
                yield out(found)
                words, numbers, held = [], [], 0
    if held:
        yield out(summed())


class Vocabulary(NamedTuple):
    """Counts of all words: the commonest by hash, with logarithms; a table of the others; the logarithm of each bucket's."""

    words: np.ndarray
    log_counts: np.ndarray
    others: DataFrame
    bucket_logs: np.ndarray


def count_words(texts: DataFrame, s: LmSettings) -> Vocabulary:
    """The exact number of each word in all texts of ``_text``.

    The words that come to the driver are at most ``known``: those with at least so many occurrences, by a histogram.
    """
    counted = texts.mapInArrow(_counted, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counted = settle(counted, "lm-words")
    level = F.floor(F.log2("n") * 64)
    few, least = 0, 1 << 62
    for row in sorted(counted.groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.min("n").alias("least")).collect(), reverse=True):
        few += row["words"]
        if few > s.known:
            break
        least = row["least"]
    common = counted.where(F.col("n") >= least).toPandas()
    words = common["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(words)
    # The bucket of the hash as it is without a sign.
    low, modulus = F.col("word").bitwiseAND(F.lit((1 << 32) - 1)), F.lit(s.buckets)
    high = F.shiftrightunsigned("word", 32)
    bucket = F.pmod(F.pmod(high, modulus) * F.lit((1 << 32) % s.buckets) + low, modulus)
    sums = counted.groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n")).toPandas()
    bucket_logs = np.zeros(s.buckets)
    bucket_logs[sums["bucket"].to_numpy(np.int64)] = np.log(sums["n"].to_numpy(np.float64))
    return Vocabulary(words[order], np.log(common["n"].to_numpy(np.float64))[order], counted.where(F.col("n") < least), bucket_logs)


def _scored(net: Params, words: np.ndarray, log_counts: np.ndarray, bucket_logs: np.ndarray, s: LmSettings):
    """Scores without the counts of the words that are not among ``words``; these words, in ``_others``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first, hashes, text_of, counts in _hashed(batches):
            bucket = _bucket_of(hashes, s)
            # One place after another; a long text is scored in parts.
            log_p = np.zeros(len(bucket))
            for i in range(0, len(bucket), 1 << 16):
                at = np.arange(i, min(i + (1 << 16), len(bucket)))
                log_p[at] = log_likelihoods(net, contexts(bucket, text_of, at, s), bucket[at], s)
            different, back = np.unique(hashes, return_inverse=True)
            at = np.minimum(np.searchsorted(words, different), max(0, len(words) - 1))
            is_known = words[at] == different if len(words) else np.zeros(len(different), dtype=bool)
            logs = np.zeros(len(different))
            logs[is_known] = log_counts[at[is_known]]
            log_p += logs[back] - bucket_logs[bucket]
            other = np.flatnonzero(~is_known[back])
            ends = np.cumsum(np.bincount(text_of[other], minlength=len(counts)))
            others = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(hashes[other].view(np.int64)))
            # Without any word the sums would be whole numbers.
            score = np.bincount(text_of, weights=log_p, minlength=len(counts)).astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_rest").slice(first, len(counts)), pa.array(counts.astype(np.int64)), pa.array(score), others],
                ["_rest", "n_tokens", "score", "_others"],
            )

    return run


def score_documents(docs: DataFrame, text_col: str = "text", settings: LmSettings = LmSettings()) -> DataFrame:
    """The other columns of ``docs`` in struct ``_rest``, with ``n_tokens``, ``score`` and ``mean_score``.

    The network is trained on all documents; ``score`` is the sum over every word of a whole text of its log-probability
    given the words on both sides: the network's for the word's bucket, and the word's share of the bucket by the
    counts of all documents. Equal texts get equal scores up to rounding, and scores do not hang on how the table is partitioned. A null text counts as empty; an empty one has score 0 and no
    mean. An empty table gives an empty table.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    base = docs.select(F.struct(*(rest or [F.lit(1).alias("_")])).alias("_rest"), F.col(f"`{text_col}`").alias("_text"))
    texts = training_parts(base, settings)
    net, vocabulary = train_network(texts, settings), count_words(texts.select("_text"), settings)
    schema = T.StructType(
        [
            base.schema["_rest"],
            T.StructField("n_tokens", T.LongType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("_others", T.ArrayType(T.LongType())),
        ]
    )
    run = _scored(net, vocabulary.words, vocabulary.log_counts, vocabulary.bucket_logs, settings)
    scored = settle(base.mapInArrow(run, schema).withColumn("_row", F.monotonically_increasing_id()), "lm-scored")
    uncommon = scored.select("_row", F.explode("_others").alias("word")).join(vocabulary.others, "word")
    uncommon = uncommon.groupBy("_row").agg(F.sum(F.log("n")).alias("_more"))
    score = (F.col("score") + F.coalesce("_more", F.lit(0.0))).alias("score")
    whole = scored.join(uncommon, "_row", "left").select("_rest", "n_tokens", score)
    return whole.withColumn("mean_score", F.when(F.col("n_tokens") > 0, F.col("score") / F.col("n_tokens")))
