import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from annolytics.llm import line_quality as lq
from annolytics.llm.mixing import MixSettings, block_quotas, mix_sources, mixed_documents, source_targets, taken_words, word_count
from annolytics.llm.preference import forked_preferences
from annolytics.llm.packing import PackLimits, dot_product_bins, pack_documents, piece_columns, powers_of_two
from annolytics.llm.prefix import running_sums
from annolytics.llm.sharding import assign_shards, byte_size, write_shards
from annolytics.llm.token_ids import PieceIds, ended_ids
from annolytics.llm.token_scan import count_tokens, write_token_files
from annolytics.llm.words import chunks
from annolytics.session import scratch_path

WORDS = public_tokenizers.path("word_bpe_49k.json")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# ------------------------------------------------------------ sharding


def test_running_sums_of_a_hot_group_equal_a_plain_loop(spark):
    rows = [(None if i % 5 == 0 else "hot" if i % 3 else f"g{i % 7}", (i * 37) % 1009, i % 11) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, k bigint, v bigint")
    got = {(r.g, r.k, r.v): (r.before, r.position) for r in running_sums(df, "g", ["k", "v"], "v", "test").collect()}
    sums, counts = defaultdict(int), defaultdict(int)
    for g, k, v in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        last = (sums[g], counts[g])
        sums[g] += v
        counts[g] += 1
        if (g, k, v) in got and Counter(rows)[(g, k, v)] == 1:
            assert got[(g, k, v)] == last


def test_shards_are_contiguous_balanced_and_gapless(spark, documents, odd_texts):
    docs = documents(odd_texts + [(100 + i, "word " * (i % 50)) for i in range(900)])
    rows = docs.select("doc_id", byte_size(F.col("text")).alias("size"))
    placed = assign_shards(rows, ["doc_id"], "size", 5).collect()
    assert len(placed) == docs.count()
    last = -1
    for shard in range(5):
        own = sorted((r for r in placed if r.shard == shard), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        ids = [-1 if r.doc_id is None else r.doc_id for r in own]
        assert ids == sorted(ids) and (not ids or ids[0] >= last)
        last = ids[-1] if ids else last
    assert assign_shards(rows.where("size < 0"), ["doc_id"], "size", 5).count() == 0
    odd = rows.withColumnsRenamed({"doc_id": "slot", "size": "before"})
    assert assign_shards(odd, ["slot"], "before", 5).columns == ["before", "shard", "slot"]
    with pytest.raises(ValueError):
        assign_shards(rows, ["doc_id"], "size", 0)


def test_equal_bytes_where_rows_are_small(spark, tmp_path):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), (16 + F.col("id") % 90).alias("size"))
    assigned = assign_shards(rows, ["doc_id"], "size", 8)
    per = [r.s for r in assigned.groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(per) == 8 and max(per) - min(per) <= 2 * 105
    write_shards(rows, assigned, "doc_id", str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).groupBy("shard").count().count() == 8


# ------------------------------------------------------------ quality


def test_measures_equal_plain_python(odd_texts, sample):
    texts = [t for _, t in odd_texts] + [r.text for r in sample.collect()] + ["a b c a b c a b c d", "x x x x", "# $ a\n\na\na \n a", "a | b | c | d"]
    at = 0
    for _, found in lq.measure(pa.array(texts), lq.LineRules()):
        for i in range(len(found["kept"])):
            text = texts[at] or ""
            at += 1
            ws = words(text)
            grams = Counter(zip(ws, ws[1:], ws[2:]))
            covered = {j + d for j, g in enumerate(zip(ws, ws[1:], ws[2:])) if grams[g] > 1 for d in range(3)}
            lines = [line for line in text.split("\n") if words(line)]
            want = (len(ws), sum(map(len, ws)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
            assert tuple(int(found[c][i]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
            failing = {line for line in text.split("\n") if lq.line_fails(line, lq.LineRules())}
            assert failing == lq.failing_lines(text, lq.LineRules(), want[2] > 0)
            base = want[0] < 50 or 100 * want[4] > 50 * want[0]
            assert bool(found["base_failed"][i]) == base
            lost = sum(len("".join(words(line))) for line in text.split("\n") if line in failing)
            assert found["lost_chars"][i] == lost and bool(found["kept"][i]) == (not base and 100 * lost <= 40 * want[1])
    assert at == len(texts)


def test_rules_and_labels(spark):
    fails = lambda line: lq.line_fails(line, lq.LineRules())
    for line in (
        "Released under the MIT License.", "Distributed under the terms of X", "Alle Rechte vorbehalten", "Tous droits réservés.", "Todos los derechos reservados", "Lizenziert unter CC BY 4.0",
        "Cliquez ici", "A | B | C", "A > B", "Home » News", "x / y",
    ):
        assert fails(line), line
    # Few separators among many words are no navigation, and separators inside words are none.
    assert not fails("one two three four five six seven > eight nine | ten eleven twelve thirteen fourteen fifteen sixteen seventeen.")
    assert not fails("and/or") and not fails("It is said that a>b holds.")
    assert fails("Home | News | Sport | Contact") and fails("Please read our Privacy Policy.") and fails("Buy*** now### this$$$")
    assert fails("WE SHOUT ALL DAY LONG AND NEVER STOP") and fails("word " * 70) and fails("a! b! c! d! e! f! g! h!")
    assert not fails("A plain sentence, of a usual kind.") and not fails("") and not fails("Short heading")
    sf = "/root/testdata/sf0.01"
    labelled = spark.read.parquet(f"{sf}/labels.parquet").join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id")
    rows = lq.quality_lines(labelled.select("doc_id", "quality", "text"), with_text=False).where("NOT _found.base_failed").collect()
    good = [r._found.kept for r in rows if r._rest.quality == 1]
    bad = [r._found.kept for r in rows if r._rest.quality == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.05 * len(bad)


def test_cleaning_keeps_columns_of_any_name(spark, documents):
    text = "\n".join(["Home | News | Sport | Contact", *(f"Line {i} has words{i} of{i} its{i} own{i}." for i in range(20))])
    docs = documents([(1, text), (2, None), (3, "too short")]).withColumnRenamed("source", "kept")
    (row,) = lq.clean_documents(docs).collect()
    assert row.doc_id == 1 and row.kept == "s" and "Home" not in row.text and row.n_chars == len(row.text)


# ------------------------------------------------------------ mixing


def greedy_seats(votes, limits, n):
    seats = [0] * len(votes)
    for _ in range(n):
        best = max((i for i in range(len(votes)) if seats[i] < limits[i]), key=lambda i: (votes[i] / (2 * seats[i] + 1), -i), default=None)
        if best is None:
            break
        seats[best] += 1
    return seats


def test_targets_and_quotas_equal_slow_ones(spark):
    sizes = [("a", 1000), ("b", 50_000), ("c", 0), ("d", 7777), ("z", 31), (None, 12_345)]
    settings = MixSettings(block=64, shards=4)
    rows = block_quotas(source_targets(spark.createDataFrame(sizes, "source string, source_size bigint"), settings), settings).collect()
    weights, total = [5, 2, 1, 5, 2, 1], sum(s for _, s in sizes)
    low, high = 0.0, 10.0 * total
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(2 * s, w * level) for (_, s), w in zip(sizes, weights)) < 1.5 * total else (low, level)
    by_source = {r.source: r for r in rows}
    order = [by_source[s] for s, _ in sizes]
    for r, (_, s), w in zip(order, sizes, weights):
        assert r.target == pytest.approx(min(2 * s, w * high), abs=1e-6)
    votes = [r.target * r.blocks / r.source_size if r.source_size else 0 for r in order]
    assert [r.quota for r in order] == greedy_seats(votes, [2 * r.blocks for r in order], round(sum(votes)))
    per_shard = np.array([np.diff(r.bounds) for r in order])
    assert (per_shard.max(axis=1) - per_shard.min(axis=1) <= 1).all() and np.ptp(per_shard.sum(axis=0)) <= 1
    assert [r.bounds[-1] for r in order] == [r.quota for r in order]


def test_mix_takes_its_targets_and_repeats_itself(spark, documents, odd_texts):
    rows = odd_texts + [(1000 + i, " ".join(f"t{j}" for j in range(i % 90)), None if i % 4 == 0 else f"s{i % 3}") for i in range(400)]
    docs = documents(rows)
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    settings = MixSettings(block=16, shards=3)
    run = lambda: sorted(map(tuple, mix_sources(sized, "source", "size", ["doc_id"], settings).withColumn("taken", taken_words()).select("doc_id", "source", "size", "source_size", "target", "taken").collect()), key=repr)
    first = run()
    assert first == run() and len(first) == len(rows)
    taken, target = Counter(), {}
    for _, source, size, _, goal, got in first:
        assert 0 <= got <= 2 * size
        taken[source] += got
        target[source] = goal
    for source, goal in target.items():
        assert abs(taken[source] - goal) <= 32
    mixed = mixed_documents(docs, settings=MixSettings(block=16, shards=1))
    assert mixed.columns == docs.columns
    texts = {(r.doc_id, r.source): r.text for r in docs.collect()}
    pieces = mixed.collect()
    assert all(" ".join(words(r.text)) in " ".join(words(texts[(r.doc_id, r.source)])) and r.n_chars == len(r.text) for r in pieces if r.doc_id not in (None, 9))
    assert abs(sum(len(words(r.text)) for r in pieces) - sum(target.values())) <= 32 * len(target)
    assert mix_sources(sized.where("size < 0"), "source", "size", ["doc_id"]).count() == 0
    odd = sized.withColumnsRenamed({"doc_id": "target", "size": "before"}).withColumn("bounds", F.lit(1))
    assert mix_sources(odd, "source", "before", ["target"]).columns == ["source", "before", "bounds", "source_size", "target", "spans"]


# ------------------------------------------------------------ tokens and packing


def test_ids_equal_those_of_the_whole_tokenizer(odd_texts, sample):
    tokenizer = Tokenizer.from_file(WORDS)
    texts = [t or "" for _, t in odd_texts] + [r.text for r in sample.collect()]
    texts += ["I'LL don't 's''re ΣΑΣ Σ İstanbul KK ﬁ 12½ ² ª µ é́ ÀÉß×÷ÿ ŸŒ \x85 a b A1B22 x<|startoftext|>y"]
    pieces, at = PieceIds(WORDS), 0
    for chunk in chunks(pa.array(texts), chunk_bytes=5000):
        ids, counts = ended_ids(chunk, pieces, 1)
        for own in np.split(ids, np.cumsum(counts)[:-1]):
            assert own.tolist() == [*tokenizer.encode(texts[at], add_special_tokens=False).ids, 1]
            at += 1
    assert at == len(texts)


def test_a_text_may_have_more_distinct_pieces_than_are_held():
    tokenizer = Tokenizer.from_file(WORDS)
    texts = [" ".join(f"{w}{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}q" for i in range(n)) for w, n in (("x", 650), ("y", 31), ("", 0), ("É", 600))]
    pieces = PieceIds(WORDS, held=40)
    for chunk in chunks(pa.array(texts + texts[:1]), chunk_bytes=4000):
        ids, counts = ended_ids(chunk, pieces, 1)
        for text, own in zip((texts + texts[:1])[chunk.first :], np.split(ids, np.cumsum(counts)[:-1])):
            assert own.tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        assert pieces.known <= 80 <= len(pieces.table.keys) // 2


def test_packing_is_a_partition_of_all_ids(documents, odd_texts, sample):
    docs = documents(odd_texts).select("doc_id", "text", F.lit(1).alias("start")).union(sample.select("doc_id", "text", F.lit(2)))
    limits = PackLimits(tokens=512, segments=9, loss_tokens=512, block=64)
    packed = pack_documents(docs, WORDS, 1, limits=limits).select("_rest.*", "ids", *[c.alias("p_" + n) for c, n in zip(piece_columns(), ("start", "length", "crc", "doc_tokens", "sequence", "offset"))])
    rows = packed.collect()
    tokenizer = Tokenizer.from_file(WORDS)
    want = Counter()
    for r in docs.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        want[(r.doc_id, len(ids))] += len(ids)
    got = Counter()
    for r in rows:
        got[(r.doc_id, r.p_doc_tokens)] += r.p_length
        assert len(r.ids) == 4 * r.p_length and zlib.crc32(bytes(r.ids)) == r.p_crc
    assert got == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.p_sequence].append((r.p_offset, r.p_length))
    padding = 0
    for parts in sequences.values():
        parts.sort()
        total = sum(n for _, n in parts)
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
        assert total <= 512 and len(parts) <= 9
        padding += 0 if not total & (total - 1) else 512 - total
    assert padding <= 0.03 * sum(want.values())
    assert pack_documents(documents([]), WORDS, 1).count() == 0


def plain_loss(tokenizer, text, ranges):
    """Which ids bear loss, by the tokenizer's own offsets: those whose word or piece of one begins in a range."""
    encoded = tokenizer.encode(text, add_special_tokens=False)
    bears = lambda i: any(r and r[0] is not None and r[1] is not None and r[0] <= i < r[1] for r in ranges or [])
    starts, whole = [], 0
    for word, (start, _) in zip(encoded.word_ids, encoded.offsets):
        if word != whole or not starts:
            whole, first = word, start
        starts.append(first)
    return [bears(i) for i in starts] + [bool(text) and bears(len(text) - 1)]


@pytest.mark.parametrize(("tokens", "segments", "loss"), [(64, 9, 20), (64, 3, 64), (128, 50, 7), (32, 9, 1)])
def test_every_limit_holds_for_masked_conversations(spark, tokens, segments, loss):
    """Conversations with op5's masks, and texts with odd ranges, under a loss limit below that of tokens."""
    rng = np.random.default_rng(6)
    words = "the quick brown fox said hello again and then more über 日本 end".split()
    talk = [(c, t, "user" if t % 2 == 0 else "assistant", " ".join(rng.choice(words, int(rng.integers(1, 40))))) for c in range(60) for t in range(4)]
    turns = spark.createDataFrame(talk, "conv_id bigint, turn bigint, role string, text string")
    made = forked_preferences(turns).select(F.col("pair_id").alias("doc_id"), F.concat("prompt", "chosen_text").alias("text"), F.length("prompt").alias("n"), "chosen_mask")
    shifted = F.transform("chosen_mask", lambda m: F.struct((m["start"] + F.col("n")).alias("start"), (m["end"] + F.col("n")).alias("end")))
    ranges = made.select("doc_id", "text", shifted.alias("mask"))
    odd = [(1000, None, [(0, 5)]), (1001, "", [(0, 1)]), (1002, "one two", None), (1003, "one two", []), (1004, "all of it " * 40, [(-3, 9999)]), (1005, "é one é two", [(2, 5), (3, 7), (9, 2), (None, 4)]), (1006, "no loss here " * 60, [None])]
    docs = ranges.union(spark.createDataFrame(odd, "doc_id bigint, text string, mask array<struct<start: int, end: int>>")).repartition(3)
    limits = PackLimits(tokens=tokens, segments=segments, loss_tokens=loss, block=32)
    packed = pack_documents(docs, WORDS, 1, limits=limits, loss_col="mask").collect()
    tokenizer = Tokenizer.from_file(WORDS)
    given = {r.doc_id: (r.text or "", [m and (m.start, m.end) for m in r["mask"] or []]) for r in docs.collect()}
    flags = {i: plain_loss(tokenizer, *x) for i, x in given.items()}
    seen, sequences = defaultdict(int), defaultdict(list)
    for r in packed:
        own = flags[r._rest.doc_id][r.start : r.start + r.length]
        assert r.loss_tokens == sum(own) and len(own) == r.length
        seen[r._rest.doc_id] += r.length
        sequences[r.sequence_id].append((r.length, r.loss_tokens))
    assert seen == {i: len(f) for i, f in flags.items()}
    for parts in sequences.values():
        assert sum(n for n, _ in parts) <= tokens and len(parts) <= segments and sum(x for _, x in parts) <= loss
    assert sum(map(sum, flags.values())) > 500


def test_loss_limit_cuts_plain_documents(documents):
    docs = documents([(i, "word " * 300) for i in range(20)])
    packed = pack_documents(docs, WORDS, 1, limits=PackLimits(tokens=256, segments=99, loss_tokens=100)).collect()
    held = Counter()
    for r in packed:
        held[r.sequence_id] += r.loss_tokens
        assert r.loss_tokens == r.length
    assert max(held.values()) <= 100 and sum(held.values()) == 20 * 301


def test_bins_respect_every_limit():
    rng = np.random.default_rng(1)
    demands = np.stack([rng.integers(1, 900, 500), np.ones(500), rng.integers(0, 400, 500)], axis=1).astype(float)
    capacity = np.array([1000.0, 6, 450])
    bins = dot_product_bins(demands, capacity)
    assert sorted(np.concatenate(bins)) == list(range(500))
    assert all((demands[b].sum(axis=0) <= capacity).all() for b in bins)
    assert len(bins) <= 1.12 * (demands / capacity).sum(axis=0).max() + 1
    assert powers_of_two(1300) == [1024, 256, 16, 4] and powers_of_two(0) == []
    with pytest.raises(ValueError):
        dot_product_bins(np.array([[2000.0, 1, 0]]), capacity)


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_separator_scan_equals_tokenizer(spark, documents, odd_texts, block):
    docs = documents(odd_texts[:8] + odd_texts[-2:]).withColumnRenamed("source", "path")
    if block > 1:
        docs = documents(odd_texts).withColumnRenamed("source", "path")
    files, listed = write_token_files(docs, scratch_path(spark, "t"), WORDS, 49407, file_bytes=4000)
    counted = count_tokens(spark, files, 49407, block_tokens=max(block, 1 if block == 1 else 64))
    got = Counter((r._rest.doc_id, r.tokens) for r in listed.join(counted.where("ended"), ["path", "ordinal"]).collect())
    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.encode_special_tokens = True
    assert got == Counter((r.doc_id, len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())


def test_scan_of_files_without_a_last_separator(spark, tmp_path):
    ids = np.array([5, 6, 9, 9, 1, 2, 3, 4], dtype="<u2")
    (tmp_path / "a").write_bytes(ids.tobytes())
    (tmp_path / "b").write_bytes(b"")
    files = spark.createDataFrame([(str(tmp_path / "a"), 16), (str(tmp_path / "b"), 0)], "path string, bytes bigint")
    for block in (1, 3, 100):
        rows = sorted((r.ordinal, r.first, r.tokens, r.ended) for r in count_tokens(spark, files, 9, block).collect())
        assert rows == [(0, 0, 2, True), (1, 3, 0, True), (2, 4, 4, False)]
