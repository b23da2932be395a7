import gzip
import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from annolytics.llm import masked_lm as lm
from annolytics.llm import rp_forest as rf
from annolytics.llm.preference import forked_preferences, format_preferences, pair_conversations
from annolytics.llm.warc import members_in, page_id_of, read_warc, record_member, write_warc
from annolytics.session import scratch_path

# ------------------------------------------------------------ archives


def test_every_split_size_reads_each_record_once(spark):
    inner = gzip.compress(b"WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n").decode("latin-1")
    rows = [(1, "http://a/ü", "x" * 1500), (2, "http://b", "x" * 1500), (3, None, "x" * 999), (4, "u", "x" * 999), (None, "u", "x" * 1500), (5, "u v\n", None)]
    rows += [(5, "u", ""), (6, "u", inner * 40), (7, "u", "é" * 600), (7, "u", "é" * 600), (8, "u", "long " * 200_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    files = write_warc(pages, scratch_path(spark, "w"), file_bytes=2000)
    for split in (97, 4096, 1 << 20):
        records = read_warc(spark, files, split).where("record_type <> 'warcinfo'").collect()
        assert len(records) == len({r.record_id for r in records}) == len(rows)
    found = spark.createDataFrame(records)
    got = sorted(
        ((r.i, r.record_type, r.http_length, r.payload_digest, r.refers) for r in found.select(page_id_of(F.col("record_id")).alias("i"), "*", page_id_of(F.col("refers_to")).alias("refers")).collect()), key=repr
    )
    payloads = [(i, (h or "").encode()) for i, _, h in rows]
    want = []
    revisited = set()
    for i, p in payloads:
        same = [j for j, q in payloads if q == p]
        last = max(j for j in same if j is not None)
        response = len(p) < 1000 or len(same) == 1 or (i == last and (last, p) not in revisited)
        if i == last:
            revisited.add((last, p))
        want.append((i, "response" if response else "revisit", len(p), hashlib.sha1(p).hexdigest(), None if response else last))
    assert got == sorted(want, key=repr)
    assert all(hashlib.sha1(bytes(r.payload)).hexdigest() == r.payload_digest for r in records if r.record_type == "response")
    assert read_warc(spark, write_warc(pages.where("page_id > 99"), scratch_path(spark, "w"))).count() == 0


def test_search_begins_again_after_damage(tmp_path):
    one = lambda n: record_member([("WARC-Type", "resource"), ("WARC-Record-ID", f"<{n}>")], b"block %d" % n)
    embedded = gzip.compress(b"no record")
    path = tmp_path / "x.warc.gz"
    path.write_bytes(one(1) + one(2)[:-20] + one(3) + b"junk" + one(4) + embedded + one(5))
    data = path.read_bytes()
    with pa.OSFile(str(path)) as file:
        assert [m.headers["warc-record-id"] for m in members_in(file, 0, len(data))][0] == "<1>"
        whole = [m.headers["warc-record-id"] for m in members_in(file, 0, len(data))]
        assert "<4>" in whole and whole[-1] == "<5>"


# ------------------------------------------------------------ neighbours


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((3000, 24)).astype(np.float32)
    base[500:900] = base[500]
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(5000, None), (5020, [0.0] * 24), (5040, [float("nan")] * 24), (5060, [None] * 24), (None, base[0].tolist()), (5080, [float("inf")] * 24)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("query", F.lit(1))
    got = rf.nearest(frame, "vec_id", "embedding", F.col("id") % 20 == 0, rf.ForestSettings(trees=8, sample=1024, leaf=32, probes=40, part=300)).collect()
    assert len(got) == 150 * 20
    vectors = base.astype(np.float64)
    hits = 0
    for q in range(0, 3000, 20):
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 21))
        score = vectors @ vectors[q]
        score[q] = -np.inf
        for r in own:
            assert r.score == pytest.approx(float(vectors[r.vec_id] @ vectors[q]), abs=1e-12)
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        hits += len({r.vec_id for r in own} & set(np.lexsort((np.arange(3000), -np.round(score, 12)))[:20].tolist()))
    assert hits >= 0.9 * len(got)
    # The copies: the twenty smallest ids but one's own.
    assert [r.vec_id for r in sorted((r for r in got if r.query_id == 800), key=lambda r: r.rank)] == list(range(500, 520))


def test_a_repeated_row_leaves_room_for_other_ids(spark):
    rows = [(1, [1.0, 0.0])] * 30 + [(i, [1.0, 0.0]) for i in range(2, 31)] + [(0, [2.0, 0.1])] + [(i, [0.5, 0.1 * i]) for i in range(31, 34)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(5)
    got = rf.nearest(frame, "vec_id", "embedding", F.col("id").isin(0, 1)).collect()
    near = {q: [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in (0, 1)}
    assert near == {0: list(range(1, 21)), 1: [0, *range(2, 21)]}


def test_few_and_no_vectors(spark):
    frame = spark.createDataFrame([(20, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0])], "vec_id bigint, embedding array<double>")
    rows = sorted((r.rank, r.vec_id, r.score) for r in rf.nearest(frame, "vec_id", "embedding", F.col("id") % 20 == 0).collect())
    assert rows == [(1, 1, 1.0), (2, 2, 1.0)]
    assert rf.nearest(frame.where("vec_id < 0"), "vec_id", "embedding", F.col("id") % 20 == 0).count() == 0
    assert rf.nearest(frame.where("vec_id < 9"), "vec_id", "embedding", F.col("id") % 20 == 0).count() == 0


# ------------------------------------------------------------ scores


def test_gradient_step_raises_the_likelihood_and_equals_differences():
    s = lm.LmSettings(classes=4, members=5, hidden=3)
    net = {k: v.astype(np.float64) for k, v in lm.new_network(s).items()}
    rng = np.random.default_rng(0)
    context, target = rng.integers(0, 21, (4, 50)), rng.integers(0, 20, 50)
    mean = lambda n: lm.log_likelihoods(n, context, target, s).mean()
    moved = {k: v.copy() for k, v in net.items()}
    lm.train_step(moved, {k: np.full_like(v, 1e6) for k, v in net.items()}, context, target, s)
    for name in net:
        place = np.unravel_index(np.argmax(np.abs(moved[name] - net[name])), net[name].shape)
        nudged = {k: v.copy() for k, v in net.items()}
        nudged[name][place] += 1e-5
        slope = (mean(nudged) - mean(net)) / 1e-5
        assert (moved[name] - net[name])[place] == pytest.approx(s.rate * slope / 1e3, rel=1e-3)


def test_scores_tell_held_out_order_from_noise(spark, documents, odd_texts):
    rng = np.random.default_rng(4)
    cycle = [f"c{i}" for i in range(30)]
    ordered = [(i, " ".join(cycle[(i + j) % 30] for j in range(80))) for i in range(300)]
    held_out = [(1000 + i, " ".join(cycle[(i * 7 + j) % 30] for j in range(33))) for i in range(20)]
    noise = [(2000 + i, " ".join(rng.permutation(cycle)[:29])) for i in range(20)]
    settings = lm.LmSettings(mask_percent=50)
    net = lm.train_network(_parts(documents(ordered), settings), settings)
    score = lambda rows: np.mean([float(np.mean(r)) for r in _scores(net, settings, rows)])
    assert score(held_out) > score(noise) + 1 > -7.6
    rows = {(r._rest.doc_id, r.n_tokens): r for r in lm.score_documents(documents(ordered[:40] + odd_texts)).collect()}
    assert rows[(1, 0)].score == 0 and rows[(1, 0)].mean_score is None and rows[(5, 2)].score == pytest.approx(rows[(6, 2)].score, rel=1e-5)
    assert lm.score_documents(documents([])).count() == 0


def _parts(docs, settings):
    rest = F.struct(*[c for c in docs.columns if c != "text"]).alias("_rest")
    return lm.training_parts(docs.select(rest, F.col("text").alias("_text")), settings)


def test_scores_do_not_hang_on_partitions(spark, sample):
    """Several parts, over one task and over many, and with the rows in another order."""
    settings = lm.LmSettings(part_bytes=60_000)
    docs = sample.select("doc_id", "text")
    runs = []
    for cut in (docs.coalesce(1), docs.repartition(16), docs.orderBy(F.desc("doc_id")).repartition(5, "doc_id")):
        runs.append({r._rest.doc_id: r.score for r in lm.score_documents(cut, settings=settings).collect()})
    assert len(runs[0]) == docs.count()
    for other in runs[1:]:
        assert all(other[i] == pytest.approx(score, rel=1e-9) for i, score in runs[0].items())


def _scores(net, settings, rows):
    batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in rows])], ["_text"])
    for _, _, bucket, text_of, counts in lm._buckets([batch], settings):
        log_p = lm.log_likelihoods(net, lm.contexts(bucket, text_of, np.arange(len(bucket)), settings), bucket, settings)
        yield from (log_p[text_of == i] for i in range(len(counts)))


@pytest.mark.parametrize("known", [lm.LmSettings().known, 40, 0])
def test_a_word_is_not_the_frequent_word_it_collides_with(spark, documents, known):
    settings = lm.LmSettings(known=known)
    frame = pa.RecordBatch.from_arrays([pa.array([f"w{i}" for i in range(4000)])], ["_text"])
    bucket = np.concatenate([b for _, _, b, _, _ in lm._buckets([frame], settings)])
    junk = next(i for i in range(1, 4000) if bucket[i] == bucket[0])
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(f"w{j}" for j in (rng.zipf(1.3, 60) - 1) % 3000 if j != junk)) for i in range(200)] + [(200, None)]
    rows += [(1000, "W0 w5 w0"), (1001, f"w0 w5 w{junk}")]
    got = {r._rest.doc_id: r for r in lm.score_documents(documents(rows), settings=settings).collect()}
    words = Counter(w for _, t in rows for w in (t or "").lower().split())
    of_bucket = Counter()
    for w, n in words.items():
        of_bucket[bucket[int(w[1:])]] += n
    texts = _parts(documents(rows), settings)
    net = lm.train_network(texts, settings)
    assert len(lm.count_words(texts.select("_text"), settings).words) <= known
    for (i, text), log_p in zip(rows, _scores(net, settings, rows)):
        within = [np.log(words[w] / of_bucket[bucket[int(w[1:])]]) for w in (text or "").lower().split()]
        assert got[i].score == pytest.approx(float(log_p.sum() + sum(within)), rel=1e-4)
    assert got[1000].score - got[1001].score == pytest.approx(np.log(words["w0"]), rel=1e-4)


@pytest.mark.parametrize(("rounds", "mask_percent"), [(2, 15), (2, 50), (1, 15), (3, 100)])
def test_every_word_is_a_target(rounds, mask_percent):
    settings = lm.LmSettings(rounds=rounds, mask_percent=mask_percent)
    rng = np.random.default_rng(6)
    texts = pa.array([" ".join(f"w{j}" for j in rng.integers(0, 900, n)) for n in (0, 1, 500, 3000)])
    batch = pa.RecordBatch.from_arrays([texts], ["_text"])
    dealt = pa.RecordBatch.from_arrays([texts, pa.array([0] * len(texts))], ["_text", "_part"])
    masks = [m for n in range(rounds) for m in settings.masks_of(n)]
    assert set(masks) == set(range(settings.masks))
    targets = sum(b.column("targets")[0].as_py() for n in range(rounds) for b in lm._trained(lm.new_network(settings), n, settings)([dealt]))
    assert targets == 3501 * (rounds if mask_percent == 100 else 1)
    for _, _, hashes, _, counts in lm._hashed([batch]):
        share = np.bincount(lm.mask_of(hashes, counts, settings), minlength=settings.masks) / len(hashes)
        assert (share < 1.3 / settings.masks).all()


# ------------------------------------------------------------ conversations


def test_longest_prefix_and_masks(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "a"), (1, 3, "assistant", "B!")]
    rows += [(2, 0, "user", "hi"), (2, 1, "assistant", "yes"), (2, 2, "user", "a"), (2, 3, "assistant", None), (2, 3, None, "z")]
    rows += [(3, 5, "user", "hi"), (None, 0, "user", "lost"), (4, 0, "system", "x" * 50_000), (4, 1, "assistant", "")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("chosen", F.lit(0))
    pairs = spark.createDataFrame([(0, 1, 2), (1, 1, 3), (2, 1, 1), (3, 4, 99)], "pair_id bigint, chosen bigint, rejected bigint")
    got = {r.pair_id: r for r in format_preferences(turns, pairs).collect()}
    a = got[0]
    assert a.prompt == "<|user|>\nhi\n<|assistant|>\nyes\n<|user|>\na\n" and a.prompt_turns == 3
    assert a.chosen_text == "<|assistant|>\nB!\n" and [a.chosen_text[m.start : m.end] for m in a.chosen_mask] == ["B!\n"]
    assert a.rejected_text == "<||>\nz\n<|assistant|>\n\n" and [a.rejected_text[m.start : m.end] for m in a.rejected_mask] == ["\n"]
    assert got[1].prompt_turns == 1 and got[1].rejected_text == "" and got[1].chosen_turns == 3
    assert got[2].prompt_turns == 4 and got[2].chosen_text == got[2].rejected_text == ""
    assert got[3].prompt == "" and got[3].rejected_turns == 0 and got[3].chosen_turns == 2


def test_pairs_link_all_conversations_in_a_line(spark):
    rows = [(i, 0, "user", "hot" if i % 3 else f"o{i % 40}") for i in range(600)] + [(i, 1, "assistant", "x" * (i % 17)) for i in range(600)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    pairs = pair_conversations(turns).collect()
    assert len(pairs) == 599 and len({r.pair_id for r in pairs}) == 599
    assert {r.chosen for r in pairs} | {r.rejected for r in pairs} == set(range(600))
    assert all((r.chosen % 17, -r.chosen) > (r.rejected % 17, -r.rejected) for r in pairs)
    hot = [r for r in pairs if r.chosen % 3 and r.rejected % 3]
    assert len(hot) == 399
    assert pair_conversations(turns.where("conv_id < 0")).count() == 0


def plain_forks(rows):
    """Chosen and rejected turns of each example, from lists."""
    talks = {}
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        talks.setdefault(conv, []).append((role, text))
    forks = {c: max((i for i, t in enumerate(ts) if t[0] == "assistant"), default=None) for c, ts in talks.items()}
    order = sorted((c for c in talks if forks[c] is not None), key=lambda c: hashlib.md5(str(c).encode()).hexdigest())
    out = {}
    for c, other in zip(order, order[1:]):
        rejected = talks[c][: forks[c]] + talks[other][forks[other] :]
        if forks[c] and rejected != talks[c]:
            out[c] = (other, talks[c], rejected)
    return out


@pytest.mark.parametrize("text_ids", [False, True])
def test_forks_share_a_prompt(spark, text_ids):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"{c} {t}" if c % 3 else f"hot {t}") for c in range(150) for t in range(1 + c % 6)]
    rows += [(900, 0, "assistant", "alone"), (901, 0, None, None), (901, 1, "assistant", None), (902, None, "user", ""), (902, 3, "assistant", "x"), (902, 3, "assistant", "x")]
    rows = [(f"id {c}" if text_ids else c, *r) for c, *r in rows] + [(None, 0, "user", "nobody")]
    turns = spark.createDataFrame(rows, f"conv_id {'string' if text_ids else 'bigint'}, turn bigint, role string, text string")
    got = {r.pair_id: r for r in forked_preferences(turns.repartition(7)).collect()}
    want = plain_forks(rows)
    assert set(got) == set(want) and len(want) > 100
    show = lambda ts: "".join(f"<|{role or ''}|>\n{text or ''}\n" for role, text in ts)
    for c, (other, chosen, rejected) in want.items():
        r = got[c]
        k = next((i for i, (a, b) in enumerate(zip(chosen, rejected)) if a != b), min(len(chosen), len(rejected)))
        assert (r.chosen, r.rejected, r.prompt_turns, r.prompt) == (c, other, k, show(chosen[:k]))
        assert (r.chosen_text, r.rejected_text) == (show(chosen[k:]), show(rejected[k:])) and k > 0
        for text, mask, part in ((r.chosen_text, r.chosen_mask, chosen[k:]), (r.rejected_text, r.rejected_mask, rejected[k:])):
            assert [text[m.start : m.end] for m in mask] == [f"{t or ''}\n" for role, t in part if role == "assistant"]


def test_most_examples_of_the_table_have_all_parts(spark):
    examples = forked_preferences(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet"))
    whole = examples.where("prompt_turns > 0 AND chosen_turns > 0 AND rejected_turns > 0").count()
    assert whole >= 0.9 * examples.count() > 0
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert forked_preferences(empty).count() == 0 and format_preferences(empty, spark.createDataFrame([], "pair_id bigint, chosen bigint, rejected bigint")).count() == 0


def test_vectors_of_unequal_length_are_an_error(spark):
    rows = spark.createDataFrame([(20, [1.0, 2.0, 3.0]), (1, [1.0, 2.0]), (2, [4.0])], "vec_id bigint, embedding array<float>")
    with pytest.raises(ValueError, match="from 1 to 3 components"):
        rf.nearest(rows, "vec_id", "embedding", F.col("id") % 20 == 0)
