from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from annolytics.llm.components import connected_components
from annolytics.llm.minmax_dedup import NearDupSettings, distinct_documents, min_max_signatures, near_duplicates
from annolytics.llm.words import byte_codes, chunks, shingle_hashes, word_hashes, words_of


def shingles(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {tuple(words)} if len(words) < k else {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute(rows, k, num, den):
    """Components over all pairs, by exact sets; rows with equal ids stay apart."""
    sets = [shingles(t, k) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
            group[root(b)] = root(a)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((doc, len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=repr)


def found(df):
    rows = df.collect()
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=repr), rows


@pytest.mark.parametrize("k, num", [(3, 85), (5, 80)])
def test_equals_brute_force_on_families_of_edited_copies(documents, k, num):
    rng = np.random.default_rng(k)
    rows = []
    for family in range(6):
        base = [f"w{x}" for x in rng.integers(0, 400, 60 + 40 * family)]
        for _ in range(25):
            text = list(base)
            for at in rng.integers(0, len(text), rng.integers(0, 6)):
                text[at] = f"E{rng.integers(0, 50)}"
            rows.append((len(rows) * 3 % 451, " ".join(text)))
    settings = NearDupSettings(shingle=k, numerator=num, denominator=100, block=8, block_shingles=900)
    got, all_rows = found(near_duplicates(documents(rows), settings=settings))
    assert got == brute(rows, k, num, 100)
    firsts = [r for r in all_rows if r.is_first]
    assert len(firsts) == len({r.component_id for r in all_rows})


def test_odd_texts(documents, odd_texts):
    got, rows = found(near_duplicates(documents(odd_texts), settings=NearDupSettings(3, 85, 100)))
    assert got == brute(odd_texts, 3, 85, 100)
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by_id[6].component_id == 5
    assert sum(r.is_first for r in rows if r.doc_id == 9) == 1
    assert all(r.is_first for r in rows if r.n_shingles == 0)


def test_empty_table_and_clashing_columns(documents, spark):
    empty = near_duplicates(documents([]))
    assert empty.columns == ["doc_id", "text", "source", "n_chars", "n_shingles", "component_id", "is_first"] and empty.count() == 0
    docs = documents([(1, "a b c d e f"), (2, "a b c d e f")])
    for names in (("_text", "_row"), ("is_first", "component"), ("component_id", "node")):
        clashing = docs.withColumnsRenamed(dict(zip(("source", "n_chars"), names)))
        assert {r.component_id for r in near_duplicates(clashing).collect()} == {1}
        (row,) = distinct_documents(clashing).collect()
        assert row.asDict() == {"doc_id": 1, "text": "a b c d e f", names[0]: "s", names[1]: 11}


def test_signature_values_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 1 << 64, 3000, dtype=np.uint64)
    a, b = pool[:2000], pool[500:2500]
    sig = min_max_signatures(np.concatenate([a, b]), np.array([2000, 2000]), 400, 1)
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.05


def test_words_and_shingles_equal_python_ones():
    texts = ["", None, " a  b\tc\n", "a b", "x" * 50 + " y", "é ü a b c d a b c", "\x0b\x0c"]
    codes = byte_codes(fold_case=True)
    seen = {}
    for chunk in chunks(pa.array(texts), chunk_bytes=8):
        words = words_of(chunk)
        hashes, counts = shingle_hashes(word_hashes(chunk, words, codes), words.first, 3)
        ends = np.cumsum(counts)
        for i in range(len(counts)):
            seen[chunk.first + i] = hashes[ends[i] - counts[i] : ends[i]].tolist()
    exact = [shingles(t, 3) for t in texts]
    assert [len(set(seen[i])) for i in range(len(texts))] == [len(s) for s in exact]
    assert set(seen[2]) & set(seen[5]) and not set(seen[3]) & set(seen[5])


def test_components_of_chains_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    frame = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r.node: r.component for r in connected_components(frame).collect()}
    want = dict.fromkeys(range(41), 0) | dict.fromkeys(range(100, 130), 100) | dict.fromkeys((200, 201, 202), 200)
    assert got == want
    assert connected_components(frame.where("a < 0")).count() == 0
