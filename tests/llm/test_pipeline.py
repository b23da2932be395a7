"""The queries against their SQL, and every stage of the pipeline against a plain version of it."""

import re
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from annolytics.llm.queries import ORACLES, QUERIES
from annolytics.session import settle
from tools.check_oracle import rows_of

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in SF.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, str(SF))
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = db.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert got == rows_of(columns, result.fetchall())


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text):
    ws = [w.encode().lower() for w in words(text)]
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(settle(stage(spark, tables[-1], str(SF)), name))
    raw, clean, distinct, mixed, packed = ([r.asDict() for r in t.collect()] for t in tables)
    assert all(t.columns == docs.columns for t in tables[:4])
    # Quality: what is left is left whole, line by line, and long enough.
    texts = {r["doc_id"]: r["text"] for r in raw}
    assert 0 < len(clean) < len(raw)
    for r in clean:
        lines = texts[r["doc_id"]].split("\n")
        assert len(words(texts[r["doc_id"]])) >= 50 and all(line in lines for line in r["text"].split("\n"))
    # Near-dedup: one of each group, by all pairs.
    sets = {r["doc_id"]: shingles(r["text"]) for r in clean}
    group = {i: i for i in sets}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                group[max(root(a), root(b))] = min(root(a), root(b))
    assert sorted(r["doc_id"] for r in distinct) == sorted({root(i) for i in ids})
    # Mix: runs of words of the documents, none more than twice, half as much again in all.
    size = {r["doc_id"]: len(words(r["text"])) for r in distinct}
    taken = Counter()
    for r in mixed:
        taken[r["doc_id"]] += len(words(r["text"]))
    assert all(n <= 2 * size[i] for i, n in taken.items())
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) <= 128 * len({r["source"] for r in distinct})
    # Packing: all ids of every row, once.
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in mixed:
        want[r["doc_id"]] += len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1
    got, sequences = Counter(), defaultdict(int)
    for r in packed:
        got[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]] += r["length"]
    assert got == want and max(sequences.values()) <= 2048
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "mix", "pack"]
    assert corpus_pipeline.run(spark, str(SF)).count() == len(packed)
