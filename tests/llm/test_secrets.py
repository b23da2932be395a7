import base64
import hashlib
import random
import re
import string

import pytest

from annolytics.llm.queries import QUERIES
from annolytics.llm.secret_scan import (
    Novelty,
    NoveltySettings,
    base_spans,
    find_secrets,
    identifier_dictionary,
    redacted,
    spans_of,
)

NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
VALUE = set(string.ascii_letters + string.digits + "+/_.=-")


def plain_assign(text):
    """Matches of the assignment pattern, walked a character at a time."""
    found, at = [], 0
    lower = "".join(c.lower() if c in string.ascii_uppercase else c for c in text)
    while at < len(text):
        end = None
        name = next((n for n in ("password", "passwd", "secret", "token", "api_key", "apikey") if lower.startswith(n, at)), None)
        if name:
            i = at + len(name)
            i += i < len(text) and text[i] in "\"'"
            while i < len(text) and text[i] == " ":
                i += 1
            if i < len(text) and text[i] in ":=":
                i += 1
                while i < len(text) and text[i] == " ":
                    i += 1
                i += i < len(text) and text[i] in "\"'"
                start = i
                while i < len(text) and text[i] in VALUE:
                    i += 1
                if i > start:
                    end = i
                    if i - start >= 6:
                        found.append((at, end))
        at = end or at + 1
    return found


def runs(text, allowed, least, prefix=""):
    """Maximal runs, from where the prefix first stands in them."""
    found, at = [], 0
    while at < len(text):
        end = at
        while end < len(text) and text[end] in allowed:
            end += 1
        start = text.find(prefix, at, end) if end > at else -1
        if start >= 0 and end - start >= least:
            found.append((start, end))
        at = max(end, at + 1)
    return found


def plain_base(text):
    text = text or ""
    kinds = [
        plain_assign(text),
        runs(text, set(string.ascii_uppercase + string.digits), 20, "AKIA"),
        runs(text, set("0123456789abcdef"), 24),
    ]
    spans = sorted((s, k, e) for k, found in enumerate(kinds) for s, e in found)
    names = ("assign", "access", "hex")
    digest = hashlib.sha256(",".join(f"{names[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()
    return [len(f) for f in kinds], digest, spans


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(5)
    pieces = [
        "password", "PassWord", "passwd", "secret", "TOKEN", "api_key", "apikey", "API_KEY", " ", "  ", ":", "=", "==", '"', "'", "abc", "abcdef", "AKIA", "AKIA" + "Z" * 16,
        "AKIA" + "9" * 15, "0" * 23, "deadbeef" * 3, "é", "日本", "K", "ſecret=abcdefg", "\n", "-", "x", "9f" * 20, ".", "/+_",
    ]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    return [*texts, None, "", " \n", "token=" + "a" * 200_000, "password = 'hunter2!' token: abcdefgh", "token=token=abcdef"]


def test_base_spans_against_a_walk(odd):
    for text in odd:
        counts, digest, spans = plain_base(text)
        got = base_spans(text or "")
        assert [(s.start, s.kind, s.end) for s in got] == spans


def test_every_document_of_the_smallest_tables(spark):
    """The query's base columns against the walk, and its other spans against the same measure taken text by text."""
    got = QUERIES["op11_primed_secret_scan"](spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    known = identifier_dictionary(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(r.doc_id for r in got) == sorted(texts)
    novelty = Novelty(known, NoveltySettings().level)
    for r in got:
        counts, digest, spans = plain_base(texts[r.doc_id])
        assert ([r.n_assign, r.n_access, r.n_hex], r.base_sha256) == (counts, digest)
        want = spans_of(texts[r.doc_id], novelty, NoveltySettings())
        names = ("assign", "access", "hex", "novel")
        assert r.spans == ",".join(f"{names[s.kind]}:{s.start}:{s.end}" for s in want)
        assert [(s.start, s.kind, s.end) for s in want if s.kind < 3] == spans


def prose(rng, n):
    words = "the of region session result value count order names table users items first other group number which".split()
    return " ".join(rng.choice(words) for _ in range(n))


def test_random_strings_are_new_and_identifiers_are_not(spark):
    rng = random.Random(2)
    lines = [f"def get_{a}_{b}(self): return self.{b}_{a} and {prose(rng, 12)}" for a in ("user", "session", "client") for b in ("name", "count", "identifier", "settings") for _ in range(40)]
    texts, planted = [], []
    for i in range(60):
        secret = base64.b64encode(rng.randbytes(rng.choice((15, 24, 48, 300)))).decode().rstrip("=")
        before = "\n".join(rng.sample(lines, 6)) + rng.choice(("\nAuthorization: Bearer ", "\nclient_auth -> ", '\ncredentials("', "\nwebhook https://"))
        texts.append((i, f"{before}{secret}\n{prose(rng, 40)}"))
        planted.append((len(before), len(before) + len(secret)))
    clean = [(100 + i, "\n".join(rng.sample(lines, 5)) + f"\nauth get_client_identifier session_settings_count {prose(rng, 30)} bearer getClientSettings") for i in range(60)]
    docs = spark.createDataFrame(texts + clean, "doc_id bigint, text string")
    found = {r["_rest"]["doc_id"]: r["_spans"] for r in find_secrets(docs).collect()}
    caught = sum(any(s.kind == "novel" and s.start <= a and s.end >= b for s in found[i]) for i, (a, b) in enumerate(planted))
    assert caught >= 54
    assert not any(found[i] for i, _ in clean)
    # Without a word of warning nothing is looked at.
    calm = spark.createDataFrame([(1, "see " + "Zk3" * 9 + "Qp7vX1 there")], "doc_id bigint, text string")
    assert find_secrets(calm).first()["_spans"] == []


def test_copies_do_not_make_a_secret_known(spark):
    text = "line one\nbearer Xkqwzjvbpfhd here\nline three"
    copied = spark.createDataFrame([(i, text) for i in range(3000)], "doc_id bigint, text string")
    assert identifier_dictionary(copied) == b""
    varied = spark.createDataFrame([(i, f"common words {i} stand in many lines") for i in range(200)], "doc_id bigint, text string")
    assert set(identifier_dictionary(varied).decode().split()) == {"common", "words", "stand", "many", "lines"}
    assert all(any(s.kind == "novel" for s in r["_spans"]) for r in find_secrets(copied).distinct().collect())


def test_odd_rows_and_columns(spark, documents, odd_texts):
    docs = documents(odd_texts).withColumnsRenamed({"source": "_spans", "n_chars": "kind"})
    rows = find_secrets(docs).collect()
    assert len(rows) == len(odd_texts) and all(r["_spans"] == [] for r in rows)
    assert set(rows[0]["_rest"].asDict()) == {"doc_id", "_spans", "kind"}
    assert find_secrets(docs.limit(0)).count() == 0
    only = docs.select("text").limit(3)
    assert find_secrets(only).count() == 3


def test_redacted_texts(spark):
    rows = [(1, "a token = " + "0f" * 20 + " b"), (2, None), (3, "é password: abcdefg"), (4, "plain"), (5, "AKIA" + "Z" * 16 + "token=abcdef")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in redacted(docs, mask="*").collect()}
    want = {}
    for i, text in rows:
        for s, _, e in reversed(merged(plain_base(text)[2])):
            text = text[:s] + "*" + text[e:]
        want[i] = text
    assert got == want and got[3] == "é *" and re.fullmatch(r"a \* b", got[1])


def merged(spans):
    out = []
    for s, k, e in spans:
        if out and s < out[-1][2]:
            out[-1] = (out[-1][0], k, max(e, out[-1][2]))
        else:
            out.append((s, k, e))
    return out
