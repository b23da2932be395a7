import hashlib
import zlib
from collections import defaultdict

import pytest

from annolytics.llm.burst_trie import TrieSettings, prefix_trie, shared_turns, turn_sequences
from annolytics.llm.trie_queries import rebuilt

TURNS = "conv_id bigint, turn bigint, role string, text string"


def plain_trie(convs):
    """Nodes of ``{conv: [(role, text)]}``, from every prefix of every conversation."""
    members, ends = defaultdict(list), defaultdict(list)
    for conv, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
        ends[tuple(turns)].append(conv)
    children = defaultdict(int)
    for prefix in members:
        if prefix:
            children[prefix[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for prefix, found in members.items():
        size = len(prefix[-1][1].encode()) if prefix else 0
        for d in range(len(prefix) + 1):
            leaves[prefix[:d]] += prefix not in children
            saved[prefix[:d]] += (len(found) - 1) * size
    return sorted(
        (
            min(found), len(prefix), min(members[prefix[:-1]]) if prefix else -1, len(found), children[prefix], leaves[prefix], saved[prefix],
            hashlib.sha256(",".join(map(str, sorted(ends[prefix]))).encode()).hexdigest(),
        )
        for prefix, found in members.items()
    )


def plain_sequences(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    return {c: [(r, t) for _, r, t in sorted(turns, key=lambda x: x[:2])] for c, turns in convs.items()}


def plain_rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def nodes(df):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.select(*columns).collect())


def families():
    """Copies, a hot opening of many turns, chains in which each conversation goes on a little further, and short ones."""
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t} é") for c in range(120) for t in range(12)]
    rows += [(c, t, "system", f"hot {t}" if t < 6 else f"own {c % 40} {t}") for c in range(200, 400) for t in range(9)]
    rows += [(c, t, "user", f"chain {t}") for c in range(500, 540) for t in range(c - 499)]
    rows += [(c, 0, "user", "short") for c in range(600, 640)] + [(c, t, "user", f"{c} {t}") for c in range(700, 720) for t in range(3)]
    return rows


ODD = [
    (1001, None, "user", "first"), (1001, 0, None, "x"), (1001, 1, "", None), (1001, 1, "a", "tie"), (1002, 5, "user", "gap"), (1002, 9, "user", "gap"),
    (1002, 9, "user", "gap"), (None, 0, "user", "nobody"), (1003, 0, "user", "long " * 50_000), (1004, 0, "us", "er"), (1007, 0, "u", "ser"), (1008, 0, "user", ""), (-6, 0, "user", "minus"),
]


@pytest.mark.parametrize("settings", [TrieSettings(), TrieSettings(container=300, run=7), TrieSettings(container=1, run=1)])
def test_nodes_against_all_prefixes(spark, settings):
    rows = families() + ODD
    turns = spark.createDataFrame(rows, TURNS).repartition(5)
    sequences = turn_sequences(turns)
    assert nodes(prefix_trie(sequences, settings)) == plain_trie(plain_sequences(rows))
    kept = [r for r in rows if r[0] is None or r[0] >= 0]
    again = rebuilt(turn_sequences(spark.createDataFrame(kept, TURNS)))
    assert nodes(prefix_trie(again, settings)) == plain_trie(plain_rebuilt(plain_sequences(kept)))


def test_rounds_follow_branching_not_depth(spark):
    """Conversations that share a long opening burst once, not once a turn."""
    rows = [(c, t, "user", f"{t}" if t < 300 else f"{c}") for c in range(20) for t in range(301)]
    df = prefix_trie(turn_sequences(spark.createDataFrame(rows, TURNS)), TrieSettings(container=500))
    assert nodes(df) == plain_trie(plain_sequences(rows))


def test_no_conversations_and_extra_columns(spark):
    empty = spark.createDataFrame([], TURNS)
    assert prefix_trie(rebuilt(turn_sequences(empty))).count() == 0
    clashing = spark.createDataFrame([(c, 0, "user", "x", "y", 1) for c in (1, 2)], TURNS + ", path string, conv int")
    assert nodes(prefix_trie(turn_sequences(clashing))) == plain_trie({1: [("user", "x")], 2: [("user", "x")]})


def test_shared_turns():
    a, b = bytes(range(64)), bytes(range(40)) + bytes(24)
    assert [shared_turns(a, b), shared_turns(a, a), shared_turns(a, b""), shared_turns(a[:32], a)] == [2, 4, 0, 2]
