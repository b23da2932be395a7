"""A prefix trie over conversations, built as a burst trie: trie heads above sorted containers of suffixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annolytics.plans.sizing import broadcast_if_small
from annolytics.session import settle

#: Bytes of a turn id.
ID = 16
NOBODY = hashlib.sha256(b"").hexdigest()


class TrieSettings(NamedTuple):
    """A container whose suffixes hold more than ``container`` turns bursts, unless they are one sequence.

    Conversation ids that end at a node are brought together in runs of at most ``run`` ids.
    """

    container: int = 32_768
    run: int = 256


def turn_sequences(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row ``(conv, path, sizes)`` per conversation: its turn ids, end to end, and the UTF-8 bytes of its texts.

    Turns are in the order of ``turn_col``, null first; equal ones by role, then by id. A null
    role or text is empty. A turn's id is 128 bits of its role and text, so turns are equal where both are. Repeated rows are turns
    of their own; rows without a conversation id belong to none. Texts are not moved, only their ids; a
    conversation's ids must fit a row.
    """
    of = lambda name: F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
    role, text = of(role_col), of(text_col)
    known = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    item = F.struct(F.col(f"`{turn_col}`").alias("turn"), role.alias("role"), known.alias("id"), F.octet_length(text).cast("bigint").alias("size"))
    rows = turns.select(F.col(f"`{conv_col}`").cast("bigint").alias("conv"), item.alias("item")).where("conv IS NOT NULL")
    listed = rows.groupBy("conv").agg(F.array_sort(F.collect_list("item")).alias("items"))
    path = F.unhex(F.array_join(F.transform("items", lambda t: t["id"]), ""))
    return listed.select("conv", path.alias("path"), F.transform("items", lambda t: t["size"]).alias("sizes"))


_SEQUENCE_SCHEMA = pa.schema([("path", pa.binary()), ("sizes", pa.list_(pa.int64())), ("least", pa.int64()), ("n", pa.int64()), ("ends", pa.string())])


def _one_per_sequence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ids of one sequence, in order, as one row with their number, smallest id and hash. Only the hash is held while runs pass by."""
    key, row, digest = None, {}, hashlib.sha256()
    for batch in batches:
        out: list[dict] = []
        columns = [batch.column(c).to_pylist() for c in ("key", "path", "sizes", "least", "n", "ids")]
        for next_key, path, sizes, least, n, ids in zip(*columns):
            if next_key == key:
                row["n"] += n
                digest.update(b",")
            else:
                if key is not None:
                    out.append({**row, "ends": digest.hexdigest()})
                key, row, digest = next_key, {"path": path, "sizes": sizes, "least": least, "n": n}, hashlib.sha256()
            digest.update(ids.encode())
        yield pa.RecordBatch.from_pylist(out, schema=_SEQUENCE_SCHEMA)
    if key is not None:
        yield pa.RecordBatch.from_pylist([{**row, "ends": digest.hexdigest()}], schema=_SEQUENCE_SCHEMA)


def distinct_sequences(sequences: DataFrame, run: int) -> DataFrame:
    """Equal sequences as one row ``(path, sizes, least, n, ends)``.

    However many conversations share one, their ids come as runs that are put together before the
    shuffle's sort, and pass through one running hash.
    """
    keyed = sequences.select(F.md5("path").alias("key"), F.floor(F.col("conv") / F.lit(run)).alias("run"), "conv", "path", "sizes")
    runs = keyed.groupBy("key", "run").agg(
        F.first("path").alias("path"), F.first("sizes").alias("sizes"), F.array_sort(F.collect_set("conv")).alias("convs")
    )
    ids = F.array_join(F.transform("convs", lambda c: c.cast("string")), ",")
    runs = runs.select("key", "run", "path", "sizes", F.col("convs")[0].alias("least"), F.size("convs").cast("bigint").alias("n"), ids.alias("ids"))
    return runs.repartition("key").sortWithinPartitions("key", "run").mapInArrow(
        _one_per_sequence, "path binary, sizes array<bigint>, least bigint, n bigint, ends string"
    )


def shared_turns(a: bytes, b: bytes) -> int:
    """The number of leading turns that two paths share."""
    limit = min(len(a), len(b)) // ID
    low, high = 0, limit
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[: middle * ID] == b[: middle * ID] else (low, middle - 1)
    return low


@F.pandas_udf(T.IntegerType())
def _shared(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([shared_turns(bytes(x), bytes(y)) for x, y in zip(a, b)], dtype="int32")


def _burst(sequences: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Burst oversized containers until none is left: the members of the rest, the heads, and what ends at a head.

    A container ``c`` holds the sequences that share their first ``depth`` turns. An oversized one becomes a head, which
    takes all further turns its members share too; its members go on by their next turn, or end there.
    """
    # Containers go by the hash of the turns their members share; that of no turn comes first.
    shared = lambda turns: F.md5(F.substring("path", F.lit(1), turns * ID)).alias("c")
    members = sequences.select(shared(F.lit(0)), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("head"), "*")
    settled, heads, ended = [], [], []
    while True:
        stats = members.groupBy("c", "depth", "head").agg(
            F.count("*").alias("sequences"),
            F.sum(F.size("sizes") - F.col("depth") + 1).alias("turns"),
            F.min(F.struct("path", "sizes")).alias("low"),
            F.max("path").alias("high"),
            F.sum("n").alias("n"),
            F.min("least").alias("least"),
        )
        large = stats.where((F.col("sequences") > 1) & (F.col("turns") > limit))
        large = settle(large.withColumn("bottom", _shared("low.path", "high")).drop("high"), "trie-heads")
        if large.isEmpty():
            settled.append(members)
            break
        # The root's own place in its list has no text.
        sizes = F.concat(F.array(F.lit(0).cast("bigint")), F.col("low.sizes"))
        chain = F.slice(sizes, F.col("depth") + 1, F.col("bottom") - F.col("depth") + 1)
        heads.append(large.select(F.col("c").alias("id"), F.col("head").alias("parent"), F.col("depth").alias("top"), chain.alias("chain"), "n", "least"))
        dealt = settle(members.join(broadcast_if_small(large.select("c", "bottom")), "c", "left"), "trie-members")
        settled.append(dealt.where("bottom IS NULL").drop("bottom"))
        inner = dealt.where("bottom IS NOT NULL")
        ended.append(inner.where("size(sizes) = bottom").select(F.col("c").alias("id"), "ends"))
        members = inner.where("size(sizes) > bottom").select(
            shared(F.col("bottom") + 1), (F.col("bottom") + 1).alias("depth"), F.col("c").alias("head"), *sequences.columns
        )
    both = lambda parts: reduce(DataFrame.unionByName, parts) if parts else None
    return both(settled), both(heads), both(ended)


class _Node:
    __slots__ = ("depth", "parent", "size", "n", "least", "children", "leaves", "saved", "ends")

    def __init__(self, depth: int, parent: _Node | None, size: int):
        self.depth, self.parent, self.size = depth, parent, size
        self.n, self.least, self.children, self.leaves, self.saved, self.ends = 0, None, 0, 0, 0, NOBODY


def sweep(depth: int, members: Iterator[tuple[bytes, list[int], int, int, str]]) -> list[_Node]:
    """The nodes of one container, from sequences ``(path, sizes, least, n, ends)`` in the order of their paths.

    Only the nodes of the last path are open; one is complete when the next path leaves it.
    """
    nodes: list[_Node] = []
    open_nodes: list[_Node] = []
    last = b""

    def close(down_to: int) -> None:
        while len(open_nodes) > down_to:
            node = open_nodes.pop()
            node.leaves = node.leaves or 1
            node.saved += (node.n - 1) * node.size
            if open_nodes:
                above = open_nodes[-1]
                above.n += node.n
                above.least = node.least if above.least is None else min(above.least, node.least)
                above.children += 1
                above.leaves += node.leaves
                above.saved += node.saved

    for path, sizes, least, n, ends in members:
        close(shared_turns(last, path) - depth + 1 if open_nodes else 0)
        for at in range(depth + len(open_nodes), len(sizes) + 1):
            node = _Node(at, open_nodes[-1] if open_nodes else None, sizes[at - 1] if at else 0)
            nodes.append(node)
            open_nodes.append(node)
        node = open_nodes[-1]
        node.n += n
        node.least = least if node.least is None else min(node.least, least)
        node.ends = ends
        last = path
    close(0)
    return nodes


_NODE_SCHEMA = pa.schema(
    [("head", pa.string()), ("is_top", pa.bool_()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64())]
    + [(c, pa.int64()) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    + [("ends_sha256", pa.string())]
)
_NODE_DDL = (
    "head string, is_top boolean, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
    "saved_tokens bigint, ends_sha256 string"
)


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of every container of a partition, sorted by container and path. One container is held at a time."""
    columns = ("c", "depth", "head", "path", "sizes", "least", "n", "ends")

    def rows():
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in columns))

    def found(depth: int, head: str | None, members: list) -> pa.RecordBatch:
        nodes = sweep(depth, iter(members))
        values = [
            [head] * len(nodes), [x.parent is None for x in nodes], [x.least for x in nodes], [x.depth for x in nodes],
            [x.parent.least if x.parent else None for x in nodes], [x.n for x in nodes], [x.children for x in nodes],
            [x.leaves for x in nodes], [x.saved for x in nodes], [x.ends for x in nodes],
        ]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, _NODE_SCHEMA)], schema=_NODE_SCHEMA)

    waiting, held, key, members = [], 0, None, []
    for c, depth, head, *rest in rows():
        if key is not None and c != key[0]:
            waiting.append(found(key[1], key[2], members))
            members, held = [], held + waiting[-1].num_rows
            if held > 10_000:
                yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()
                waiting, held = [], 0
        key = (c, depth, head)
        members.append(rest)
    if key is not None:
        waiting.append(found(key[1], key[2], members))
        yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()


def _subtree_sums(heads: DataFrame) -> DataFrame:
    """``(id, leaves, saved)`` summed over every head and all heads below it, by doubling the distance looked up to."""
    sums = settle(heads.select("id", F.col("parent").alias("up"), "leaves", "saved"), "trie-sums")
    while not sums.where("up IS NOT NULL").isEmpty():
        more = sums.where("up IS NOT NULL").groupBy("up").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s")).withColumnRenamed("up", "id")
        above = sums.select(F.col("id").alias("up"), F.col("up").alias("upper"))
        joined = sums.join(more, "id", "left").join(above, "up", "left")
        total = [(F.col(a) + F.coalesce(b, F.lit(0))).alias(a) for a, b in (("leaves", "l"), ("saved", "s"))]
        sums = settle(joined.select("id", F.col("upper").alias("up"), *total), "trie-sums")
    return sums.drop("up")


def _head_nodes(heads: DataFrame, ended: DataFrame, tops: DataFrame) -> DataFrame:
    """The nodes of the heads: one for each turn that a head's members share."""
    below = tops.groupBy(F.col("head").alias("id")).agg(
        F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.count("*").alias("tops")
    )
    inner = heads.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("inner"))
    none = lambda c: F.coalesce(c, F.lit(0))
    own = F.expr("(n - 1) * aggregate(chain, 0L, (a, x) -> a + x)")
    full = heads.join(below, "id", "left").join(inner, "id", "left").join(ended, "id", "left").select(
        "id", "parent", "top", "chain", "n", "least", "ends", none("leaves").alias("leaves"), (none("saved") + own).alias("saved"),
        (none("tops") + none("inner")).alias("children"),
    )
    full = settle(full, "trie-heads")
    above = heads.select(F.col("id").alias("parent"), F.col("least").alias("above"))
    summed = full.drop("leaves", "saved").join(_subtree_sums(full), "id").join(above, "parent", "left")
    each = summed.select("*", F.posexplode("chain").alias("at", "size"), F.size("chain").alias("turns")).drop("chain")
    earlier = Window.partitionBy("id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    is_last = F.col("at") == F.col("turns") - 1
    return each.select(
        F.col("least").alias("conv_id"),
        (F.col("top") + F.col("at")).cast("bigint").alias("depth"),
        F.when(F.col("at") > 0, F.col("least")).otherwise(F.col("above")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(is_last, F.col("children")).otherwise(F.lit(1).cast("bigint")).alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("saved") - (F.col("n") - 1) * none(F.sum("size").over(earlier))).alias("saved_tokens"),
        F.when(is_last, F.coalesce("ends", F.lit(NOBODY))).otherwise(F.lit(NOBODY)).alias("ends_sha256"),
    )


def prefix_trie(sequences: DataFrame, settings: TrieSettings = TrieSettings()) -> DataFrame:
    """The nodes of the trie over ``sequences (conv, path, sizes)``, as turn_sequences gives them, with unique ``conv``.

    Every distinct sequence of first d turns is a node of depth d, from the textless root; its members are the
    conversations that begin with it. Per node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null at the root), ``n_convs``,
    ``n_children``, ``n_leaves`` (childless nodes in its subtree, itself included), ``saved_tokens`` (over its subtree, members less one times the bytes of the
    node's last text) and ``ends_sha256`` (hash of the decimal ids, ascending, of conversations that end there; of an empty string without any).

    Equal sequences are one from the start. Containers of suffixes burst by next turn until each is small or a single sequence; a burst needs one aggregate over
    the members still in oversized containers, and skips all turns these share, so rounds are as many as the levels at which a large container branches.
    Remaining containers are sorted by path and swept; heads add up what hangs below them by doubling. No conversations give no nodes, also no root.
    """
    distinct = settle(distinct_sequences(sequences, settings.run), "trie-sequences")
    members, heads, ended = _burst(distinct, settings.container)
    nodes = members.repartition("c").sortWithinPartitions("c", "path").mapInArrow(_swept, _NODE_DDL)
    columns: list[str | Column] = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    if heads is None:
        return nodes.select(*columns)
    nodes = settle(nodes, "trie-nodes")
    above = heads.select(F.col("id").alias("head"), F.col("least").alias("above"))
    parent = F.when(F.col("is_top"), F.col("above")).otherwise(F.col("parent_conv_id")).alias("parent_conv_id")
    swept = nodes.join(broadcast_if_small(settle(above, "trie-above")), "head", "left").withColumn("parent_conv_id", parent)
    return swept.select(*columns).unionByName(_head_nodes(heads, ended, nodes.where("is_top")).select(*columns))
