"""Nearest neighbours by a forest of random-projection trees with one queue, and exact reranking."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annolytics.llm.prefix import partitions_for
from annolytics.session import settle


class ForestSettings(NamedTuple):
    """The forest is fitted on at most ``sample`` vectors, drawn by hash of their content; every vector is then indexed.

    A tree splits its part of the sample until at most ``leaf`` vectors are left. A query takes
    leaves in the order of one queue over all trees until these hold a wanted number of vectors
    (repeats counted), and the ``k`` best of the different ones stay. That number is the least
    with which ``probes`` queries, searched exactly as well, find ``recall`` of their true
    neighbours. Leaves are searched in bundles, or parts, of about ``part`` vectors at most.
    """

    k: int = 20
    trees: int = 16
    sample: int = 16_384
    leaf: int = 128
    probes: int = 96
    recall: float = 0.97
    part: int = 8192
    seed: int = 3


class Tree(NamedTuple):
    """Inner nodes in arrays: the plane of each, and its two children, of which a leaf is written as -1 - leaf."""

    planes: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    n_leaves: int


def _halves(rows: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float] | None:
    """A plane midway between two centres, found from two random rows and a few rounds of two-means on at most 256 rows."""
    some = rows[rng.choice(len(rows), min(len(rows), 256), replace=False)]
    a, b = some[0], some[1]
    for _ in range(4):
        side = some @ (a - b) > (a - b) @ (a + b) / 2
        if side.all() or not side.any():
            break
        a, b = some[side].mean(axis=0), some[~side].mean(axis=0)
    norm = np.linalg.norm(a - b)
    return ((a - b) / norm, float((a - b) @ (a + b) / 2 / norm)) if norm > 0 else None


def grow_tree(vectors: np.ndarray, leaf: int, rng: np.random.Generator) -> Tree:
    """Split by random planes, again and again.

    Where all planes drawn leave one side nearly empty, the rows are alike and the part stays a leaf.
    """
    planes, offsets, children = [], [], []
    n_leaves = 0

    def build(rows: np.ndarray) -> int:
        nonlocal n_leaves
        for _ in range(8 if len(rows) > leaf else 0):
            plane = _halves(vectors[rows], rng)
            if plane is None:
                continue
            right = vectors[rows] @ plane[0] > plane[1]
            if 0.05 * len(rows) <= right.sum() <= 0.95 * len(rows):
                node = len(planes)
                planes.append(plane[0])
                offsets.append(plane[1])
                children.append([0, 0])
                children[node] = [build(rows[~right]), build(rows[right])]
                return node
        n_leaves += 1
        return -n_leaves

    root = build(np.arange(len(vectors)))
    if not planes:
        # One leaf: a plane that sends everything the same way keeps the layout.
        planes, offsets, children = [np.zeros(vectors.shape[1])], [np.inf], [[root, root]]
    return Tree(np.array(planes), np.array(offsets), np.array(children), n_leaves)


def leaf_of(tree: Tree, vectors: np.ndarray) -> np.ndarray:
    """The leaf of each vector."""
    at = np.zeros(len(vectors), dtype=np.int64)
    inner = np.arange(len(vectors))
    while len(inner):
        side = np.einsum("ij,ij->i", vectors[inner], tree.planes[at[inner]]) > tree.offsets[at[inner]]
        at[inner] = tree.children[at[inner], side.astype(np.int64)]
        inner = inner[at[inner] >= 0]
    return -1 - at


def search_leaves(forest: list[Tree], sizes: list[np.ndarray], margins: list[np.ndarray], wanted: float) -> list[tuple[int, int]]:
    """Leaves ``(tree, leaf)`` of one query in the order of a queue shared by all trees.

    A node's place in the queue is the least margin by which the query lies on its side of the
    planes above it; a node on the other side counts negative. Stops when the leaves hold ``wanted`` vectors.
    """
    queue = [(-np.inf, tree, 0) for tree in range(len(forest))]
    heapq.heapify(queue)
    found, held = [], 0
    while queue and held < wanted:
        place, tree, node = heapq.heappop(queue)
        if node < 0:
            n = int(sizes[tree][-1 - node])
            if n:
                found.append((tree, -1 - node))
                held += n
            continue
        margin = margins[tree][node]
        left, right = forest[tree].children[node]
        heapq.heappush(queue, (max(place, margin), tree, int(left)))
        heapq.heappush(queue, (max(place, -margin), tree, int(right)))
    return found


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of equal length as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _augmented(vectors: np.ndarray, longest: float) -> np.ndarray:
    """With one more coordinate that makes all vectors equally long, so that the largest inner product is the least distance."""
    rest = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(axis=1), 0))
    return np.concatenate([vectors, rest[:, None]], axis=1)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, vector)`` of the rows that take part: id and all components finite, not all of them zero."""
    # Doubles hold floats exactly, but take twice the room in every tree.
    is_float = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    v = F.col(f"`{vector_col}`") if is_float else F.col(f"`{vector_col}`").cast("array<double>")
    fine = F.expr("forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(vector, x -> x <> 0)")
    return vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), v.alias("vector")).where("id IS NOT NULL AND size(vector) > 0").where(fine)


def _placed(forest: list[Tree], longest: float):
    """A row for each tree: the leaf of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _augmented(_matrix(batch.column("vector")), longest)
            for number, tree in enumerate(forest):
                leaves = leaf_of(tree, vectors)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(leaves), number, np.int32)), pa.array(leaves.astype(np.int32)), batch.column("id"), batch.column("vector")],
                    ["tree", "leaf", "id", "vector"],
                )

    return run


def leaf_bundles(sizes: list[np.ndarray], part: int) -> tuple[list[np.ndarray], list[tuple[int, int, int, int]]]:
    """Runs of neighbouring leaves that hold at most ``part`` vectors together, to be searched by one task.

    Gives the bundle of every leaf by tree, and rows ``(tree, leaf, bundle, parts)``; a leaf that is
    larger is a bundle of its own and is cut into parts.
    """
    bundles, rows = [], []
    for tree, counts in enumerate(sizes):
        own, at, held = np.zeros(len(counts), dtype=np.int64), 0, 0
        for leaf, n in enumerate(counts.tolist()):
            if held and held + n > part:
                at, held = at + 1, 0
            own[leaf] = at
            held += n
            rows.append((tree, leaf, at, max(1, -(-n // part))))
        bundles.append(own)
    return bundles, rows


def _routed(forest: list[Tree], sizes: list[np.ndarray], bundles: list[np.ndarray], part: int, wanted: float):
    """A row for each bundle, and part of one, that a query has to look into, with the leaves it wants there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            # The query's further coordinate is zero.
            queries = np.concatenate([_matrix(batch.column("vector")), np.zeros((batch.num_rows, 1))], axis=1)
            out = []
            for low in range(0, len(queries), 256):
                some = queries[low : low + 256]
                margins = [some @ tree.planes.T - tree.offsets for tree in forest]
                for i in range(len(some)):
                    asked: dict[tuple[int, int, int], list[int]] = {}
                    for tree, leaf in search_leaves(forest, sizes, [m[i] for m in margins], wanted):
                        for piece in range(max(1, -(-int(sizes[tree][leaf]) // part))):
                            asked.setdefault((tree, int(bundles[tree][leaf]), piece), []).append(leaf)
                    out.extend((*key, leaves, low + i) for key, leaves in asked.items())
            trees, numbers, pieces, leaves, rows = zip(*out) if out else ((), (), (), (), ())
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(trees, pa.int32()), pa.array(numbers, pa.int64()), pa.array(pieces, pa.int64()), pa.array(leaves, pa.list_(pa.int32())),
                    batch.column("id").take(at), batch.column("vector").take(at),
                ],
                ["tree", "bundle", "part", "leaves", "query", "vector"],
            )

    return run


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of aligned rows; equal rows give equal sums whatever stands beside them."""
    return (a * b).sum(axis=1)


def _best(q: np.ndarray, ids: np.ndarray, score: np.ndarray, keep: int) -> np.ndarray:
    """Places of the ``keep`` best of each query, ties to the smaller id."""
    order = np.lexsort((ids, -score, q))
    ordered = q[order]
    return order[np.arange(len(q)) - np.searchsorted(ordered, ordered) < keep]


def _best_in_bundle(settings: ForestSettings):
    """The best of a bundle of leaves for each query that looks into it. One more is kept, as a query may find itself."""

    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        nothing = pd.DataFrame({"query": [], "id": [], "score": []}).astype({"query": "int64", "id": "int64", "score": "float64"})
        if not len(queries) or not len(rows):
            return nothing
        base, ids = np.stack(rows["vector"].to_numpy()).astype(np.float64), rows["id"].to_numpy()
        asked = np.stack(queries["vector"].to_numpy()).astype(np.float64)
        wants = queries["leaves"].map(len).to_numpy()
        wanted, asker = np.concatenate(queries["leaves"].to_numpy()), np.repeat(np.arange(len(queries)), wants)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for leaf, own in rows.groupby("leaf").indices.items():
            askers = asker[wanted == leaf]
            keep = min(settings.k + 1, len(own))
            for low in range(0, len(askers), 1024):
                some = askers[low : low + 1024]
                rough = asked[some] @ base[own].T
                edge = np.partition(rough, len(own) - keep, axis=1)[:, len(own) - keep]
                # Rounding may differ from the exact sum; what ties within it goes on.
                q, r = np.nonzero(rough >= (edge - 1e-9 * (1 + np.abs(edge)))[:, None])
                q, r = some[q], own[r]
                found.append((q, r, exact_scores(asked[q], base[r])))
        if not found:
            return nothing
        q, r, score = (np.concatenate(c) for c in zip(*found))
        top = _best(q, ids[r], score, settings.k + 1)
        return pd.DataFrame({"query": queries["query"].to_numpy()[q[top]], "id": ids[r[top]], "score": score[top]})

    return run


def _exact_part(probes: np.ndarray, keep: int):
    """The best rows of a partition for each probe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, scores = np.zeros((len(probes), 0), np.int64), np.zeros((len(probes), 0))
        for batch in batches:
            if batch.num_rows:
                own = np.broadcast_to(batch.column("id").to_numpy(), (len(probes), batch.num_rows))
                ids = np.concatenate([ids, own], axis=1)
                scores = np.concatenate([scores, probes @ _matrix(batch.column("vector")).T], axis=1)
                best = np.argsort(-scores, axis=1, kind="stable")[:, :keep]
                ids, scores = np.take_along_axis(ids, best, 1), np.take_along_axis(scores, best, 1)
        at = np.repeat(np.arange(len(probes), dtype=np.int32), ids.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(ids.ravel()), pa.array(scores.ravel())], ["probe", "id", "score"])

    return run


def wanted_candidates(
    asked: DataFrame, indexed: DataFrame, placed: DataFrame, forest: list[Tree], sizes: list[np.ndarray], settings: ForestSettings
) -> float:
    """How many vectors the leaves of a query have to hold, by exact search for a bounded number of queries.

    A true neighbour is found as soon as the queue comes to its leaf in any tree; what the leaves
    before hold by then is what it needs. Only the probes and the places of their neighbours come to the driver.
    """
    drawn = asked.orderBy(F.xxhash64(F.lit(settings.seed), "query")).limit(settings.probes).toPandas()
    if not len(drawn):
        return 0
    probes, own = np.stack(drawn["vector"].to_numpy()).astype(np.float64), drawn["query"].to_numpy()
    found = indexed.mapInArrow(_exact_part(probes, settings.k + 1), "probe int, id bigint, score double")
    best = Window.partitionBy("probe").orderBy(F.col("score").desc(), "id")
    true = found.withColumn("at", F.row_number().over(best)).where(F.col("at") <= settings.k + 1).select("probe", "id")
    places = placed.select("tree", "leaf", "id").join(F.broadcast(true), "id").toPandas()
    places = places[own[places["probe"]] != places["id"]]
    needs = []
    queries = np.concatenate([probes, np.zeros((len(probes), 1))], axis=1)
    for probe, near in places.groupby("probe"):
        margins = [tree.planes @ queries[probe] - tree.offsets for tree in forest]
        order = search_leaves(forest, sizes, margins, np.inf)
        held = np.cumsum([sizes[t][leaf] for t, leaf in order])
        reached = dict(zip(order, held.tolist()))
        near = near.assign(need=[reached[key] for key in zip(near["tree"], near["leaf"])])
        needs.append(near.groupby("id")["need"].min().to_numpy())
    return float(np.quantile(np.concatenate(needs), settings.recall)) if needs else 0


def nearest(vectors: DataFrame, id_col: str, vector_col: str, is_query: Column, settings: ForestSettings = ForestSettings()) -> DataFrame:
    """The ``k`` rows with the largest inner product found for each query row: ``(query_id, rank, vec_id, score)``.

    ``is_query`` is a condition on ``id``. A query never finds its own row; ties go to the
    smaller id; scores are in double precision on the given vectors. Rows whose id or vector is null, or whose vector is
    empty, zero or holds null or non-finite components, take no part. Vectors of unequal length are an error. Fewer rows than ``k`` give as many as there are.

    The planes, fitted on a bounded sample, and the sizes of leaves, of which their number is
    bounded by it, are all that is sent to every task; how far to search is measured on a bounded number of queries. Vectors and queries then meet by bundles of leaves. Repeats of an id with its vector are dropped first. Of equal vectors the k + 1
    with the smallest ids are indexed, as no others can be among the k best; equal queries are searched once. Large leaves
    are cut into parts, so that no group holds more than a part. Rows with equal ids and other vectors are candidates each, found as one.
    """
    spark = vectors.sparkSession
    kind = usable(vectors, id_col, vector_col).schema["vector"].dataType.simpleString()
    rows = settle(usable(vectors, id_col, vector_col).distinct().withColumn("h", F.xxhash64("vector")), "ann-rows")
    one = Window.partitionBy("h", "vector").orderBy("id")
    indexed = rows.withColumn("n", F.row_number().over(one)).where(F.col("n") <= settings.k + 1).select("id", "vector", "h")
    indexed = settle(indexed, "ann-indexed")
    total = indexed.count()
    empty = "query_id bigint, rank int, vec_id bigint, score double"
    if total == 0:
        return spark.createDataFrame([], empty)
    norm = F.sqrt(F.expr("aggregate(vector, 0d, (a, x) -> a + double(x) * double(x))"))
    most = indexed.agg(F.max(norm).alias("norm"), F.min(F.size("vector")).alias("least"), F.max(F.size("vector")).alias("most")).first()
    if most["least"] != most["most"]:
        raise ValueError(f"vectors have from {most['least']} to {most['most']} components")
    longest = float(most["norm"]) * (1 + 1e-9)
    share = min(1.0, settings.sample / total)
    drawn = indexed.where(F.pmod(F.xxhash64(F.lit(settings.seed), "h"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) or 1))
    sample = drawn.select("vector").limit(settings.sample).toPandas()["vector"]
    if not len(sample):
        sample = indexed.select("vector").limit(settings.sample).toPandas()["vector"]
    fitted = _augmented(np.stack(sample.to_numpy()).astype(np.float64), longest)
    rng = np.random.default_rng(settings.seed)
    forest = [grow_tree(fitted, settings.leaf, rng) for _ in range(settings.trees)]
    placed = settle(indexed.mapInArrow(_placed(forest, longest), f"tree int, leaf int, id bigint, vector {kind}"), "ann-placed")
    counted = placed.groupBy("tree", "leaf").count().toPandas()
    sizes = [np.zeros(tree.n_leaves, dtype=np.int64) for tree in forest]
    for t, leaf, n in zip(counted["tree"], counted["leaf"], counted["count"]):
        sizes[t][leaf] = n
    # Equal queries are one, known by the smallest of their ids.
    queries = rows.where(is_query)
    asked = settle(queries.groupBy("h", "vector").agg(F.min("id").alias("query")), "ann-queries")
    wanted = wanted_candidates(asked, indexed, placed, forest, sizes, settings)
    bundles, places = leaf_bundles(sizes, settings.part)
    # The queries are few and may lie in one file; finding their way is the costly part.
    dealt = asked.select(F.col("query").alias("id"), "vector").repartition(partitions_for(spark), "id")
    routed = dealt.mapInArrow(
        _routed(forest, sizes, bundles, settings.part, wanted),
        f"tree int, bundle bigint, part bigint, leaves array<int>, query bigint, vector {kind}",
    )
    placed = placed.join(F.broadcast(spark.createDataFrame(places, "tree int, leaf int, bundle bigint, parts bigint")), ["tree", "leaf"])
    placed = placed.withColumn("part", F.pmod(F.xxhash64("id"), "parts")).drop("parts")
    key = ["tree", "bundle", "part"]
    found = routed.groupBy(*key).cogroup(placed.groupBy(*key)).applyInPandas(
        _best_in_bundle(settings), "query bigint, id bigint, score double"
    )
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    kept = found.distinct().withColumn("at", F.row_number().over(best)).where(F.col("at") <= settings.k + 1)
    kept = settle(kept, "ann-found")
    own = queries.select(F.col("id").alias("query_id"), "h", "vector").distinct().join(asked, ["h", "vector"]).select("query_id", "query")
    pairs = own.join(kept, "query").where("query_id <> id")
    rank = Window.partitionBy("query_id").orderBy("at")
    ranked = pairs.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= settings.k)
    return ranked.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
