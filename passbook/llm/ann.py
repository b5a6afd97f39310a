"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample; every vector is then filed in a leaf.  A query walks the tree
with a priority queue of bins by their inner product with its vector, and visits leaves in that order.
How many it visits is calibrated: the true neighbours of some queries are found by comparison with
all rows, in blocks, and visits are widened until the wanted share of them lies in visited leaves.

Equal vectors have equal scores and ties go to the smaller id, so of each distinct vector only the
``k`` + 1 smallest ids can be answers; the others are set aside before the search.  Equal queries are
searched once.  Leaves are worked in blocks of bounded rows.

Defined results: vectors that are NULL, empty, zero, or hold NULL or non-finite components, and rows
without an id, take no part; vectors of different lengths are not compared.  Ids are taken to be
unique; a repeated row is one candidate and one query.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passbook.session import cut_lineage

#: Rows in the sample that the tree is fitted on, children of a node, and sample rows of a leaf.  A
#: leaf holds a 32nd of the rows or less: where neighbours are spread over many leaves, small ones
#: would send each query to thousands of them.
SAMPLE, BRANCH, LEAF = 16_384, 8, 512
#: Queries of the calibration, wanted recall, and rows in a block of a leaf.
PROBES, RECALL, BLOCK = 256, 0.95, 4096
SEED = 20_240_531


@dataclass(frozen=True)
class Tree:
    """``children[n]`` are the children of node n, none for a leaf; node 0 is the root."""

    centres: np.ndarray
    children: tuple[tuple[int, ...], ...]

    @property
    def leaves(self) -> int:
        return sum(not c for c in self.children)


def fit_tree(vectors: np.ndarray, branch: int = BRANCH, leaf: int = LEAF, seed: int = SEED) -> Tree:
    """Split the sample by k-means, node by node, until a node has few rows or cannot be split."""
    rng = np.random.default_rng(seed)
    centres, children = [vectors.mean(0) if len(vectors) else np.zeros(1)], [()]
    queue = [(0, np.arange(len(vectors)))]
    while queue:
        node, rows = queue.pop()
        if len(rows) <= leaf:
            continue
        points = vectors[rows]
        seeds = points[rng.choice(len(rows), min(branch, len(rows)), replace=False)]
        for _ in range(8):
            near = _nearest(points, seeds)
            seeds = np.array([points[near == c].mean(0) if (near == c).any() else s for c, s in enumerate(seeds)])
        near = _nearest(points, seeds)
        parts = [c for c in range(len(seeds)) if (near == c).any()]
        if len(parts) < 2:
            continue
        children[node] = tuple(range(len(centres), len(centres) + len(parts)))
        for c in parts:
            centres.append(seeds[c])
            children.append(())
            queue.append((len(centres) - 1, rows[near == c]))
    return Tree(np.array(centres), tuple(children))


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (2 * points @ centres.T - (centres**2).sum(1)).argmax(1)


def file_in(tree: Tree, vectors: np.ndarray) -> np.ndarray:
    """The leaf of each vector: down the tree by the nearest centre."""
    at = np.zeros(len(vectors), int)
    moving = np.arange(len(vectors))
    while len(moving):
        rest = []
        for node in np.unique(at[moving]):
            below = tree.children[node]
            if below:
                rows = moving[at[moving] == node]
                at[rows] = np.array(below)[_nearest(vectors[rows], tree.centres[list(below)])]
                rest.append(rows)
        moving = np.concatenate(rest) if rest else np.empty(0, int)
    return at


def best_bins(tree: Tree, query: np.ndarray, visits: int, held: dict[int, int] | None = None, least: int = 0) -> list[int]:
    """The first leaves in best-bin-first order, and more until they hold ``least`` rows by ``held``."""
    worth = tree.centres @ query
    queue, out, rows = [(0.0, 0)], [], 0
    while queue and (len(out) < visits or rows < least):
        _, node = heapq.heappop(queue)
        if not tree.children[node]:
            out.append(node)
            rows += (held or {}).get(node, 0)
        for child in tree.children[node]:
            heapq.heappush(queue, (-worth[child], child))
    return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, width)


def best_of(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query the ids and scores of the best k, ties to the smaller id.

    A product of matrices may round equal vectors differently, so all rows that are not below the
    k-th by more than rounding are scored again one by one, however many tie.
    """
    longest = np.sqrt((vectors**2).sum(1).max(initial=0.0))
    for block in range(0, len(queries), 512):
        part = queries[block : block + 512]
        rough = part @ vectors.T
        last = len(ids) - min(k, len(ids))
        kth = np.partition(rough, last, axis=1)[:, last]
        margin = 4 * vectors.shape[1] * np.finfo(float).eps * longest * np.sqrt((part**2).sum(1))
        for q, worth, floor in zip(part, rough, kth - margin):
            # Not "below" instead of "at least": an overflow to NaN keeps its row.
            rows = np.flatnonzero(~(worth < floor))
            score = (vectors[rows] * q).sum(1)
            order = np.lexsort((ids[rows], -score))[:k]
            yield ids[rows][order], score[order]


def usable(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id`` and ``v`` (doubles) of the rows that take part, each once."""
    v = F.col(vector).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return (
        vectors.select(F.col(vec_id).cast("bigint").alias("id"), v.alias("v"), good.alias("_good"))
        .where("id is not null and _good").select("id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))
        .dropDuplicates(["id"])
    )


def _search(candidates: DataFrame, queries: DataFrame, width: int, k: int, probes: int, recall: float) -> DataFrame:
    """``query`` (id of a distinct query vector), ``id``, ``score``: the best ``k`` + 1 found."""
    spark = candidates.sparkSession
    sample = candidates.orderBy(F.xxhash64("id")).limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
    tree = fit_tree(_matrix(sample, width))

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = file_in(tree, _matrix(b.column("v"), width))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(leaf, pa.int32())], names=["id", "v", "leaf"])

    filed = cut_lineage(candidates.mapInArrow(file, "id bigint, v array<double>, leaf int"))

    # Calibration: a bounded set of queries against all rows, a block at a time.
    asked = queries.orderBy(F.xxhash64("id", F.lit(SEED))).limit(probes).toArrow()
    probe_ids, probe = asked["id"].to_numpy(), _matrix(asked["v"].combine_chunks(), width)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                ids, leaf = b.column("id").to_numpy(), b.column("leaf").to_numpy()
                at = np.argsort(ids)
                found = list(best_of(probe, _matrix(b.column("v"), width), ids, k + 1))
                q = np.repeat(np.arange(len(probe)), [len(i) for i, _ in found])
                near, score = (np.concatenate([f[x] for f in found]) for x in (0, 1))
                leaves = leaf[at[np.searchsorted(ids[at], near)]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q), pa.array(near), pa.array(score), pa.array(leaves)], names=["q", "id", "score", "leaf"]
                )

    best = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    true = (
        filed.mapInArrow(compare, "q bigint, id bigint, score double, leaf int")
        .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k + 1).select("q", "id", "leaf").collect()
    )
    place = [{leaf: i for i, leaf in enumerate(best_bins(tree, q, tree.leaves))} for q in probe]
    needed = sorted(place[r["q"]][r["leaf"]] + 1 for r in true if r["id"] != probe_ids[r["q"]])
    visits = needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))] if needed else 1

    # The visited leaves of a query hold k + 1 rows at least; there are no more leaves than sample rows.
    held = {r["leaf"]: r["count"] for r in filed.groupBy("leaf").count().collect()}

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), 128):
                b = whole.slice(start, 128)
                rows = [(i, leaf) for i, q in enumerate(_matrix(b.column("v"), width)) for leaf in best_bins(tree, q, visits, held, k + 1)]
                at, leaf = zip(*rows)
                taken = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").take(taken), b.column("v").take(taken), pa.array(leaf, pa.int32())], names=["id", "v", "leaf"]
                )

    asks = queries.mapInArrow(visit, "id bigint, v array<double>, leaf int")
    # Leaves in blocks: each block of vectors meets each block of the queries that visit the leaf.
    blocks = cut_lineage(
        filed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    )
    left = filed.join(blocks, "leaf").select(
        "leaf", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), "id", "v"
    )
    right = asks.join(blocks, "leaf").select(
        "leaf", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "id", "v"
    )

    def meet(vectors: pa.Table, asked: pa.Table) -> pa.Table:
        ids, near, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        if len(vectors) and len(asked):
            found = list(best_of(_matrix(asked["v"].combine_chunks(), width), _matrix(vectors["v"].combine_chunks(), width),
                                 vectors["id"].to_numpy(), k + 1))
            ids = np.repeat(asked["id"].to_numpy(), [len(i) for i, _ in found])
            near, score = (np.concatenate([f[x] for f in found]) for x in (0, 1))
        return pa.table({"query": ids, "id": near, "score": score})

    meet.__annotations__ = {"vectors": pa.Table, "asked": pa.Table, "return": pa.Table}
    salts = F.pmod(F.xxhash64("id", F.lit(SEED)), F.col("salts")).cast("int")
    crowds = cut_lineage(
        right.groupBy("leaf", "block").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("salts"))
    )
    right = right.join(crowds, ["leaf", "block"]).select("leaf", "block", salts.alias("salt"), "id", "v")
    left = left.join(crowds, ["leaf", "block"]).select(
        "leaf", "block", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "id", "v"
    )
    keys = ["leaf", "block", "salt"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "query bigint, id bigint, score double")
    first = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return met.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k + 1).drop("_n")


def nearest(
    vectors: DataFrame, every: int = 20, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding",
    probes: int = PROBES, recall: float = RECALL,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: for each row whose id is divisible by
    ``every``, its ``k`` nearest other rows found by inner product, in double precision."""
    spark = vectors.sparkSession
    rows = cut_lineage(usable(vectors, vec_id, vector))
    # Of equal vectors the k + 1 smallest ids.  Spark applies the limit before the shuffle as well.
    equal = Window.partitionBy("v").orderBy("id")
    candidates = cut_lineage(rows.withColumn("_n", F.row_number().over(equal)).where(F.col("_n") <= k + 1).drop("_n"))
    asked = rows.where(F.col("id") % every == 0)
    groups = cut_lineage(asked.groupBy(F.col("v").alias("group_v")).agg(F.min("id").alias("group")))
    found = None
    widths = [r["w"] for r in candidates.select(F.size("v").alias("w")).distinct().collect()]
    for w in widths:
        part = _search(
            candidates.where(F.size("v") == w),
            groups.where(F.size("group_v") == w).select(F.col("group").alias("id"), F.col("group_v").alias("v")),
            w, k, probes, recall,
        )
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "query bigint, id bigint, score double")
    members = asked.join(groups, F.col("v") == F.col("group_v")).select(F.col("id").alias("query_id"), "group")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (
        members.join(cut_lineage(found), F.col("group") == F.col("query")).where("id <> query_id")
        .withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
    )
