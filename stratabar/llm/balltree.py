"""Exact top-k inner products by ball-tree branch and bound.

Vectors become integers floor(scale * x). Rows are dealt evenly into shards of
bounded size. A shard is read once, its ball tree built once, and the queries
stream past it, so memory is that of a shard however many queries there are.
Nodes are opened in order of the upper bound q.c + |q| r, and a branch closes
once its bound lies under the query's k-th score. A first pass over one shard a
query gives every query a k-th score that all other shards share in the second.

Defined results: vectors that are null, empty, or hold null or non-finite
components take no part; a vector shorter than another counts as filled up with
noughts; equal scores go to the smaller id; fewer than k candidates give them
all; rows of a repeated id are candidates each, and of a repeated query id the
least vector asks, to which rows of its own id are no candidates; an empty
table gives an empty result. Scores past the range of a long are held at its
ends.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratabar.llm.common import Scratch

SHARD = 8_192
LEAF = 64
#: Integers beyond this have no squares in double precision; such shards are searched without a tree.
HUGE = 1 << 500
LONG = (-(1 << 63), (1 << 63) - 1)


class Tree:
    """Balls over rows of integer vectors; halves are cut along the line between two far points."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.nodes: list[tuple] = []  # (centre, radius, is a leaf, children or positions)
        if huge(rows):
            self.nodes.append((np.zeros(rows.shape[1]), math.inf, True, np.arange(len(ids))))
            self.root = 0
        else:
            self.real = rows.astype(np.float64)
            self.root = self.build(np.arange(len(ids)))
        self.centres = np.array([x[0] for x in self.nodes])
        self.radii = np.array([x[1] for x in self.nodes])

    def build(self, at: np.ndarray) -> int:
        points = self.real[at]
        centre = points.mean(axis=0)
        away = ((points - centre) ** 2).sum(axis=1)
        radius = float(np.sqrt(away.max()))
        me = len(self.nodes)
        self.nodes.append(None)
        if len(at) <= LEAF or radius == 0:
            kids = at
            leaf = True
        else:
            a = points[away.argmax()]
            b = points[((points - a) ** 2).sum(axis=1).argmax()]
            side = points @ (b - a)
            order = np.argsort(side, kind="stable")
            half = len(at) // 2
            kids, leaf = (self.build(at[order[:half]]), self.build(at[order[half:]])), False
        self.nodes[me] = (centre, radius, leaf, kids)
        return me

    def bounds(self, query: np.ndarray) -> np.ndarray:
        """Upper bounds of the inner product with each node, a little above for rounding."""
        if huge(query):
            return np.full(len(self.nodes), math.inf)
        real = query.astype(np.float64)
        with np.errstate(invalid="ignore"):
            b = self.centres @ real + np.linalg.norm(real) * self.radii
        # scores are held at the least long, so no bound is lower; one that has no value bounds nothing
        return np.nan_to_num(np.maximum(b + 1e-9 * np.abs(b) + 1e-3, float(LONG[0])), nan=math.inf, posinf=math.inf)

    def search(self, qid: int, query: np.ndarray, k: int, floor: tuple[float, int] | None, exact) -> list[tuple[int, int]]:
        """The best (score, id) of this tree that can still be among the k best overall."""
        best: list[tuple[int, int]] = []  # heap of (score, -id): the worst first
        bound = self.bounds(query)
        todo = [(-bound[self.root], self.root)]
        while todo:
            upper, node = heapq.heappop(todo)
            upper = -upper
            _, _, leaf, kids = self.nodes[node]
            worst = best[0] if len(best) == k else None
            if worst is not None and upper < worst[0] or floor is not None and upper < floor[0]:
                break  # every other node's bound is lower still
            if not leaf:
                for kid in kids:
                    heapq.heappush(todo, (-bound[kid], kid))
                continue
            scores = exact(self.rows[kids], query)
            if worst is not None or floor is not None:
                near = np.flatnonzero(scores >= max(worst[0] if worst else scores.min(), floor[0] if floor else scores.min()))
            else:
                near = np.arange(len(kids))
            if len(near) > k:  # the k best of a leaf, ties to smaller ids
                order = np.lexsort((self.ids[kids[near]], -scores[near].astype(np.float64))) if scores.dtype != object else np.array(sorted(range(len(near)), key=lambda i: (-scores[near[i]], self.ids[kids[near[i]]])))
                near = near[order]
            for i in near.tolist():
                vec = int(self.ids[kids[i]])
                if vec == qid:
                    continue
                item = (int(scores[i]), -vec)
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
        return [(s, -v) for s, v in best]


def huge(x: np.ndarray) -> bool:
    return x.dtype == object and x.size > 0 and max(abs(v) for v in x.ravel()) > HUGE


def products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Integer inner products, held at the ends of a long; in doubles where those are exact, else in Python's integers."""
    if rows.dtype != object and query.dtype != object:
        return (rows.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    found = rows.astype(object) @ query.astype(object)
    return np.array([min(max(int(x), LONG[0]), LONG[1]) for x in found], dtype=object)


def matrix(values: pa.Array) -> np.ndarray:
    """Rows of a list column as doubles, shorter ones filled up with noughts."""
    sizes = np.diff(values.offsets.to_numpy())
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = flat
    return out


def quantised(real: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as int64, or as Python integers where sums could pass 2**53."""
    with np.errstate(over="ignore"):
        scaled = np.floor(real * scale)
    most = np.abs(scaled).max(initial=0.0)
    if not most < 2**52 or real.shape[1] * most**2 >= 2**52:
        # beyond the doubles a component is a whole number already
        return np.array([[int(y) if math.isfinite(y) else int(x) * int(scale) for x, y in zip(a, b, strict=True)] for a, b in zip(real.tolist(), scaled.tolist(), strict=True)], dtype=object).reshape(real.shape)
    return scaled.astype(np.int64)


def searched(rows: DataFrame, asked: DataFrame, shards: int, k: int, scale: float) -> DataFrame:
    """(query_id, vec_id, score): each asked row's best in its shard; a shard's rows come before its queries."""
    both = rows.select("shard", F.lit(0).alias("kind"), "vec_id", "v", F.lit(None).cast("long").alias("floor")).union(asked.select("shard", F.lit(1), "vec_id", "v", "floor"))

    def run(batches):
        shard, tree, ids, parts = None, None, [], []
        for batch in batches:
            where, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero((np.diff(where) != 0) | (np.diff(kind) != 0)) + 1
            out: list[tuple[int, int, int]] = []
            for a, b in zip([0, *edges], [*edges, len(where)], strict=True):
                if a == b:
                    continue
                if where[a] != shard:
                    shard, tree, ids, parts = where[a], None, [], []
                piece = batch.slice(a, b - a)
                real, keys = matrix(piece.column(3)), piece.column(2).to_numpy()
                if not kind[a]:
                    ids.append(keys)
                    parts.append(real)
                    continue
                if tree is None and ids:
                    wide = max(x.shape[1] for x in parts)
                    tree = Tree(np.concatenate(ids), quantised(np.concatenate([np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in parts]), scale))
                    ids, parts = [], []
                if tree is not None:
                    wide = tree.rows.shape[1]
                    real = np.pad(real, ((0, 0), (0, max(0, wide - real.shape[1]))))[:, :wide]
                    for qid, q, floor in zip(keys.tolist(), quantised(real, scale), piece.column(4).to_pylist(), strict=True):
                        out += [(qid, v, s) for s, v in tree.search(qid, q, k, None if floor is None else (floor, 0), products)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], names=["query_id", "vec_id", "score"])

    return both.repartition(shards, "shard").sortWithinPartitions("shard", "kind").mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 10, scale: float = 1024.0, key: str = "vec_id", vector: str = "embedding", shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best of all other rows."""
    scratch = Scratch(spark, "balltree")

    def clean(df):
        e = F.col(vector).cast("array<double>")
        fit = F.col(key).isNotNull() & e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return df.where(fit).select(F.col(key).cast("long").alias("vec_id"), e.alias("v"))

    shards = max(1, -(-vectors.count() // shard))
    # written, so that both passes find each row in the same shard
    rows = scratch.keep("rows", clean(vectors).withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int")))
    asked = scratch.keep("asked", clean(queries).groupBy("vec_id").agg(F.min("v").alias("v")))
    home = F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(shards)).cast("int")
    # first pass: each query meets one shard; its k-th score there bounds all others
    seen = scratch.keep("first", searched(rows, asked.withColumn("shard", home).withColumn("floor", F.lit(None).cast("long")), shards, k, scale))
    floors = seen.groupBy("query_id").agg(F.min("score").alias("floor"), F.count("*").alias("c")).where(F.col("c") >= k).select(F.col("query_id").alias("vec_id"), "floor")
    others = asked.join(floors, "vec_id", "left").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where(F.col("shard") != home)
    more = scratch.keep("more", searched(rows, others, shards, k, scale)) if shards > 1 else seen.limit(0)
    # at most k rows a query and shard meet here
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    scratch.drop("rows", "asked")
    return seen.union(more).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
