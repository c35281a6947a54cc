"""Exact top-k search: a KD-tree per shard of rows, best-first traversal, a propagated k-th score.

Vectors are integers. The score is the inner product; a box's bound for a query is the highest inner product of any point in
it. Queries come in blocks of QUERIES; each block passes over all rows, which are cut into shards as they stream, so memory
is bounded by a block and a shard. The k-th best score of a query so far prunes the later shards of a task, and starts
from the scores among the block's own vectors.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import frees

QUERIES, SHARD, LEAF = 4096, 16_384, 64


class Tree:
    """Median splits of the widest side; every node has its tight bounding box."""

    def __init__(self, points: np.ndarray, ids: np.ndarray):
        order = np.arange(len(points))
        self.span, self.child, low, high = [], [], [], []
        todo = [(0, len(points), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            own = points[order[a:b]]
            lo, hi = own.min(axis=0), own.max(axis=0)
            me = len(self.span)
            self.span.append((a, b))
            self.child.append([-1, -1])
            low.append(lo)
            high.append(hi)
            if parent >= 0:
                self.child[parent][side] = me
            wide = int((hi - lo).argmax())
            if b - a > LEAF and hi[wide] > lo[wide]:
                mid = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, wide], mid)]
                todo += [(a, a + mid, me, 0), (a + mid, b, me, 1)]
        self.low, self.high = np.array(low), np.array(high)
        self.points, self.ids = points[order], ids[order]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """(node, query): no point of the node scores higher."""
        return self.high @ np.maximum(queries, 0).T + self.low @ np.minimum(queries, 0).T


class Best:
    """The k best (score, id) of each query: higher scores first, ties to smaller ids."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor
        self.score = [np.zeros(0) for _ in range(n)]
        self.id = [np.zeros(0, np.int64) for _ in range(n)]

    def add(self, q: int, score: np.ndarray, ids: np.ndarray) -> None:
        keep = score >= self.floor[q]
        if not keep.any():
            return
        s, i = np.concatenate([self.score[q], score[keep]]), np.concatenate([self.id[q], ids[keep]])
        top = np.lexsort((i, -s))[: self.k]
        self.score[q], self.id[q] = s[top], i[top]
        if len(top) == self.k:
            self.floor[q] = max(self.floor[q], s[top[-1]])


def search(tree: Tree, queries: np.ndarray, query_ids: np.ndarray, best: Best) -> None:
    bound = tree.bounds(queries)
    for q in range(len(queries)):
        own, vector = bound[:, q].tolist(), queries[q]
        heap = [(-own[0], 0)]
        while heap:
            b, node = heapq.heappop(heap)
            if -b < best.floor[q]:
                break
            if tree.child[node][0] < 0:
                a, z = tree.span[node]
                ids = tree.ids[a:z]
                other = ids != query_ids[q]
                best.add(q, (tree.points[a:z] @ vector)[other], ids[other])
            else:
                for c in tree.child[node]:
                    if own[c] >= best.floor[q]:
                        heapq.heappush(heap, (-own[c], c))


def quantise(col: pa.ListArray, ids: np.ndarray, scale: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension: (ids, floor(scale * x)). Vectors that are null or hold null or non-finite components are left out."""
    n = len(col)
    if not n:
        return {}
    size = np.array(col.value_lengths().fill_null(-1))
    flat = col.flatten()
    value = np.array(flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False), float)
    at = np.concatenate([[0], np.cumsum(np.maximum(size, 0))])
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(value))])
    ok = (size > 0) & (bad[at[1:]] == bad[at[:-1]])
    out = {}
    for d in np.unique(size[ok]).tolist():
        own = np.flatnonzero(ok & (size == d))
        points = np.floor(scale * value[at[own][:, None] + np.arange(d)])
        out[d] = (ids[own], points)
    return out


def refuse_inexact(points: np.ndarray, queries: np.ndarray) -> None:
    """Scores are sums in double precision, exact as long as no partial sum can reach 2**53."""
    if len(points) and len(queries) and (np.abs(points).max(axis=0) * np.abs(queries).max(axis=0)).sum() >= 2.0**53:
        raise ValueError("components so large that inner products are not exact in double precision (2**53)")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products of floor(scale * x) over all other rows.

    Ties go to smaller ids. A candidate has another id than the query, and its dimension. Rows with a null id or vector, or with null
    or non-finite components, take no part, nor do empty vectors; a query that takes no part gives no rows, one with
    fewer than k candidates all of them. Repeated candidates count each; repeated query ids count once (their first vector in
    value order). Scores are exact; components so large that they could not be (2**53) are refused with an error. Other columns are ignored."""
    spark = vectors.sparkSession
    pick = lambda d: d.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")).where("id is not null and v is not null")
    rows, asked = pick(vectors), pick(queries)
    parts = max(1, -(-asked.count() // QUERIES))
    out = None
    for part in range(parts):
        got = asked.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).groupBy("id").agg(F.min("v").alias("v")).orderBy("id").toArrow().combine_chunks()
        mine = spark.createDataFrame(pa.Table.from_batches([got]) if isinstance(got, pa.RecordBatch) else got)
        there = rows.join(F.broadcast(mine), ["id", "v"]).select("id").distinct().toArrow().column("id").to_numpy()  # queries that are candidates too
        block = quantise(got.column("v").combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.float64())), got.column("id").to_numpy(), scale)
        held = {}
        for d, (ids, points) in block.items():
            floor = np.full(len(ids), -np.inf)
            known = np.isin(ids, there)
            refuse_inexact(points, points)
            if known.sum() > k:
                for q in range(len(ids)):
                    s = points @ points[q]
                    s[~known] = -np.inf
                    s[q] = -np.inf
                    floor[q] = np.partition(s, len(s) - k)[len(s) - k]
            held[d] = (ids, points, floor)
        where = spark.sparkContext.broadcast(held)  # QUERIES vectors at most

        def run(batches: Iterator[pa.RecordBatch], where=where) -> Iterator[pa.RecordBatch]:
            best = {d: Best(len(ids), k, floor.copy()) for d, (ids, _, floor) in where.value.items()}
            wait: dict[int, list] = {d: [] for d in best}

            def flush(d: int) -> None:
                ids, points = (np.concatenate(x) for x in zip(*wait[d], strict=True))
                wait[d] = []
                refuse_inexact(points, where.value[d][1])
                search(Tree(points, ids), where.value[d][1], where.value[d][0], best[d])

            for b in batches:
                for d, own in quantise(b.column(1), b.column(0).to_numpy(), scale).items():
                    if d in wait:
                        for i in range(0, len(own[0]), SHARD):
                            wait[d].append((own[0][i : i + SHARD], own[1][i : i + SHARD]))
                            if sum(len(x) for x, _ in wait[d]) >= SHARD:
                                flush(d)
            for d in best:
                if wait[d]:
                    flush(d)
                n = [len(x) for x in best[d].id]
                if sum(n):
                    yield pa.record_batch([pa.array(np.repeat(where.value[d][0], n)), pa.array(np.concatenate(best[d].id)), pa.array(np.concatenate(best[d].score).astype(np.int64))], ["query_id", "vec_id", "score"])

        one = rows.mapInArrow(frees(run), "query_id long, vec_id long, score long")
        out = one if out is None else out.union(one)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
