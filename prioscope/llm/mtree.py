"""Exact top-k by inner product with M-trees and best-first search.

A vector becomes a point of a metric space by one more coordinate, sqrt(M^2 - |x|^2), where
M is the largest norm of its group: then the distance to the query falls as the inner
product rises. Every group of rows is one M-tree: pages of entries under a routing object
with a covering radius, every entry with its stored distance to its parent. The search of a
query takes nodes from a heap by their least possible distance, and skips entries whose
distance the stored parent distances already bound (triangle inequality) without computing
it. Scores of the rows that remain are exact integer inner products.

Spark deals the rows out to groups of bounded size and the queries to blocks of bounded
size; one task searches one group's tree for one block at a time and returns k rows per
query. A query's best over all groups are then ranked. Work grows with queries times
groups, never through one task.

Defined results: vectors that are null, empty or hold null or non-finite components take no
part; vectors of another length than the query's are not its candidates; ties go to the
smaller id; rows that repeat an id are separate candidates, but none with the query's own
id; query rows that are equal are one query, and different vectors under one query id are
queries of their own (each has its ranks); fewer candidates than k give fewer rows.
"""

from __future__ import annotations

import heapq
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prioscope.llm.common import find_package
from prioscope.session import materialize

SCALE = 1024
#: Entries of a page, rows of one tree, queries of one block.
PAGE = 64
GROUP_ROWS = 16_384
BLOCK_QUERIES = 1024
#: Components up to this size keep inner products exact in 64-bit integers and 53-bit doubles.
SAFE = 1 << 22


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, v array<double>`` with floor(1024 x) per component, usable vectors only."""
    v = F.col(vector_col).cast("array<double>")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    grid = F.transform(v, lambda x: F.floor(x * SCALE).cast("double"))
    return vectors.where(fine & F.col(id_col).isNotNull()).select(F.col(id_col).alias("vec_id"), grid.alias("v"))


class MTree:
    """Bulk-loaded M-tree over the rows of ``points``."""

    def __init__(self, points: np.ndarray, page: int = PAGE):
        self.points = points
        self.page = page
        self.nodes: list[dict] = []
        self.root = self._build(np.arange(len(points)), None)

    def _distances(self, rows: np.ndarray, to: np.ndarray) -> np.ndarray:
        d = self.points[rows] - to
        return np.sqrt(np.einsum("ij,ij->i", d, d))

    def _build(self, rows: np.ndarray, parent: int | None) -> int:
        """Node over ``rows`` (positions) routed by the point ``parent``; returns its number."""
        n = len(rows)
        if n <= self.page:
            to = self._distances(rows, self.points[parent]) if parent is not None else np.zeros(n)
            self.nodes.append({"leaf": True, "rows": rows, "to_parent": to})
            return len(self.nodes) - 1
        # routing objects far from one another, then every row joins the nearest one
        fan = min(self.page, max(2, -(-n // self.page)))
        first = int(rows[0])
        pivots, near, owner = [first], self._distances(rows, self.points[first]), np.zeros(n, np.int64)
        while len(pivots) < fan:
            far = int(near.argmax())
            if near[far] <= 0:
                break
            pivots.append(int(rows[far]))
            d = self._distances(rows, self.points[pivots[-1]])
            closer = d < near
            near[closer], owner[closer] = d[closer], len(pivots) - 1
        if len(pivots) == 1:  # only equal points: pages of them under one routing object
            parts = [rows[i:i + self.page] for i in range(0, n, self.page)]
            if len(parts) > self.page:
                size = -(-n // self.page)
                parts = [rows[i:i + size] for i in range(0, n, size)]
            groups = [(first, part, 0.0) for part in parts]
        else:
            groups = [(p, rows[owner == i], float(near[owner == i].max())) for i, p in enumerate(pivots)]
        children = np.array([self._build(part, p) for p, part, _ in groups], np.int64)
        routing = np.array([p for p, _, _ in groups], np.int64)
        to = self._distances(routing, self.points[parent]) if parent is not None else np.zeros(len(groups))
        self.nodes.append({"leaf": False, "rows": routing, "to_parent": to, "children": children,
                           "radius": np.array([r for _, _, r in groups])})
        return len(self.nodes) - 1

    def search(self, query: np.ndarray, better, limit) -> int:
        """Best-first search. ``better(rows)`` takes leaf rows whose distance may count;
        ``limit()`` is the distance beyond which nothing counts. Returns distances computed."""
        done, order = 0, itertools.count()
        heap = [(0.0, next(order), self.root, None)]  # least distance, tie, node, distance to its routing object
        while heap:
            least, _, number, at = heapq.heappop(heap)
            far = limit()
            if least > far:
                break
            node = self.nodes[number]
            rows = node["rows"]
            slack = np.zeros(len(rows)) if node["leaf"] else node["radius"]
            if at is not None:  # |d(q, parent) - d(entry, parent)| bounds d(q, entry) from below
                open_ = np.abs(at - node["to_parent"]) - slack <= far
            else:
                open_ = np.ones(len(rows), bool)
            if not open_.any():
                continue
            d = self._distances(rows[open_], query)
            done += len(d)
            if node["leaf"]:
                hit = d <= far
                if hit.any():
                    better(rows[open_][hit])
                continue
            bounds = np.maximum(d - slack[open_], 0.0)
            for b, x, child in zip(bounds.tolist(), d.tolist(), node["children"][open_].tolist()):
                if b <= far:
                    heapq.heappush(heap, (b, next(order), child, x))
        return done


def _exact(vectors: np.ndarray, query: np.ndarray) -> list[int]:
    if max(np.abs(vectors).max(initial=0), np.abs(query).max(initial=0)) <= SAFE:
        return (vectors.astype(np.int64) @ query.astype(np.int64)).tolist()
    q = [int(x) for x in query]
    return [sum(int(a) * b for a, b in zip(row, q)) for row in vectors]


def search_group(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int,
                 asks: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(query id, id, score, query number) of each query's k best among the rows of one group."""
    norms = np.einsum("ij,ij->i", vectors, vectors)
    m2 = float(norms.max())
    tree = MTree(np.concatenate([vectors, np.sqrt(np.maximum(m2 - norms, 0.0))[:, None]], axis=1))
    out = []
    for qid, ask, q in zip(query_ids.tolist(), asks.tolist(), queries):
        best: list[tuple[int, int]] = []  # heap of (score, -id), worst first
        q2 = float(q @ q)

        def better(rows):
            for i, s in zip(ids[rows].tolist(), _exact(vectors[rows], q)):
                if i == qid:
                    continue
                if len(best) < k:
                    heapq.heappush(best, (s, -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (s, -i))

        def limit():
            if len(best) < k:
                return np.inf
            # d^2 = |q|^2 + M^2 - 2 s at the k-th score, with room for rounding and for ties
            d2 = max(q2 + m2 - 2.0 * best[0][0], 0.0)
            return float(np.sqrt(d2 + 1e-9 * (q2 + m2) + 1e-9))

        tree.search(np.append(q, 0.0), better, limit)
        out += [(qid, -i, s, ask) for s, i in best]
    return out


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 10, group_rows: int = GROUP_ROWS,
          block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score``; both inputs as made by ``quantised``."""
    find_package(vectors.sparkSession)
    # equal query rows are one query; ``ask`` tells apart the vectors of one id
    queries = materialize(queries.select("vec_id", "v").distinct().withColumn("ask", F.monotonically_increasing_id()), "queries")
    n, nq = vectors.count(), queries.count()
    groups, blocks = max(1, -(-n // group_rows)), max(1, -(-nq // block_queries))
    # rows go to groups by a hash; a block of queries meets every group, a group every block
    rows = vectors.select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(groups)).cast("int").alias("g"),
                          F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), F.size("v").alias("dim"), "vec_id", "v")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"),
                           F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int").alias("b"), F.size("v").alias("dim"), "ask", "vec_id", "v")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            left, right = left.sort_values("vec_id"), right.sort_values(["vec_id", "ask"])
            found = search_group(left["vec_id"].to_numpy(np.int64), np.stack(left["v"].to_numpy()).astype(np.float64),
                                 right["vec_id"].to_numpy(np.int64), np.stack(right["v"].to_numpy()).astype(np.float64), k, right["ask"].to_numpy(np.int64))
        low, high = -(1 << 63), (1 << 63) - 1
        return pd.DataFrame({"query_id": np.array([f[0] for f in found], np.int64), "vec_id": np.array([f[1] for f in found], np.int64),
                             "score": np.array([min(max(f[2], low), high) for f in found], np.int64), "ask": np.array([f[3] for f in found], np.int64)})

    keys = ["g", "b", "dim"]
    near = rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score long, ask long")
    rank = F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
