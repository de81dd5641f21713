"""Ranked lexical search as exact inner products over sparse ball trees.

A text's terms are its maximal runs of ASCII letters and digits (A-Z lower-cased) and of all
characters beyond ASCII. A document is a sparse vector of integer term impacts, a query one
of integer term weights; the score is their inner product. Only coordinates of query terms
count, so documents carry no others.

Vectors are dealt out by range of their heaviest terms, so documents that share rare terms
lie together, and every task streams its range in trees of 8,192 documents: leaves of 96 in
that order, eight children to a node, every node with the centroid of its documents and the
radius around it. For all x under a node q.x <= q'.c + |q'| r, where q' is q on the
centroid's terms (elsewhere the documents are zero). The bound is rounded up by more than
doubles can lose, and nodes are taken from a heap by their bound until it falls below the
k-th score found so far; leaves are scored in exact 64-bit integers. A first round over one
vector in 64 gives each query a score that its k-th best cannot fall below; a task passes its
own k-th scores on from tree to tree. Results of the tasks, at most k a query each, are ranked.

The query set may be of any size: it is taken in blocks of at most ``max_terms`` terms (or
one single query, which its own text bounds); only a block's terms and weights are broadcast,
and the documents' texts are read once for each block.

Defined results: null texts have no terms; a query without terms, or whose terms no document
holds, has no rows; repeated query rows are answered each for itself; repeated documents and
ids are candidates of their own; ids are whole numbers, null ones rank last among equal
scores; very long texts are read whole. Only the named columns are read.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prioscope.llm.common import arrow_map, find_package
from prioscope.session import materialize

#: Terms of a block of queries at most (unless one query alone has more).
MAX_TERMS = 1 << 18
TREE_DOCS = 8192
LEAF = 96
FAN = 8
#: One vector in so many is searched first for bounds.
SEED_SHARE = 64

_TO_TERM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """UTF-8 terms: bytes of other ASCII characters become spaces, bytes beyond ASCII stay."""
    return (text or "").encode("utf-8", "replace").translate(_TO_TERM).split()


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``q, item_id, terms, times`` of each query row, written once."""
    rows = queries.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).withColumn("q", F.monotonically_increasing_id())

    def run(c):
        found = [Counter(terms_of(t)) for t in c["text"]]
        return {"q": c["q"], "item_id": c["item_id"], "terms": [list(f) for f in found], "times": [list(f.values()) for f in found]}

    return materialize(arrow_map(rows, run, f"q long, item_id {dict(rows.dtypes)['item_id']}, terms array<binary>, times array<long>"), "queries")


def blocks_of(asked: DataFrame, max_terms: int) -> list[DataFrame]:
    """Blocks of whole queries dealt by a hash, none above ``max_terms`` unless it is one query."""
    size = F.size("terms")
    total = asked.agg(F.sum(size)).first()[0] or 0
    n = max(1, -(-total // max_terms))
    while True:
        block = F.pmod(F.xxhash64("q"), F.lit(n))
        over = asked.groupBy(block.alias("b")).agg(F.sum(size).alias("s"), F.count(F.lit(1)).alias("c")).where((F.col("s") > max_terms) & (F.col("c") > 1))
        if n == 1 and total <= max_terms or over.isEmpty():
            return [asked.where(block == b) for b in range(n)]
        n *= 2


class Block:
    """Queries of a block over its own vocabulary; ``weigh`` sets the terms' weights."""

    def __init__(self, rows: list):
        self.keys = [r["q"] for r in rows]
        self.vocabulary = {t: i for i, t in enumerate(sorted({bytes(t) for r in rows for t in r["terms"]}))}
        self.index = [np.array([self.vocabulary[bytes(t)] for t in r["terms"]], np.int64) for r in rows]
        self.times = [np.array(r["times"], np.int64) for r in rows]

    def weigh(self, df: dict[int, int], docs: int, length: int) -> None:
        self.docs, self.length = docs, max(length, 1)
        self.w = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(self.vocabulary))], np.int64)
        self.root = np.sqrt(self.w.astype(float))

    def impacts(self, n: int, tf: np.ndarray) -> np.ndarray:
        m = 100 - 25 + 25 * n * self.docs // self.length  # Python integers do not overflow
        return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def term_vectors(docs: DataFrame, sent, id_col: str, text_col: str) -> DataFrame:
    """``row, doc_id, n, idx, tf``: number of terms, and those of the block's vocabulary."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(c):
        known, n, idx, tf = sent.value.vocabulary, [], [], []
        for t in c["text"]:
            words = terms_of(t)
            held = Counter(filter(known.__contains__, words))
            at = sorted((known[w], x) for w, x in held.items())
            n.append(len(words))
            idx.append([i for i, _ in at])
            tf.append([x for _, x in at])
        return {"row": c["row"], "doc_id": c["doc_id"], "n": n, "idx": idx, "tf": tf}

    return materialize(arrow_map(rows, run, "row long, doc_id long, n long, idx array<int>, tf array<long>"), "vectors")


class BallTree:
    """Bulk-loaded over documents in the order given: ``starts``, ``idx`` and ``x`` are their
    sparse rows, coordinates scaled by ``root`` (the square root of the weights)."""

    def __init__(self, starts: np.ndarray, idx: np.ndarray, x: np.ndarray, root: np.ndarray, leaf: int = LEAF, fan: int = FAN):
        self.starts, self.idx, self.x = starts, idx, x
        self.n = len(starts) - 1
        self._v = x * root[idx]
        self._norms = np.add.reduceat(np.append(self._v * self._v, 0.0), starts[:-1]) if self.n else np.zeros(0)
        self._norms[starts[:-1] == starts[1:]] = 0.0
        self.width = len(root)
        self.nodes: list[tuple] = []  # (terms, centroid, radius, from, to, children)
        level = [self._node(a, min(a + leaf, self.n), None) for a in range(0, self.n, leaf)]
        while len(level) > 1:
            level = [self._node(self.nodes[part[0]][3], self.nodes[part[-1]][4], part) for part in (level[i:i + fan] for i in range(0, len(level), fan))]
        self.root = level[0] if level else None

    def _node(self, a: int, b: int, children) -> int:
        lo, hi = self.starts[a], self.starts[b]
        idx, v = self.idx[lo:hi], self._v[lo:hi]
        dense = np.bincount(idx, v, self.width) / (b - a)
        terms = np.unique(idx)
        centroid = dense[terms]
        dots = np.add.reduceat(np.append(v * dense[idx], 0.0), self.starts[a:b] - lo)
        dots[self.starts[a:b] == self.starts[a + 1:b + 1]] = 0.0
        c2 = float(centroid @ centroid)
        norms = self._norms[a:b]
        r2 = float((norms - 2 * dots).max() + c2) + 1e-11 * (float(norms.max()) + c2)
        self.nodes.append((terms, centroid, math.sqrt(max(r2, 0.0)) * (1 + 1e-11), a, b, children))
        return len(self.nodes) - 1

    def bound(self, number: int, q: np.ndarray) -> float:
        """Above every inner product of ``q`` (dense, scaled) with a document under the node."""
        terms, centroid, radius = self.nodes[number][:3]
        on = q[terms]
        top = float(on @ centroid) + math.sqrt(float(on @ on)) * radius
        return top * (1 + 1e-9) + 1e-6

    def search(self, q: np.ndarray, weights: np.ndarray, limit, found) -> int:
        """Best first: ``found(at, scores)`` takes the scores of a leaf's documents from position
        ``at`` on, ``limit()`` is the score below which nothing counts. Returns leaves scored."""
        if self.root is None:
            return 0
        done, order = 0, itertools.count()
        heap = [(-self.bound(self.root, q), next(order), self.root)]
        while heap:
            least, _, number = heapq.heappop(heap)
            if -least < limit():
                break
            _, _, _, a, b, children = self.nodes[number]
            if children is None:
                lo, hi = self.starts[a], self.starts[b]
                sums = np.add.reduceat(np.append(self.x[lo:hi] * weights[self.idx[lo:hi]], 0), self.starts[a:b] - lo)
                sums[self.starts[a:b] == self.starts[a + 1:b + 1]] = 0
                found(a, sums)
                done += 1
                continue
            for child in children:
                top = self.bound(child, q)
                if top >= limit():
                    heapq.heappush(heap, (-top, next(order), child))
        return done


class Best:
    """A query's k best (score, id, row) so far."""

    def __init__(self, k: int, floor: int):
        self.k, self.floor = k, floor
        self.score, self.null, self.id, self.row = (np.zeros(0, t) for t in (np.int64, bool, np.int64, np.int64))

    def limit(self) -> int:
        return self.floor

    def add(self, score, null, ids, rows) -> None:
        ok = score >= self.floor
        if not ok.any():
            return
        s, n, i, r = (np.concatenate([a, b[ok]]) for a, b in ((self.score, score), (self.null, null), (self.id, ids), (self.row, rows)))
        top = np.lexsort((r, i, n, -s))[:self.k]
        self.score, self.null, self.id, self.row = s[top], n[top], i[top], r[top]
        if len(top) == self.k:
            self.floor = max(self.floor, int(self.score[-1]))


_FOUND = pa.schema([("q", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def search(vectors: DataFrame, sent, floors, k: int, tree_docs: int = TREE_DOCS) -> DataFrame:
    """``q, row, doc_id, score``: at most k rows a query and task. ``vectors`` has ``row, doc_id, n,
    idx, tf`` in the order in which trees are made."""
    find_package(vectors.sparkSession)

    def trees(batches: Iterator[pa.RecordBatch]):
        held: list[pa.RecordBatch] = []
        for b in itertools.chain.from_iterable((b.slice(i, tree_docs) for i in range(0, b.num_rows, tree_docs)) for b in batches):
            if held and sum(x.num_rows for x in held) + b.num_rows > tree_docs:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b)
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        best = [Best(k, max(1, f)) for f in (floors.value if floors else [1] * len(block.keys))]
        weights, scaled = np.zeros(len(block.w), np.int64), np.zeros(len(block.w))
        for t in trees(batches):
            t = t.combine_chunks()
            idx = t["idx"].combine_chunks()
            starts = idx.offsets.to_numpy().astype(np.int64)
            starts, terms = starts - starts[0], idx.flatten().to_numpy().astype(np.int64)
            tf, n = t["tf"].combine_chunks().flatten().to_numpy(), t["n"].to_pylist()
            m = np.repeat(np.array([75 + 25 * x * block.docs // block.length for x in n], np.int64), np.diff(starts))
            tree = BallTree(starts, terms, 1_000_000_000 * tf // (1000 * tf + 12 * m), block.root)
            null = t["doc_id"].is_null().to_numpy()
            ids, rows = t["doc_id"].fill_null(0).to_numpy(), t["row"].to_numpy()
            for at, times, b in zip(block.index, block.times, best):
                weights[at], scaled[at] = block.w[at] * times, block.root[at] * times

                def found(a, s):
                    b.add(s, null[a:a + len(s)], ids[a:a + len(s)], rows[a:a + len(s)])

                tree.search(scaled, weights, b.limit, found)
                weights[at], scaled[at] = 0, 0.0
        for key, b in zip(block.keys, best):
            if len(b.score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.score), key)), pa.array(b.row), pa.array(b.id, mask=b.null), pa.array(b.score)], schema=_FOUND)

    return vectors.select("row", "doc_id", "n", "idx", "tf").mapInArrow(run, "q long, row long, doc_id long, score long")


def ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "row"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)


def in_order(vectors: DataFrame, sent) -> DataFrame:
    """Vectors that hold a term, dealt out and sorted by their three heaviest terms."""

    def run(c):
        block, heavy = sent.value, []
        for n, idx, tf in zip(c["n"], c["idx"], c["tf"]):
            at = np.array(idx, np.int64)
            worth = block.w[at] * block.impacts(n, np.array(tf, np.int64))
            top = at[np.argsort(-worth, kind="stable")[:3]].tolist()
            heavy.append(top + [-1] * (3 - len(top)))
        return {**{x: c[x] for x in ("row", "doc_id", "n", "idx", "tf")}, **{f"k{i}": [h[i] for h in heavy] for i in range(3)}}

    keyed = arrow_map(vectors.where(F.size("idx") > 0), run, "row long, doc_id long, n long, idx array<int>, tf array<long>, k0 int, k1 int, k2 int")
    return keyed.repartitionByRange("k0", "k1", "k2", "row").sortWithinPartitions("k0", "k1", "k2", "row")


def top_k(queries: DataFrame, docs: DataFrame, k: int = 20, query_id: str = "item_id", query_text: str = "text", id_col: str = "doc_id",
          text_col: str = "text", max_terms: int = MAX_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: each query row's k documents of highest score above 0."""
    spark = docs.sparkSession
    asked = query_terms(queries, query_id, query_text)
    out = []
    for part in blocks_of(asked.where(F.size("terms") > 0), max_terms):
        block = Block(part.select("q", "terms", "times").orderBy("q").collect())  # within max_terms
        known = spark.sparkContext.broadcast(block)
        vectors = term_vectors(docs, known, id_col, text_col)
        total = vectors.where("n > 0").agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
        df = vectors.select(F.explode("idx").alias("i")).groupBy("i").count().collect()  # as many as the block has terms
        block.weigh({r["i"]: r["count"] for r in df}, total["docs"], total["length"])
        sent = spark.sparkContext.broadcast(block)
        sample = vectors.where((F.size("idx") > 0) & (F.pmod(F.xxhash64("row"), F.lit(SEED_SHARE)) == 0))
        kth = {r["q"]: r["score"] for r in ranked(search(sample, sent, None, k), k).where(F.col("rank") == k).select("q", "score").collect()}
        floors = spark.sparkContext.broadcast([kth.get(q, 1) for q in block.keys])
        out.append(materialize(ranked(search(in_order(vectors, sent), sent, floors, k), k), "ranked"))
    found = out[0]
    for more in out[1:]:
        found = found.union(more)
    return found.join(asked.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score")
