"""Embedding near-dedup with cross-polytope hashing.

A vector is rotated by random signs and fast Hadamard transforms (three rounds each); its
nearest corners of the cross-polytope (the coordinates of largest size, with their signs)
are its hash. A table concatenates three corners. Multiprobe: a vector is entered not only
under its nearest corners but also under the next best combinations, so two vectors meet
when any of their entries agree (at cosine 0.9 with probability about 0.995, see the tests). Pairs
that meet are verified by their cosine in double precision.

Equal vectors are one class: its smallest id and its size, never a list of its ids. Ids find
their class by a 128-bit digest of the vector; the few classes with over a HOT share of the
rows are broadcast, so their members are not dealt to one task. Entries that meet no other are dropped before vectors are
attached. A large bucket is split into blocks, and pairs of blocks are compared by
different tasks. A pair that meets in several buckets counts in the least of them only, so
numbers of links need no list of pairs: tasks return sums per vector and a spanning forest.

Defined results: vectors that are null, empty, zero or hold null or non-finite components,
and rows without id, link with nothing; vectors of different lengths do not link; rows that
repeat an id with one vector count once, with several the least vector counts; an empty
table gives an empty result. Only the id and vector columns are read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prioscope.llm.common import arrow_map, find_package
from prioscope.llm.components import connected_components
from prioscope.session import materialize

MIN_COSINE = 0.9
TABLES = 5
CORNERS = 3
#: Corners kept per polytope, and the largest sum of their ranks in an entry.
TOP, RANKS = 3, 2
SEED = 42
#: Rows of a bucket that are compared in one block.
BLOCK = 512
#: Share of the rows from which a class of equal vectors is broadcast to its members.
HOT = 1 / 1024
_ENTRIES = [c for c in itertools.product(range(TOP), repeat=CORNERS) if sum(c) <= RANKS]


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def entries(x: np.ndarray, tables: int = TABLES) -> np.ndarray:
    """Keys of each row (rows x tables * entries), different for different tables."""
    n, width = x.shape
    d = max(8, 1 << (width - 1).bit_length())
    x = np.concatenate([x, np.zeros((n, d - width))], axis=1)
    rng, out = np.random.default_rng([SEED, d]), []
    for t in range(tables):
        corners = []
        for _ in range(CORNERS):
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], d))
            best = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :TOP]
            corners.append(2 * best + (np.take_along_axis(y, best, 1) > 0))
        for c in _ENTRIES:
            key = np.full(n, t, np.int64)
            for j, rank in enumerate(c):
                key = key * (2 * d) + corners[j][:, rank]
            out.append(key)
    return np.stack(out, axis=1)


def _forest(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = x = root.get(root[x], root[x])
        return x

    out = []
    for x, y in zip(a, b):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def compare(rows: dict[str, np.ndarray], min_cosine: float = MIN_COSINE) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """Links of rows sorted by group: sums of linked vectors per id, and a spanning forest.
    Two rows are compared if they share the group and are of its two sides (side -1: all)."""
    v, key, group, side = rows["v"], rows["key"], rows["group"], rows["side"]
    sums: dict[int, int] = {}
    firsts, seconds = [], []
    for shift in range(1, len(group)):
        at = np.flatnonzero(group[shift:] == group[:-shift])
        if not len(at):
            break
        at = at[(side[at] < 0) | (side[at] != side[at + shift])]
        for part in np.array_split(at, -(-len(at) // 65536)) if len(at) else []:
            hit = part[np.einsum("ij,ij->i", v[part], v[part + shift]) >= min_cosine]
            for some in np.array_split(hit, -(-len(hit) // 4096)) if len(hit) else []:
                x, y = key[some], key[some + shift]
                same = (x[:, :, None] == y[:, None, :]).any(axis=2)
                least = np.where(same, x, np.iinfo(np.int64).max).min(axis=1)
                some = some[least == rows["bucket"][some]]  # count a pair in its least bucket only
                a, b = rows["id"][some], rows["id"][some + shift]
                for i, n in zip(np.concatenate([a, b]).tolist(), np.concatenate([rows["n"][some + shift], rows["n"][some]]).tolist()):
                    sums[i] = sums.get(i, 0) + n
                firsts += a.tolist()
                seconds += b.tolist()
    return sums, _forest(firsts, seconds)


_OUT = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])


def _compare_batches(batches: Iterator[pa.RecordBatch], min_cosine: float) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (dim, bucket, low, high); a group that a batch cuts is carried on."""
    held: pa.Table | None = None

    def result(t: pa.Table) -> pa.RecordBatch:
        ids = [t[c].to_numpy() for c in ("dim", "bucket", "low", "high")]
        new = np.any([x[1:] != x[:-1] for x in ids], axis=0)
        group = np.concatenate([[0], np.cumsum(new)])
        out = {"a": [], "b": [], "links": []}
        for dim in np.unique(ids[0]):
            pick = ids[0] == dim
            v = np.stack([np.frombuffer(x, "<f8") for x in t["v"].filter(pa.array(pick)).to_pylist()])
            key = np.stack([np.frombuffer(x, "<i8") for x in t["key"].filter(pa.array(pick)).to_pylist()])
            low, high, own = ids[2][pick], ids[3][pick], t["own"].to_numpy()[pick]
            sums, forest = compare({"v": v, "key": key, "group": group[pick], "bucket": ids[1][pick], "id": t["id"].to_numpy()[pick],
                                    "n": t["n"].to_numpy()[pick], "side": np.where(low == high, -1, own)}, min_cosine)
            for i, n in sums.items():
                out["a"].append(i), out["b"].append(None), out["links"].append(n)
            for a, b in forest:
                out["a"].append(a), out["b"].append(b), out["links"].append(0)
        return pa.RecordBatch.from_pydict(out, schema=_OUT)

    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t])
        ids = [t[c].to_numpy() for c in ("dim", "bucket", "low", "high")]
        cuts = np.flatnonzero(np.any([x[1:] != x[:-1] for x in ids], axis=0)) + 1
        at = int(cuts[-1]) if len(cuts) else 0
        held = t.slice(at)
        if at:
            yield result(t.slice(0, at).combine_chunks())
    if held is not None and len(held):
        yield result(held.combine_chunks())


def near_dedup(vectors: DataFrame, min_cosine: float = MIN_COSINE, tables: int = TABLES, block: int = BLOCK,
               id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``."""
    find_package(vectors.sparkSession)
    v = F.col(vector_col).cast("array<double>")
    fine = (v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
            & F.col(id_col).isNotNull())
    own = F.transform(vector_col, lambda x: F.when(x == 0, F.lit(0)).otherwise(x))  # one zero
    one = vectors.where(fine).select(F.col(id_col).alias("vec_id"), own.cast(dict(vectors.dtypes)[vector_col]).alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))
    one = materialize(one.select("vec_id", "v", F.xxhash64("v").alias("d1"), F.xxhash64(F.lit(1), "v").alias("d2")), "members")
    member = materialize(one.groupBy("d1", "d2", "v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"))
                         .withColumn("v", F.col("v").cast("array<double>")), "classes")

    def hashed(c):
        out = {"id": c["id"], "n": c["n"], "v": [None] * len(c["id"]), "key": [None] * len(c["id"])}
        sizes = np.array([len(x) for x in c["v"]])
        for dim in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == dim)
            x = np.array([c["v"][i] for i in at], np.float64)
            x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
            x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
            keys = entries(x, tables)
            for i, row, k in zip(at.tolist(), x, keys):
                out["v"][i], out["key"][i] = row.astype("<f8").tobytes(), k.astype("<i8").tobytes()
        out["dim"], out["buckets"] = sizes.tolist(), [np.frombuffer(k, "<i8").tolist() for k in out["key"]]
        return out

    nodes = materialize(arrow_map(member.select("id", "n", "v"), hashed, "id long, n long, v binary, key binary, dim int, buckets array<long>"), "hashes")
    spread = nodes.select("dim", F.explode("buckets").alias("bucket"), "id")
    sizes = spread.groupBy("dim", "bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    blocks = F.ceil(F.col("size") / block).cast("int")
    met = spread.join(sizes, ["dim", "bucket"]).withColumn("own", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    met = met.select("dim", "bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "id")
    full = met.join(nodes.select("id", "n", "v", "key"), "id")
    sorted_ = full.repartition("dim", "bucket", "low", "high").sortWithinPartitions("dim", "bucket", "low", "high")
    found = materialize(sorted_.mapInArrow(lambda b: _compare_batches(b, min_cosine), "a long, b long, links long"), "links")
    links = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "id")
    comp = connected_components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "id")
    known = (member.select("id", "n", "d1", "d2").join(links, "id", "left").join(comp, "id", "left")
             .select("d1", "d2", "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id")))
    known = materialize(known, "known")
    ids = one.select(F.col("vec_id").alias("__id"), "d1", "d2")
    least = max(2, ids.count() * HOT)
    hot = F.broadcast(known.where(F.col("n") > least))  # fewer than 1 / HOT classes
    named = ids.join(hot, ["d1", "d2"]).unionByName(
        ids.join(hot.select("d1", "d2"), ["d1", "d2"], "left_anti").join(known.where(F.col("n") <= least), ["d1", "d2"]))
    named = named.select("__id", "n_links", "component_id")
    rows = vectors.select(F.col(id_col).alias("vec_id"))
    return rows.join(named, rows.vec_id == named["__id"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"))
