"""SimHash near-dedup with pivot distance tables.

Fingerprints are compared as classes of equal values. Candidates share ``keep`` of ``keep`` + 4
bit blocks: four differing bits touch at most four blocks, so no pair within the limit is
lost. ``keep`` follows the number of fingerprints (two blocks of 21 bits up to 44,000, three of
27 up to 1.2 million, four of 32 up to 15 million, ...), so that chance meetings stay far below
one a fingerprint. Each fingerprint's Hamming distances to the pivots (reference fingerprints) are
its row of the distance table. The row travels with the candidate keys, and where two
candidates meet, the pair is discarded if their coordinates differ anywhere by more than
the limit (triangle inequality); only survivors are verified bit by bit. Dense groups cost one
link per member (see ``components``).

Defined results: null and empty texts have fingerprint zero, linked like any other; a row
without id has the smallest id of its component (null if there is none); repeated rows
share their fingerprint. Only the id and text columns are read.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prioscope.llm.common import arrow_map, numbered, words_of
from prioscope.llm.components import bucket_components
from prioscope.session import materialize

SHINGLE = 4
MAX_BITS = 4
HASH_SEED = 42
PIVOTS = 16
_PART = 4096


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint: a bit is set if over half of the shingle hashes set it."""
    words = words_of(text)
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, HASH_SEED)
    lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = (ends - lens)[: len(words) - shingle + 1].tolist()
    stops = ends[shingle - 1:].tolist()
    digest, n = xxhash.xxh64_intdigest, len(starts)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, _PART):  # memory stays bounded for very long texts
        h = np.array([digest(joined[a:b], HASH_SEED) for a, b in zip(starts[i:i + _PART], stops[i:i + _PART])], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(ones * 2 > n).tolist()))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def pivots(n: int = PIVOTS) -> list[int]:
    """Reference fingerprints, drawn by a fixed rule: XXH64 of the pivot's number."""
    return [_signed(xxhash.xxh64_intdigest(str(i).encode(), HASH_SEED)) for i in range(n)]


def _blocks(bits: int) -> list[tuple[int, int]]:
    edges = [round(i * 64 / bits) for i in range(bits + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _masked(fp: Column, blocks) -> Column:
    mask = sum(((1 << n) - 1) << at for at, n in blocks)
    return fp.bitwiseAND(F.lit(_signed(mask)))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)`` with the fingerprint as a signed long."""
    kind = dict(docs.dtypes)[id_col]
    return arrow_map(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")),
                     lambda c: {"doc_id": c["doc_id"], "fp": [_signed(fingerprint(t, shingle)) for t in c["text"]]},
                     f"doc_id {kind}, fp long")


def blocks_kept(n: int, max_bits: int = MAX_BITS) -> int:
    """How many bit blocks make a key, so that of ``n`` fingerprints each meets an unlike one in an
    eighth of a chance: n / 2 pairs a fingerprint, times the keys, over 2 ** bits of a key. Real
    fingerprints are less evenly spread than that, so the margin is wide."""
    keep = 2
    while keep < 8 and 4 * n * comb(max_bits + keep, keep) > 2 ** (64 * keep / (max_bits + keep)):
        keep += 1
    return keep


def _packed(coords: list[Column]) -> list[Column]:
    """Coordinates (0 to 64) as bytes of longs, eight in each."""
    return [reduce(Column.bitwiseOR, [F.shiftleft(c.cast("long"), 8 * i) for i, c in enumerate(coords[at:at + 8])]) for at in range(0, len(coords), 8)]


def link_fingerprints(fps: DataFrame, max_bits: int = MAX_BITS, n_pivots: int = PIVOTS, keep: int | None = None) -> DataFrame:
    """``(node, component)`` over distinct fingerprints ``fp`` that have a link."""
    coords = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))) for p in pivots(n_pivots)]
    table = F.struct(*[c.alias(f"t{i}") for i, c in enumerate(_packed(coords))])
    nodes = materialize(fps.select("fp").distinct().select("fp", table.alias("at")), "pivots")
    keep = keep or blocks_kept(nodes.count(), max_bits)
    parts = _blocks(max_bits + keep)
    keys = [F.xxhash64(F.lit(i), _masked(F.col("fp"), some)) for i, some in enumerate(combinations(parts, keep))]
    members = nodes.select(F.explode(F.array(*keys)).alias("bucket"), F.col("fp").alias("id"), "at")

    def near(x: Column, y: Column) -> Column:
        """Largest difference of the two table rows within the limit."""
        def byte(row, i):
            return F.shiftrightunsigned(row[f"t{i // 8}"], 8 * (i % 8)).bitwiseAND(F.lit(255))
        return reduce(Column.__and__, [F.abs(byte(x, i) - byte(y, i)) <= max_bits for i in range(n_pivots)])

    def verify(pairs: DataFrame) -> DataFrame:
        return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits).select("a", "b")

    return bucket_components(members, verify, near, "at")


def near_dedup(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, n_pivots: int = PIVOTS,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row: texts whose fingerprints differ
    in at most ``max_bits`` bits are linked; a component is named by its smallest id."""
    fps = materialize(fingerprints(docs, shingle, id_col, text_col), "fps")
    firsts = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    comp = link_fingerprints(fps, max_bits, n_pivots)
    named = firsts.join(comp, firsts.fp == comp.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("c"))
    least = named.groupBy("c").agg(F.min("first").alias("component_id"))
    by_fp = named.join(least, "c").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, n_pivots: int = PIVOTS,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component of near copies: the one with the smallest id, rows
    without id last; among rows of one id by the digest of the text. Each row counts for
    itself, also when it repeats another or shares its id with another text."""
    rows = numbered(docs)
    found = near_dedup(rows, shingle, max_bits, n_pivots, "__row", text_col)
    order = rows.select(F.col("__row").alias("row"), F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id"),
                                                              F.xxhash64(text_col).alias("tie"), "__row").alias("place"))
    first = found.join(order, found.doc_id == order.row).groupBy("component_id").agg(F.min("place").alias("first"))
    stays = first.select(F.col("first.__row").alias("__row"))
    return rows.join(stays, "__row", "left_semi").select(docs.columns)
