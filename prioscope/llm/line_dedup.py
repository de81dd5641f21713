"""Fuzzy line dedup by MinHash, with DataFrame and SQL functions only.

Lines are compared by a digest first. A distinct line is the set of its character shingles
(seven UTF-16 code units; a shorter line is one shingle). Its signature is the least half of a
shingle's hash under each of 24 masks. Fourteen bands of four signature places let a pair of
Jaccard similarity 0.8 meet with probability 0.993 (0.85: 0.999; 0.3: 0.1, so that chance
meetings stay few). Pairs that meet are verified by the exact Jaccard similarity of their
shingle sets, and a distributed union-find makes components, in each of which one line
stays: the first by document id and line number.

Before two sets are made, their bitmaps are compared: a shingle sets one of 2,048 bits, so the
sets differ in at least as many shingles as the bitmaps differ in bits. Where that alone
rules the similarity out, the pair is dropped; no similar pair is.

Shingles are folded into minima within the task that reads the line, so they are never
shuffled, and texts are cut again where they are needed rather than written. Texts and bitmaps
are looked up only for lines that met another; that list of ids is broadcast while it is
small (its size is counted) and shuffled beyond that. The two sets of a pair are made and
compared within its row.

Defined results: null texts have no lines and stay null; empty and blank lines are kept and
never compared; a row without id counts after all others; rows that repeat an id and a text
are copies of the same lines (all their copies of a kept line stay, as the place is the same),
while other texts of one id, or without id, have places of their own; only the
id and text columns are read, and other columns of ``dedup_lines`` are handed through.
"""

from __future__ import annotations

from functools import reduce

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prioscope.llm.common import SPACES
from prioscope.llm.components import bucket_components
from prioscope.session import materialize

SHINGLE = 7
MIN_JACCARD = 0.8
MASKS = 24
#: Bands: fours of the masks, in which a pair of masks recurs as little as possible.
BANDS = ((1, 8, 12, 13), (5, 16, 18, 20), (4, 15, 21, 23), (3, 6, 9, 10), (0, 2, 11, 14), (14, 16, 17, 22), (2, 7, 17, 19),
         (5, 8, 19, 22), (0, 1, 10, 15), (7, 13, 18, 23), (3, 4, 14, 20), (9, 11, 12, 18), (6, 16, 19, 21), (12, 17, 20, 21))
#: Longs of a line's bitmap.
WORDS = 32
#: Line ids that are broadcast at most (8 bytes each).
BROADCAST_IDS = 1 << 20

#: Shingles of a line that one row holds while signatures are made.
BLOCK = 4

_STEP = 2 * SHINGLE  # bytes of a shingle in UTF-16


def _masks() -> list[int]:
    return [xxhash.xxh32_intdigest(f"mask {i}".encode()) for i in range(MASKS)]


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, own, pos, line, h1, h2`` of every line that is not blank; ``own`` is the digest
    of the text, which tells texts of one id apart."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("own"), F.col(text_col).alias("text"))
    cut = texts.select("doc_id", "own", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return cut.where(F.btrim("line", F.lit(SPACES)) != "").select(
        "doc_id", "own", "pos", "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def signatures(all_lines: DataFrame) -> DataFrame:
    """``id, m0, m1, ...``: digest of each distinct line and the least hash of its shingles under
    each mask; the masks take the upper and the lower half of a hash in turn. A row holds a
    block of shingles, of which the least is taken before the rows are grouped; the last block
    repeats the last shingle."""
    units = all_lines.select("h1", F.encode("line", "UTF-16BE").alias("units"))
    sized = units.select("h1", "units", F.expr(f"greatest(1, octet_length(units) - {_STEP - 1})").alias("last"))
    at = sized.select(F.col("h1").alias("id"), "units", "last", F.expr(f"explode(sequence(1, last, {2 * BLOCK}))").alias("i"))
    hashed = at.select("id", *[F.expr(f"xxhash64(substring(units, least(i + {2 * j}, last), {_STEP}))").alias(f"h{j}") for j in range(BLOCK)])
    halves = hashed.select("id", *[half.alias(f"{k}{j}") for j in range(BLOCK) for k, half in (
        ("x", F.shiftrightunsigned(f"h{j}", 32)), ("y", F.col(f"h{j}").bitwiseAND(F.lit((1 << 32) - 1))))])
    least = halves.select("id", *[F.least(*[F.col(f"{'xy'[i % 2]}{j}").bitwiseXOR(F.lit(m)) for j in range(BLOCK)]).alias(f"m{i}")
                                  for i, m in enumerate(_masks())])
    return least.groupBy("id").agg(*[(F.min(f"m{i}") - (1 << 31)).cast("int").alias(f"m{i}") for i in range(MASKS)])


def bands(signed: DataFrame) -> DataFrame:
    """``bucket, id``: band values of every signature."""
    keys = [F.xxhash64(F.lit(i), *[f"m{j}" for j in band]) for i, band in enumerate(BANDS)]
    return signed.select(F.explode(F.array(*keys)).alias("bucket"), "id")


def bitmaps(texts: DataFrame) -> DataFrame:
    """``id, sketch`` of ``id, line``: the number ``n`` of a line's shingles, repeats included, and
    the bitmap ``w0, w1, ...`` in which each shingle sets a bit."""
    # rows of an id stay together, so both sums need no shuffle
    units = texts.repartition("id").select("id", F.encode("line", "UTF-16BE").alias("units"))
    at = units.select("id", "units", F.expr(f"explode(sequence(1, greatest(1, octet_length(units) - {_STEP - 1}), 2))").alias("i"))
    bits = at.select("id", F.xxhash64(F.substring("units", F.col("i"), F.lit(_STEP))).alias("h")).select(
        "id", F.shiftrightunsigned("h", 6).bitwiseAND(F.lit(WORDS - 1)).alias("k"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit"))
    words = bits.groupBy("id", "k").agg(F.bit_or("bit").alias("w"), F.count(F.lit(1)).alias("n"))
    row = words.groupBy("id").agg(F.sum("n").alias("n"), *[F.bit_or(F.when(F.col("k") == k, F.col("w")).otherwise(F.lit(0).cast("long"))).alias(f"w{k}") for k in range(WORDS)])
    return row.select("id", F.struct("n", *[f"w{k}" for k in range(WORDS)]).alias("sketch"))


def may_be_similar(x: Column, y: Column) -> Column:
    """False only for lines whose similarity is below ``MIN_JACCARD``. Of ``both`` shingles
    that the sets x and y have in sum, ``(1 - j) / (1 + j) * both`` at most are in one only at similarity
    j; bits in which the bitmaps differ are never more than these."""
    differ = reduce(Column.__add__, [F.bit_count(x[f"w{k}"].bitwiseXOR(y[f"w{k}"])) for k in range(WORDS)])
    return differ * (1 + MIN_JACCARD) <= (1 - MIN_JACCARD) * (x["n"] + y["n"]) + 1e-6


def _shingles(text: str) -> Column:
    """Digests of a text's distinct shingles."""
    units = F.encode(text, "UTF-16BE")
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.octet_length(units) - (_STEP - 1)), F.lit(2))
    # the outer lambda binds the units, so a line is encoded once
    return F.array_distinct(F.transform(F.array(units), lambda u: F.transform(at, lambda i: F.xxhash64(F.substring(u, i, F.lit(_STEP)))))[0])


def _similar(both: DataFrame) -> DataFrame:
    """``a, b`` of the rows ``a, b, x, y`` whose texts ``x`` and ``y`` have Jaccard similarity
    of shingles ``MIN_JACCARD`` or more. A row holds both sets of its pair."""
    sets = both.select("a", "b", _shingles("x").alias("x"), _shingles("y").alias("y"))
    sums = sets.select("a", "b", (F.size("x") + F.size("y")).alias("both"), F.size(F.array_intersect("x", "y")).alias("common"))
    return sums.where(F.col("common") >= MIN_JACCARD * (F.col("both") - F.col("common"))).select("a", "b")


def line_components(all_lines: DataFrame) -> DataFrame:
    """``node, component`` over the digests of distinct lines that have a near copy."""
    signed = materialize(signatures(all_lines), "signatures")
    found = {}

    def sketches(members: DataFrame) -> DataFrame:
        ids = materialize(members.select("id").distinct(), "ids")
        wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
        met = all_lines.join(wanted, all_lines.h1 == wanted.id).select("id", "line").dropDuplicates(["id"])
        found["texts"] = materialize(met, "texts")
        found["sketches"] = materialize(bitmaps(found["texts"]), "bitmaps")
        return found["sketches"]

    def verify(pairs: DataFrame) -> DataFrame:
        texts, s = found["texts"], found["sketches"]
        close = pairs.join(s.toDF("a", "p"), "a").join(s.toDF("b", "q"), "b").where(may_be_similar(F.col("p"), F.col("q")))
        return _similar(close.select("a", "b").join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b").select("a", "b", "x", "y"))

    return bucket_components(bands(signed), verify, may_be_similar, "sketch", sketches)


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, own, pos`` of every line that goes: not the first of its component."""
    all_lines = lines(docs, id_col, text_col)
    comp = line_components(all_lines)
    places = materialize(all_lines.select("doc_id", "own", "pos", "h1", "h2"), "places")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "pos", "own")
    first = places.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    # a line without near copies is its own component, told apart by both digests; one that
    # is not repeated either stays
    named = first.join(comp, first.h1 == comp.node, "left").where("n > 1 or component is not null")
    group = [F.coalesce("component", "h1").alias("c1"), F.when(F.col("component").isNull(), F.col("h2")).otherwise(F.lit(0)).alias("c2")]
    named = materialize(named.select("h1", "h2", *group, "first"), "named")
    kept = named.groupBy("c1", "c2").agg(F.min("first").alias("kept"))
    stays = named.join(kept, ["c1", "c2"]).select("h1", "h2", "kept")
    return (places.join(stays, ["h1", "h2"])
            .where(~place.eqNullSafe(F.col("kept"))).select("doc_id", "own", "pos"))


def _same_text(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> Column:
    return docs[id_col].eqNullSafe(gone["__doc"]) & (F.xxhash64(docs[text_col]) == gone["__own"])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its columns; near copies of earlier lines are gone from the texts, and
    documents of which every line went have an empty text."""
    gone = removed_lines(docs, id_col, text_col).groupBy(F.col("doc_id").alias("__doc"), F.col("own").alias("__own")).agg(F.collect_set("pos").alias("__gone"))
    joined = docs.join(gone, _same_text(docs, gone, id_col, text_col), "left")
    left = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda _, i: ~F.array_contains("__gone", i)), "\n")
    text = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(left)
    return joined.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns])


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_lines, n_removed, removed`` of every row: the numbers (from 0) of the lines
    that go, in order."""
    gone = removed_lines(docs, id_col, text_col).groupBy(F.col("doc_id").alias("__doc"), F.col("own").alias("__own")).agg(
        F.sort_array(F.collect_set("pos")).alias("removed"))
    n = F.coalesce(F.size(F.split(F.col(text_col), "\n")), F.lit(0))
    counted = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("own"), F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(n).alias("n_lines"))
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return counted.join(gone, counted.doc_id.eqNullSafe(gone["__doc"]) & (counted.own == gone["__own"]), "left").select(
        "doc_id", "n_lines", F.size(removed).alias("n_removed"), removed.alias("removed"))
