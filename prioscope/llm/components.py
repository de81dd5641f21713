"""Distributed union-find over link tables, and linking inside candidate buckets.

Only DataFrame operations; every round is written as Parquet under the shared checkpoint
folder, so lineage stays short and a lost executor only costs the round it was in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prioscope.session import materialize

#: Buckets with several members whose smallest ids are broadcast at most (16 bytes each).
BROADCAST_BUCKETS = 1 << 20

#: Pairs a member of a bucket may have left, on average, before all of them are verified, and
#: links for each row that a round must give for another one.
FEW_PAIRS = 8
LEAST_GAIN = 0.05

#: Members of a dense bucket that are compared with each other in a round, on average.
GROUP = 8

#: Power of the weight by which a bucket's centre is chosen.
CENTRE_POWER = 4


def _state(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return tuple(r)


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; component = smallest node.

    Alternates two contractions until the links are stars around each smallest node:
    every node hands its larger neighbours to its smallest one, then every node hands its
    smaller neighbours to the smallest. Minima are pre-aggregated before they are shuffled,
    and a node with very many links is an ordinary skewed join key.
    """
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    state = _state(e)
    while state[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "cc")
        new = _state(e)
        if new == state:
            break
        state = new
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _pick(turn: int):
    """Order in which a bucket's members are preferred as its centre: a random choice, weighted
    by the rows that a member meets in all its buckets (the middle of a group meets most)."""
    u = (F.shiftrightunsigned(F.xxhash64("id", F.lit(turn)), 11) + 1) / F.lit(float(1 << 53))
    return F.log(u) / F.pow("weight", F.lit(CENTRE_POWER))


def bucket_components(members: DataFrame, verify: Callable[[DataFrame], DataFrame], candidate=None, sketch: str = "id",
                      sketches: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Components of the links among rows that share a bucket, without listing all pairs.

    ``members`` has ``bucket`` and ``id`` (a row may sit in many buckets). ``verify`` turns
    distinct pairs ``(a, b)`` into those that are links. Round one verifies each member
    against the smallest id of its bucket. Two rows already in one component need no
    further check, so later rounds take only the pairs of a bucket whose components differ:
    the same components as from all pairs, while a group of near copies costs a few links
    each. While a bucket has many such pairs for its size, its members are verified against
    one of them at a time (see ``_pick``) and within small groups dealt by a hash, so a group
    whose members are similar to some others only is joined up by a few pairs each as well; a
    round that links almost nothing ends this, and all pairs that are left are verified.
    ``candidate(x, y)`` is an optional cheap necessary condition on the two rows' ``sketch``, a
    column of ``members``; pairs that fail it are never written. A wide sketch is better given by
    ``sketches``, which turns the rows of shared buckets into ``id`` and the sketch: it then
    joins the rows of buckets that are not joined up yet, and the pairs of round one, which
    are no more than the rows, all go to ``verify``.
    """
    carried = ["id"] if sketches else list(dict.fromkeys(["id", sketch]))
    passes = candidate or (lambda x, y: F.lit(True))
    # buckets of one member end here, by a count that moves no more than their names
    shared = materialize(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket"), "shared")
    few = shared.count() <= BROADCAST_BUCKETS
    met = members.join(F.broadcast(shared) if few else shared, "bucket", "left_semi")
    met = met if few else materialize(met, "met")
    lows = materialize(met.groupBy("bucket").agg(F.min(F.struct(*carried)).alias("low")), "lows")
    kept = materialize(met.join(F.broadcast(lows) if few else lows, "bucket").select("bucket", *carried, "low"), "buckets")
    wide = sketches(kept) if sketches else None
    star = kept.where(F.col("id") != F.col("low.id"))
    star = star if sketches else star.where(passes(F.col(f"low.{sketch}"), F.col(sketch)))

    def sketched(rows: DataFrame) -> DataFrame:
        return rows.join(wide, "id") if sketches else rows

    links = materialize(verify(star.select(F.col("low.id").alias("a"), F.col("id").alias("b")).distinct()), "links")
    turn, here = 0, kept.select("bucket", *carried, F.col("low.id").alias("low"))
    while True:
        comp = connected_components(links)
        named = here.join(comp, here.id == comp.node, "left").select("bucket", *carried, "low", F.coalesce("component", "id").alias("c"))
        sizes = named.groupBy("bucket", "c").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(
            F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"))
        mixed = sizes.where("n * n > same").select("bucket", "n", (F.col("n") * F.col("n") - F.col("same") > 2 * FEW_PAIRS * F.col("n")).alias("dense"))
        left = materialize(named.join(mixed, "bucket"), "mixed")
        here = left.select("bucket", *carried, "low")  # the other buckets are joined up and stay so
        dense = left.where("dense")
        rows = dense.count()
        if not rows:
            break
        turn += 1
        dense = dense.join(dense.groupBy("id").agg(F.sum("n").cast("double").alias("weight")), "id")
        centre = dense.groupBy("bucket").agg(F.max_by(F.struct(*carried, "c"), _pick(turn)).alias("m"))
        if sketches:
            centre = sketched(centre.select("bucket", "m.*")).select("bucket", F.struct("id", sketch, "c").alias("m"))
        dense = sketched(dense)
        met = dense.join(centre, "bucket").where((F.col("c") != F.col("m.c")) & passes(F.col(f"m.{sketch}"), F.col(sketch)))
        met = met.select(F.least("m.id", "id").alias("a"), F.greatest("m.id", "id").alias("b"))
        dealt = dense.withColumn("sub", F.pmod(F.xxhash64("id", F.lit(-turn)), F.ceil(F.col("n") / GROUP)))
        few = dealt.alias("x").join(dealt.alias("y"), (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.sub") == F.col("y.sub"))
                                    & (F.col("x.id") < F.col("y.id")) & (F.col("x.c") != F.col("y.c")) & passes(F.col(f"x.{sketch}"), F.col(f"y.{sketch}")))
        met = met.union(few.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")))
        more = materialize(verify(met.distinct()), "links")
        links = links.union(more)
        if more.count() < LEAST_GAIN * rows:
            break
    left = sketched(left)
    x, y = left.alias("x"), left.alias("y")
    cond = ((F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.c") != F.col("y.c"))
            & (F.col("x.id") != F.col("x.low"))  # pairs with the bucket's smallest id are done
            & passes(F.col(f"x.{sketch}"), F.col(f"y.{sketch}")))
    rest = x.join(y, cond).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    more = materialize(verify(rest), "links")
    return connected_components(links.union(more))
