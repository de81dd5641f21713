"""Exact quantiles with bounded memory (median / quartiles of resolution hours).

Spark's exact ``percentile`` keeps one (value -> count) entry per distinct value and
merges them all in a single task; on 100 TB of free-form doubles that buffer is
unbounded. Here a sketch finds the neighbourhood and counting finds the value:

1. one aggregate gives ``n``, ``min``, ``max``, the moments and a KLL sketch of the non-null,
   non-NaN values, and from the sketch a narrow bracket around every wanted quantile;
2. one counting pass puts each value into a bin of a bracket or into a gap between brackets
   (``groupBy(bin)`` with count / min / max: a bounded number of rows reaches the driver,
   partial aggregation runs map-side). The counts tell exactly which bin holds each
   wanted rank, or which gap, should a bracket have missed it;
3. while that bin holds several distinct values, its own min and max are the next range.

For most data the second pass ends the search. Bins are ``bins`` equal widths, but for the
first round after the brackets, where a range that spans several powers of two is cut at
those, by sign. From then on a range lies between neighbouring powers, where doubles are
evenly spaced, so a round leaves one in ``bins`` of at most 2^52 of them: any data ends within
a handful of rounds, without a cap, and nothing is cached.

All open ranges of a round share one grouped job (they are disjoint).
Interpolation between neighbouring ranks is ``lo + (hi - lo) * frac``, the same
formula as Spark's ``percentile`` and DuckDB's ``quantile_cont``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 1024
#: Size of the sketch, and half the width of a bracket in ranks (several times the sketch's error).
SKETCH_K = 4096
BRACKET = 0.002
_HALF = 2400  # above any |binade| key; a binade is a power of two and a sign


def _bucket(x, a: float, b: float, bins: int):
    """0-based equal-width bucket of ``x`` within ``[a, b]``."""
    if math.isinf(b - a):  # range wider than the largest double: halve first
        frac = (x * 0.5 - F.lit(a * 0.5)) / F.lit(b * 0.5 - a * 0.5)
    else:
        frac = (x - F.lit(a)) / F.lit(b - a)
    return F.least(F.floor(frac * bins), F.lit(bins - 1))


def _binade(x: Column) -> Column:
    """Key of the power of two below ``|x|``, in the order of x; zero in the middle."""
    size = F.floor(F.log2(F.abs(x))) + 1200
    return F.lit(_HALF) + F.when(x == 0, F.lit(0)).when(x > 0, size).otherwise(-size)


def _spans_binades(a: float, b: float) -> bool:
    return a <= 0 <= b or math.frexp(a)[1] != math.frexp(b)[1]


def _located(hist: list, starts: list, groups: dict, ranges: list, stride: int) -> dict:
    """Next range ``(lo, hi, values below)`` of each rank from the counts of a round."""
    pending = {}
    for row in hist:
        i = row["g"] // stride
        end = starts[i] + row["n"]
        for k in groups[ranges[i]]:
            if starts[i] <= k < end:
                pending[k] = (row["lo"], row["hi"], starts[i])
        starts[i] = end
    return pending


def _counted(vals: DataFrame, key: Column) -> list:
    """Rows per key in order. As many rows as there are keys; ordering them on the driver saves
    the sampling job of a distributed sort."""
    x = F.col("__x")
    return sorted(vals.select(key.cast("long").alias("g"), x).where(F.col("g").isNotNull())
                  .groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi")).collect(), key=lambda r: r["g"])


def _bracketed(vals: DataFrame, ranks, brackets: list[tuple[float, float]], bins: int) -> dict:
    """The counting pass over brackets and the gaps between them (rank -> its range)."""
    merged: list[list[float]] = []
    for a, b in sorted(brackets):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    x, stride, key = F.col("__x"), bins + 1, None
    for i, (a, b) in enumerate(merged):  # bin 0 is the gap before the bracket
        inside = _bucket(x, a, b, bins) + 1 if a < b else F.lit(1)
        own = F.when(x < a, F.lit(i * stride)).when(x <= b, F.lit(i * stride) + inside)
        key = own if key is None else F.coalesce(key, own)
    key = F.coalesce(key, F.lit(len(merged) * stride))
    pending, below = {}, 0
    for row in _counted(vals, key):
        for k in set(ranks):
            if below <= k < below + row["n"]:
                pending[k] = (row["lo"], row["hi"], below)
        below += row["n"]
    return pending


def _narrowed(vals: DataFrame, pending: dict, bins: int, binades: bool) -> dict:
    """Values at the ranks of ``pending`` (rank -> ``(lo, hi, values below lo)``, equal or disjoint
    ranges): one grouped job a round, key = range index * stride + bucket."""
    found: dict = {}
    x = F.col("__x")
    stride = max(bins, 2 * _HALF)
    while True:
        groups: dict = {}
        for k, rng in pending.items():
            if rng[0] == rng[1]:
                found[k] = rng[0]
            else:
                groups.setdefault(rng, []).append(k)
        if not groups:
            return found
        ranges = list(groups)
        key = None
        for i, (a, b, _) in enumerate(ranges):
            inside = (x >= a) & (x <= b)
            own = _binade(x) if binades and _spans_binades(a, b) else _bucket(x, a, b, bins)
            k_i = F.lit(i * stride) + own
            key = F.when(inside, k_i) if key is None else key.when(inside, k_i)
        pending = _located(_counted(vals, key), [below for _, _, below in ranges], groups, ranges, stride)
        binades = False


def quantile_summary(df: DataFrame, col: str, probs, bins: int = BINS):
    """``({p: value}, stats)`` for the non-null, non-NaN values of ``col``.

    ``stats`` is the Row of the first pass: rows (all), n, lo (min), hi (max), mean, std (sample),
    var (population), so a summary needs no further pass over the upstream plan. Quantiles use
    linear interpolation and are None on no data.
    """
    probs = list(probs)
    c = F.col(col).cast("double")
    every = df.select(F.nanvl(c, F.lit(None).cast("double")).alias("__x"))
    x = F.col("__x")
    near = F.array(*[F.lit(float(min(max(p + d, 0.0), 1.0))) for p in probs for d in (-BRACKET, BRACKET)])
    sketch = F.kll_sketch_agg_double(x, F.lit(SKETCH_K))
    st = (every.agg(F.count(F.lit(1)).alias("rows"), F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.avg(x).alias("mean"),
                    F.stddev_samp(x).alias("std"), F.var_pop(x).alias("var"), sketch.alias("sketch"))
          .select("*", F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", near)).alias("near")).drop("sketch")).first()
    n = st["n"]
    if not n:
        return {p: None for p in probs}, st
    wanted = {}
    for p in probs:
        pos = p * (n - 1)
        wanted[p] = (math.floor(pos), math.ceil(pos), pos - math.floor(pos))
    ranks = {r for lo_r, hi_r, _ in wanted.values() for r in (lo_r, hi_r)}
    vals = every.where(x.isNotNull())
    brackets = list(zip(st["near"][::2], st["near"][1::2]))
    at = _narrowed(vals, _bracketed(vals, ranks, brackets, bins), bins, True)
    out = {}
    for p, (lo_r, hi_r, frac) in wanted.items():
        a, b = at[lo_r], at[hi_r]
        out[p] = a if lo_r == hi_r else a + (b - a) * frac
    return out, st


def exact_quantiles(df: DataFrame, col: str, probs, bins: int = BINS) -> dict:
    """``{p: value}`` for each probability (linear interpolation); None on no data."""
    return quantile_summary(df, col, probs, bins)[0]


def exact_median(df: DataFrame, col: str, bins: int = BINS):
    return exact_quantiles(df, col, [0.5], bins)[0.5]
