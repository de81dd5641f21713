"""Signal A (text keywords and patterns) and Signal B (resolution-time z-score)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prioscope.functions.scoring import text_severity, time_severity
from prioscope.functions.text import hit_count, hits_in_order
from prioscope.lexicon import CORE, Lexicon, preset
from prioscope.operators.clean import time_baseline

SIGNAL_COLUMNS = [
    "crit_kw_count", "high_kw_count", "med_kw_count", "low_kw_count",
    "esc_phrase_count", "negation_count", "nlp_score", "nlp_severity", "top_keywords",
]


def top_keywords(text_lc: str, lexicon: Lexicon):
    crit = hits_in_order(text_lc, lexicon.crit)
    if lexicon.top_keywords == "crit_high":
        high = hits_in_order(text_lc, lexicon.high)
        return F.slice(F.concat(F.slice(crit, 1, 3), F.slice(high, 1, 2)), 1, 3)
    return F.slice(crit, 1, 3)


def with_text_signal(df: DataFrame, lexicon: Lexicon | str = CORE,
                     text_col: str = "full_text", prefix: str = "") -> DataFrame:
    """Append hit counts, weighted score, text severity (1..4) and top keywords.

    The text is lower-cased once into a helper column that every test reads; a null
    text counts as ''. ``prefix`` names the new columns (e.g. to score one table with
    two lexicons side by side).
    """
    lx = preset(lexicon)
    w = lx.weights
    t = "__text_lc"
    p = prefix
    staged = df.select("*", F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias(t))
    counts = [
        hit_count(t, lx.crit).alias(p + "crit_kw_count"),
        hit_count(t, lx.high).alias(p + "high_kw_count"),
        hit_count(t, lx.med).alias(p + "med_kw_count"),
        hit_count(t, lx.low).alias(p + "low_kw_count"),
        hit_count(t, lx.esc).alias(p + "esc_phrase_count"),
        hit_count(t, lx.neg).alias(p + "negation_count"),
        top_keywords(t, lx).alias(p + "top_keywords"),
    ]
    new = {p + c for c in SIGNAL_COLUMNS}
    keep = [F.col(f"`{c}`") for c in df.columns if c not in new]
    staged = staged.select(*keep, *counts)
    # double literals (``4.0D``): a bare ``4.0`` is a DECIMAL in Spark SQL and would make
    # every row do decimal arithmetic; the weights are exact binary fractions
    d = {k: f"{float(v)!r}D" for k, v in w.items()}
    score = F.expr(
        f"`{p}crit_kw_count` * {d['crit']} + `{p}esc_phrase_count` * {d['esc']}"
        f" + `{p}negation_count` * {d['neg']} + `{p}high_kw_count` * {d['high']}"
        f" + `{p}med_kw_count` * {d['med']} + `{p}low_kw_count` * {d['low']}")
    staged = staged.select("*", score.alias(p + "nlp_score"))
    return staged.select("*", text_severity(
        F.col(p + "nlp_score"), F.col(p + "esc_phrase_count"), F.col(p + "crit_kw_count")
    ).alias(p + "nlp_severity"))


def with_time_signal(df: DataFrame, baseline: DataFrame | None = None,
                     hours_col: str = "resolution_hours") -> DataFrame:
    """Impute hours with the baseline median, then z-score and bucket them.

    ``baseline`` is the 1-row output of ``time_baseline``; pass a frozen one to score
    new tickets against a fixed reference (streaming), or ``None`` to compute it from
    ``df``. Zero spread gives a null z and severity 1.
    """
    if baseline is None:
        baseline = time_baseline(df, hours_col)
    b = F.broadcast(baseline.select(F.col("hours_median").alias("__med"),
                                    F.col("hours_mean").alias("__mean"),
                                    F.col("hours_std").alias("__std")))
    h = F.coalesce(F.col(hours_col), F.col("__med"))
    rest = [F.col(f"`{c}`") for c in df.columns if c not in (hours_col, "rt_zscore", "rt_severity")]
    out = df.crossJoin(b).select(*rest, h.alias(hours_col),
                                 F.try_divide(h - F.col("__mean"), F.col("__std")).alias("rt_zscore"))
    return out.select("*", time_severity(F.col("rt_zscore")).alias("rt_severity"))
