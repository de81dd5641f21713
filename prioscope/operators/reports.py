"""Report tables over an audited ticket table.

Each report is one grouped or 1-row aggregate; Spark runs partial aggregation before
the shuffle, so the shuffled data is one row per group per partition. Global bounds
(histogram range) are 1-row aggregates joined back by broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prioscope.functions.scoring import NLP_WEIGHT, RT_WEIGHT, mismatch_label
from prioscope.lexicon import LEVELS
from prioscope.operators.quantiles import quantile_summary


def _rate(c) -> F.Column:
    return F.avg(c.cast("double")) * 100.0


def ablation(df: DataFrame) -> DataFrame:
    """Mismatch rate (%) of each signal alone and of the fused label: 3 rows."""
    assigned = F.col("priority_score")
    row = df.agg(
        _rate(mismatch_label(F.col("nlp_severity") - assigned)).alias("a"),
        _rate(mismatch_label(F.col("rt_severity") - assigned)).alias("b"),
        _rate(F.col("mismatch_label")).alias("f"),
    )
    fused_w = f"{NLP_WEIGHT * 100:.0f}% / {RT_WEIGHT * 100:.0f}%"
    def entry(name, weight, col):
        return F.struct(F.lit(name).alias("signal"), F.lit(weight).alias("weight_used"),
                        F.col(col).alias("mismatch_rate"))
    return row.select(F.inline(F.array(
        entry("NLP only (A)", "100%", "a"),
        entry("Resol. Time only (B)", "100%", "b"),
        entry("Fused (A+B)", fused_w, "f"),
    )))


def agreement(df: DataFrame, a: str = "nlp_severity", b: str = "rt_severity") -> DataFrame:
    """Share of tickets where both signals give the same severity."""
    return df.agg(F.avg((F.col(a) == F.col(b)).cast("double")).alias("agreement"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows per value, the commonest first, ties by value."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), col)


def null_counts(df: DataFrame) -> DataFrame:
    """One row per column: how many nulls (single pass, then unpivot of one row)."""
    one = df.agg(*[F.sum(F.col(f"`{c}`").isNull().cast("long")).alias(c) for c in df.columns])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias("null_count"))
        for c in df.columns])))


def mismatch_rate_by(df: DataFrame, col: str = "priority_norm") -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"),
                               _rate(F.col("mismatch_label")).alias("mismatch_rate"))


def mismatch_summary(df: DataFrame) -> DataFrame:
    """Mismatch count and rate (%)."""
    return df.agg(F.count(F.lit(1)).alias("n"),
                  F.sum("mismatch_label").alias("mismatches"),
                  _rate(F.col("mismatch_label")).alias("mismatch_rate"))


def delta_histogram(df: DataFrame, lo: int = -4, hi: int = 4) -> DataFrame:
    """Count per integer delta in lo..hi, empty deltas included, by delta."""
    spark = df.sparkSession
    counts = df.groupBy("severity_delta").agg(F.count(F.lit(1)).alias("n"))
    axis = spark.range(lo, hi + 1).select(F.col("id").cast("int").alias("severity_delta"))
    return (axis.join(counts, "severity_delta", "left")
            .select("severity_delta", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
            .orderBy("severity_delta"))


def histogram(df: DataFrame, col: str, bins: int = 40) -> DataFrame:
    """Equal-width histogram over non-null values (the maximum lands in the last bin).

    A constant column is widened by 0.5 on both sides. All ``bins`` rows are returned.
    """
    spark = df.sparkSession
    x = F.col(col)
    vals = df.where(x.isNotNull())
    rng = vals.agg(F.min(x).alias("lo0"), F.max(x).alias("hi0")).select(
        F.when(F.col("lo0") == F.col("hi0"), F.col("lo0") - 0.5).otherwise(F.col("lo0")).alias("lo"),
        F.when(F.col("lo0") == F.col("hi0"), F.col("hi0") + 0.5).otherwise(F.col("hi0")).alias("hi"),
    )
    binned = vals.select(x.alias("x")).crossJoin(F.broadcast(rng)).select(
        F.least(F.floor(F.lit(float(bins)) * (F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo"))) + 1,
                F.lit(bins)).cast("int").alias("bin"))
    counts = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    axis = spark.range(1, bins + 1).select(F.col("id").cast("int").alias("bin")).crossJoin(F.broadcast(rng))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    return (axis.join(counts, "bin", "left").select(
        "bin",
        (F.col("lo") + (F.col("bin") - 1) * width).alias("bin_lo"),
        (F.col("lo") + F.col("bin") * width).alias("bin_hi"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def describe(df: DataFrame, col: str) -> DataFrame:
    """count, mean, sample std, min, exact quartiles (linear interpolation), max.

    Computed now, over non-null, non-NaN values: the moments come from the first pass
    of the bounded-memory exact quartile search (``operators.quantiles``), which
    reads one persisted column, so the upstream plan runs once. Returns one row."""
    q, st = quantile_summary(df, col, [0.25, 0.5, 0.75])
    return df.sparkSession.createDataFrame(
        [(st["n"], st["mean"], st["std"], st["lo"], q[0.25], q[0.5], q[0.75], st["hi"])],
        "count long, mean double, std double, min double, q25 double, q50 double, "
        "q75 double, max double")


def kpis(df: DataFrame, type_col: str = "mismatch_type") -> DataFrame:
    """Dashboard cards: total, mismatches, their share (%), hidden crises, false alarms."""
    t = F.col(type_col)
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(t != "Consistent").alias("mismatches"),
        F.count_if(t == "Hidden Crisis").alias("hidden_crises"),
        F.count_if(t == "False Alarm").alias("false_alarms"),
    ).withColumn("mismatch_share",
                 F.col("mismatches") / F.greatest(F.col("total"), F.lit(1)) * 100.0)


def crosstab(df: DataFrame, row_col: str = "priority_norm",
             col_col: str = "inferred_severity_label") -> DataFrame:
    """Assigned priority x inferred severity counts; columns in level order, zeros kept."""
    return (df.groupBy(F.col(row_col).alias("assigned_priority"))
            .pivot(col_col, LEVELS).agg(F.count(F.lit(1))).na.fill(0, LEVELS))


def top_values(evidence: DataFrame, k: int = 15, signal: str = "keyword") -> DataFrame:
    """Most frequent evidence values of one signal; ties by value. Skips 'nan' and <= 2 chars."""
    v = F.col("value")
    kept = evidence.where((F.col("signal") == signal) & v.isNotNull()
                          & (F.lower(v) != "nan") & (F.length(v) > 2))
    return (kept.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc("value")).limit(k))


def split_rates(df: DataFrame, split_col: str = "split") -> DataFrame:
    return df.groupBy(split_col).agg(F.count(F.lit(1)).alias("n"),
                                     F.avg(F.col("mismatch_label").cast("double")).alias("mismatch_rate"))


def preview(df: DataFrame, n: int = 5, order_by: str = "ticket_id") -> DataFrame:
    """First ``n`` rows in a stable order (TakeOrderedAndProject; no full sort)."""
    return df.orderBy(order_by).limit(n)
