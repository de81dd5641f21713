"""Cleaning: typed ticket table from a raw export.

Global statistics (median / mean / std of resolution hours) form a 1-row table joined
back by broadcast (``time_baseline``): one aggregate for the moments plus the bounded
exact median search; nothing uses an unkeyed window.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prioscope.functions.scoring import level_score, priority_norm
from prioscope.functions.text import ws_trim
from prioscope.operators.quantiles import quantile_summary

# FIXED VALUES — defaults for absent columns.
DEFAULT_HOURS = 24.0
DEFAULT_CHANNEL = "unknown"
DEFAULT_TICKET_TYPE = "General"

# A number as pandas' to_numeric reads it: optional sign, digits with an optional
# fraction (or a bare fraction), optional exponent; surrounding whitespace allowed.
NUMERIC_TEXT = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"

TICKET_COLUMNS = [
    "ticket_id", "subject", "description", "full_text", "priority_raw",
    "priority_norm", "priority_score", "channel", "ticket_type", "resolution_hours",
]


def finite_or_null(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None)).otherwise(x)


def coerce_hours(c: Column, dtype: str) -> Column:
    """Text or number -> finite double or null ('12d', 'abc', 'inf', '1e999' -> null)."""
    if dtype == "string":
        txt = ws_trim(c)
        val = F.when(txt.rlike(NUMERIC_TEXT), txt.try_cast("double"))
    else:
        val = c.cast("double")
    return finite_or_null(val)


def time_baseline(df: DataFrame, hours_col: str = "resolution_hours",
                  median: str = "exact", accuracy: int = 100000) -> DataFrame:
    """1-row table: hours_median, hours_mean, hours_std, n.

    Mean and population std are those of the *imputed* column (nulls replaced by the
    median), derived from the observed rows' count, mean and population variance plus
    the median (pairwise-combination formula), so no extra pass over imputed values.

    ``median='exact'`` (default): exact, bounded-memory rank search
    (``operators.quantiles``); the statistics are computed now and the result is a
    literal 1-row table -- a frozen baseline. ``median='percentile'``: Spark's exact
    ``median`` aggregate, lazy, but its final task holds one entry per distinct value.
    ``median='approx'``: lazy ``percentile_approx`` with ``accuracy``.
    """
    df = df.select(F.nanvl(F.col(hours_col).cast("double"), F.lit(None).cast("double")).alias(hours_col))
    h = F.col(hours_col)  # NaN counts as missing
    moments = [F.count(F.lit(1)).alias("n"), F.count(h).alias("n_obs"),
               F.avg(h).alias("mean_obs"), F.var_pop(h).alias("var_obs")]
    if median == "exact":
        at, st = quantile_summary(df, hours_col, [0.5])
        mean, std = _imputed_moments(st["rows"], st["n"], st["mean"], st["var"], at[0.5])
        return df.sparkSession.createDataFrame(
            [(at[0.5], mean, std, st["rows"])],
            "hours_median double, hours_mean double, hours_std double, n long")
    med_col = F.median(h) if median == "percentile" else F.percentile_approx(h, 0.5, accuracy)
    stats = df.agg(*moments, med_col.cast("double").alias("hours_median"))
    n, k, m = F.col("n"), F.col("n_obs"), F.col("hours_median")
    gap = (n - k).cast("double")
    mean = (k * F.col("mean_obs") + gap * m) / n
    m2 = k * F.col("var_obs") + (k * gap / n) * F.pow(m - F.col("mean_obs"), 2)
    return stats.select(
        "hours_median",
        F.when(k > 0, mean).alias("hours_mean"),
        F.when(k > 0, F.sqrt(m2 / n)).alias("hours_std"),
        "n",
    )


def _imputed_moments(n, k, mean_obs, var_obs, med):
    """Mean and population std after filling n - k nulls with ``med``."""
    if not k:
        return None, None
    gap = float(n - k)
    mean = (k * mean_obs + gap * med) / n
    m2 = k * var_obs + (k * gap / n) * (med - mean_obs) ** 2
    return mean, math.sqrt(m2 / n)


def impute_hours(df: DataFrame, baseline: DataFrame, hours_col: str = "resolution_hours") -> DataFrame:
    """Null hours -> the baseline median (broadcast 1-row join)."""
    b = F.broadcast(baseline.select("hours_median"))
    out = df.crossJoin(b).withColumn(hours_col, F.coalesce(F.col(hours_col), F.col("hours_median")))
    return out.drop("hours_median")


def clean(df: DataFrame, priority_map: str = "wide", unknown_priority: str = "default",
          impute: bool = True, baseline: DataFrame | None = None,
          median: str = "exact") -> DataFrame:
    """Raw export (renamed) -> typed ticket table.

    Absent columns get defaults (channel ``unknown``, ticket_type ``General``, hours
    24.0, text ''); null text becomes ''; priority is normalised (``priority_map`` =
    ``wide``/``strict``, unknown -> Medium or kept); hours are coerced to finite
    doubles and, with ``impute``, nulls take the median.
    """
    cols = set(df.columns)
    text = {c: (F.coalesce(F.col(c).cast("string"), F.lit("")) if c in cols else F.lit(""))
            for c in ("subject", "description")}
    raw_priority = F.col("priority").cast("string") if "priority" in cols else F.lit(None).cast("string")
    if "resolution_hours" in cols:
        dtype = dict(df.dtypes)["resolution_hours"]
        hours = coerce_hours(F.col("resolution_hours"), dtype)
    else:
        hours = F.lit(DEFAULT_HOURS)
    norm = priority_norm(raw_priority, priority_map, unknown_priority)
    base = {
        "ticket_id": F.col("ticket_id").cast("string"),
        "subject": text["subject"],
        "description": text["description"],
        "full_text": ws_trim(F.concat(text["subject"], F.lit(" "), text["description"])),
        "priority_raw": raw_priority,
        "priority_norm": norm,
        "priority_score": level_score(norm),
        "channel": F.col("channel") if "channel" in cols else F.lit(DEFAULT_CHANNEL),
        "ticket_type": F.col("ticket_type") if "ticket_type" in cols else F.lit(DEFAULT_TICKET_TYPE),
        "resolution_hours": hours,
    }
    extra = [c for c in df.columns if c not in base and c != "priority"]
    out = df.select(*[v.alias(k) for k, v in base.items()], *extra)
    if impute:
        out = impute_hours(out, baseline if baseline is not None else time_baseline(out, median=median))
    return out


def blank_rejects(df: DataFrame) -> DataFrame:
    """Tickets whose description is empty after stripping (refused by single scoring)."""
    return df.where(ws_trim(F.coalesce(F.col("description"), F.lit(""))) == "")


def keep_present(df: DataFrame, wanted) -> DataFrame:
    """Project the wanted columns that exist, in the wanted order (P10)."""
    have = set(df.columns)
    return df.select(*[F.col(f"`{c}`") for c in wanted if c in have])
