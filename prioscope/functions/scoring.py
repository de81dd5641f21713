"""Scalar scoring rules as column expressions (severity, fusion, mismatch)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prioscope.functions.text import sql_lit, ws_trim
from prioscope.lexicon import LEVELS

# FIXED VALUES — fusion weights of the text and time signals.
NLP_WEIGHT = 0.6
RT_WEIGHT = 0.4

# FIXED VALUES — priority normalisation maps (key = stripped, lower-cased raw text).
STRICT_PRIORITY = {"low": "Low", "medium": "Medium", "high": "High", "critical": "Critical"}
WIDE_PRIORITY = {
    "low": "Low", "medium": "Medium", "high": "High", "critical": "Critical",
    "1": "Low", "2": "Medium", "3": "High", "4": "Critical",
    "p1": "Critical", "p2": "High", "p3": "Medium", "p4": "Low",
}
DEFAULT_PRIORITY = "Medium"
DEFAULT_SCORE = 2


def _sql_map(d: dict) -> str:
    return "map(" + ", ".join(f"{sql_lit(k)}, {sql_lit(v)}" for k, v in d.items()) + ")"


def _sql_levels() -> str:
    return "array(" + ", ".join(sql_lit(x) for x in LEVELS) + ")"


def priority_norm(raw: Column, mapping: str = "wide", unknown: str = "default") -> Column:
    """Normalise free-text priority to Low/Medium/High/Critical.

    ``mapping``: ``strict`` (4 names) or ``wide`` (names, 1..4 with 1=Low, p1..p4 with
    p1=Critical). ``unknown``: ``default`` -> Medium, ``keep`` -> the stripped raw text
    (null stays null).
    """
    table = {"strict": STRICT_PRIORITY, "wide": WIDE_PRIORITY}[mapping]
    mapped = F.element_at(F.expr(_sql_map(table)), F.lower(ws_trim(raw)))
    fallback = F.lit(DEFAULT_PRIORITY) if unknown == "default" else ws_trim(raw)
    return F.coalesce(mapped, fallback)


def level_score(label: Column) -> Column:
    """Low 1 .. Critical 4; anything else 2."""
    idx = F.array_position(F.expr(_sql_levels()), label)
    return F.when(idx > 0, idx.cast("int")).otherwise(F.lit(DEFAULT_SCORE))


def level_label(level: Column) -> Column:
    """1..4 -> Low..Critical (null outside)."""
    return F.element_at(F.expr(_sql_levels()), level.cast("int"))


def text_severity(score: Column, esc: Column, crit: Column) -> Column:
    return (F.when((score >= 6) | (esc >= 1), 4)
            .when((score >= 3) | (crit >= 1), 3)
            .when(score >= 1, 2)
            .otherwise(1))


def time_severity(z: Column) -> Column:
    """z-score buckets; a null z (no spread, no data) falls to 1 like NaN does in pandas."""
    return (F.when(z >= 1.5, 4)
            .when(z >= 0.5, 3)
            .when(z >= -0.5, 2)
            .otherwise(1))


def fused_score(nlp: Column, rt: Column) -> Column:
    return F.lit(NLP_WEIGHT) * nlp + F.lit(RT_WEIGHT) * rt


def fused_severity(fused: Column) -> Column:
    """Half-even round, clipped to 1..4."""
    return F.least(F.greatest(F.bround(fused, 0), F.lit(1.0)), F.lit(4.0)).cast("int")


def mismatch_label(delta: Column) -> Column:
    # |delta| >= 2 already covers "inferred 4 & assigned <= 2" and "inferred 1 & assigned >= 4".
    return (F.abs(delta) >= 2).cast("int")


def mismatch_type(label: Column, delta: Column) -> Column:
    return (F.when(label == 0, "Consistent")
            .when(delta > 0, "Hidden Crisis")
            .otherwise("False Alarm"))


def hours_text(hours: Column, null_text: str = "unknown") -> Column:
    """``x.x hours``; a null renders as ``unknown`` (0 is a real value)."""
    return F.when(hours.isNull(), F.lit(null_text)).otherwise(F.format_string("%.1f hours", hours))
