"""Fusion, mismatch labelling and rule/model predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prioscope.functions.scoring import (fused_score, fused_severity, level_label,
                                         mismatch_label, mismatch_type)
from prioscope.lexicon import CORE, Lexicon
from prioscope.operators.signals import with_text_signal, with_time_signal

# FIXED VALUES — constant confidences of the rule-only fallback.
RULE_CONFIDENCE = 0.80
APP_RULE_CONFIDENCE_MISMATCH = 0.75


def with_mismatch(df: DataFrame, severity_col: str = "inferred_severity",
                  assigned_col: str = "priority_score") -> DataFrame:
    """Label, delta and type from an inferred severity and the assigned score."""
    delta = (F.col(severity_col) - F.col(assigned_col)).cast("int")
    label = mismatch_label(delta)
    return df.select("*", level_label(F.col(severity_col)).alias("inferred_severity_label"),
                     delta.alias("severity_delta"), label.alias("mismatch_label"),
                     mismatch_type(label, delta).alias("mismatch_type"))


def audit(df: DataFrame, lexicon: Lexicon | str = CORE, mode: str = "fused",
          baseline: DataFrame | None = None, text_col: str = "full_text") -> DataFrame:
    """Score a clean ticket table and flag priority mismatches.

    ``mode='fused'``: inferred = round(0.6 * text + 0.4 * time), clipped to 1..4 (the
    labelling rule). ``mode='nlp'``: inferred = text severity alone (the rule-only
    inference path), which needs no baseline; the time signal is attached when one is given.
    """
    if mode not in ("fused", "nlp"):
        raise ValueError("mode must be 'fused' or 'nlp'")
    out = with_text_signal(df, lexicon, text_col)
    if mode == "fused" or baseline is not None:
        out = with_time_signal(out, baseline)
        out = out.withColumn("fused_score", fused_score(F.col("nlp_severity"), F.col("rt_severity")))
    inferred = fused_severity(F.col("fused_score")) if mode == "fused" else F.col("nlp_severity").cast("int")
    return with_mismatch(out.select("*", inferred.alias("inferred_severity")))


def rule_confidence(style: str = "cli") -> Column:
    """Constant confidence of the rule-only path: 0.80, but 0.75 for the app's mismatches."""
    if style == "app":
        return F.when(F.col("mismatch_label") == 1, APP_RULE_CONFIDENCE_MISMATCH).otherwise(RULE_CONFIDENCE)
    return F.lit(RULE_CONFIDENCE)


def mismatches_only(audited: DataFrame, label_col: str = "mismatch_label") -> DataFrame:
    """Rows flagged as a mismatch (P13), filtered above a one-row generator.

    Catalyst pushes a filter through a Project by substituting aliases. A label that
    depends on the text alone (``mode='nlp'``) would then carry every keyword test,
    and the lower-cased text, once per reference down to the scan. That overflows the
    64 KB codegen limit and re-runs the matching. Filters on generated columns are
    not pushed below a Generate, which codegens in the same stage. (With the fused
    label the filter stops at the baseline join anyway.)
    """
    cols = [F.col(f"`{c}`") for c in audited.columns]
    fenced = audited.select(F.inline(F.array(F.struct(*cols))))
    return fenced.where(F.col(label_col) == 1)


def signal_mismatch(severity_col: str, assigned_col: str = "priority_score"):
    """0/1 mismatch of a single signal against the assigned priority."""
    return mismatch_label(F.col(severity_col) - F.col(assigned_col))


def rule_predictions(audited: DataFrame, style: str = "cli") -> DataFrame:
    """Prediction rows of the rule-only fallback (no classifier).

    ``audited`` must come from ``audit(..., mode='nlp')``. ``style='cli'``: constant
    confidence 0.80. ``style='app'``: 0.75 for mismatches, 0.80 otherwise.
    """
    return audited.select(
        "ticket_id",
        F.col("priority_norm").alias("assigned_priority"),
        F.col("inferred_severity_label").alias("inferred_severity"),
        "mismatch_label", "mismatch_type", "severity_delta",
        rule_confidence(style).alias("confidence"),
    )


def model_predictions(scored: DataFrame, label_col: str = "prediction",
                      confidence_col: str = "confidence", style: str = "cli") -> DataFrame:
    """Prediction rows when a classifier supplies the label.

    ``style='cli'``: a predicted mismatch is Hidden Crisis when delta > 0, else False
    Alarm (even at delta 0). ``style='app'``: the rule's type is shown when the model
    says mismatch, else Consistent (so a model mismatch can read Consistent).
    """
    label = F.col(label_col).cast("int")
    delta = F.col("severity_delta")
    if style == "app":
        mtype = F.when(label == 1, F.col("mismatch_type")).otherwise("Consistent")
    else:
        mtype = F.when(label == 0, "Consistent").when(delta > 0, "Hidden Crisis").otherwise("False Alarm")
    return scored.select(
        "ticket_id",
        F.col("priority_norm").alias("assigned_priority"),
        F.col("inferred_severity_label").alias("inferred_severity"),
        label.alias("mismatch_label"),
        mtype.alias("mismatch_type"),
        "severity_delta",
        F.round(F.col(confidence_col), 4).alias("confidence"),
    )


def predict(audited_nlp: DataFrame, model=None, style: str = "cli") -> DataFrame:
    """Batch prediction rows (M6/M7): the classifier's label when a model is given
    (``operators.model``), else the rule-only fallback. ``audited_nlp`` comes from
    ``audit(..., mode='nlp')`` and, with a model, must carry ``model_input``."""
    if model is None:
        return rule_predictions(audited_nlp, style)
    from prioscope.operators.model import score
    return model_predictions(score(model, audited_nlp), style=style)
