"""Binary classification metrics as DataFrame aggregates.

One pass counts TP/FP/FN/TN; every metric is arithmetic on that 1-row table.
Zero division gives 0 (no error), as in the reference's metric settings. Values are rounded
only for display: threshold checks and model selection use them as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# FIXED VALUES — acceptance thresholds of the trained classifier.
THRESHOLDS = [
    ("accuracy", 0.83),
    ("macro_f1", 0.82),
    ("recall_class0", 0.78),
    ("recall_class1", 0.78),
]


def _div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return F.when((p + r) > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def counts(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    y, p = F.col(label).cast("int"), F.col(prediction).cast("int")
    return df.agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 0) & (p == 0)).alias("tn"),
    )


def _per_class(c: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select(
        "tp", "fp", "fn", "tn",
        _div(tn, tn + fn).alias("precision0"), _div(tn, tn + fp).alias("recall0"),
        _div(tp, tp + fp).alias("precision1"), _div(tp, tp + fn).alias("recall1"),
        (tn + fp).alias("support0"), (tp + fn).alias("support1"),
    ).withColumns({
        "f1_0": _f1(F.col("precision0"), F.col("recall0")),
        "f1_1": _f1(F.col("precision1"), F.col("recall1")),
    })


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """2x2 confusion matrix: a row for each true label, present or not, columns pred_0 / pred_1."""
    def row(name, zero, one):
        return F.struct(F.lit(name).alias("label"), F.col(zero).alias("pred_0"), F.col(one).alias("pred_1"))
    return counts(df, label, prediction).select(F.inline(F.array(row(0, "tn", "fp"), row(1, "fn", "tp"))))


def classification_metrics(df: DataFrame, label: str = "label",
                           prediction: str = "prediction", digits: int | None = 4) -> DataFrame:
    """accuracy, macro F1 and per-class recall; rounded like the training report, or raw
    with ``digits=None``."""
    m = _per_class(counts(df, label, prediction))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    values = {
        "accuracy": _div(F.col("tp") + F.col("tn"), n),
        "macro_f1": (F.col("f1_0") + F.col("f1_1")) / 2,
        "recall_class0": F.col("recall0"),
        "recall_class1": F.col("recall1"),
    }
    return m.select(*[(v if digits is None else F.round(v, digits)).alias(k) for k, v in values.items()])


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction",
                          names=("Consistent", "Mismatch")) -> DataFrame:
    """precision / recall / F1 / support per class, plus macro and weighted averages."""
    m = _per_class(counts(df, label, prediction))
    s0, s1 = F.col("support0"), F.col("support1")
    tot = s0 + s1

    def row(name, p, r, f, s):
        return F.struct(F.lit(name).alias("class_name"), p.alias("precision"), r.alias("recall"),
                        f.alias("f1"), s.cast("long").alias("support"))

    def wavg(a, b):
        return _div(a * s0 + b * s1, tot)

    p0, r0, f0 = F.col("precision0"), F.col("recall0"), F.col("f1_0")
    p1, r1, f1 = F.col("precision1"), F.col("recall1"), F.col("f1_1")
    return m.select(F.inline(F.array(
        row(names[0], p0, r0, f0, s0),
        row(names[1], p1, r1, f1, s1),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, tot),
        row("weighted avg", wavg(p0, p1), wavg(r0, r1), wavg(f0, f1), tot),
    )))


def threshold_checks(metrics: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """Unpivot a 1-row table of raw metrics and compare each value with its threshold."""
    return metrics.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("metric"), F.col(name).cast("double").alias("value"),
                 F.lit(t).alias("threshold"), (F.col(name) >= F.lit(t)).alias("passed"))
        for name, t in thresholds])))
