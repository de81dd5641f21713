"""Reports and metrics edge cases, and the exact stratified split."""

import pandas as pd
from pyspark.sql import functions as F

from prioscope.operators import metrics as M
from prioscope.operators import reports as R
from prioscope.operators.dataset import class_weights, stratified_split
from conftest import rows


def test_metrics_class_never_predicted(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (1, 0)], "label int, prediction int")
    m = M.classification_metrics(df).first()
    rep = {r.class_name: r for r in M.classification_report(df).collect()}
    assert rep["Mismatch"].precision == 0.0 and m.recall_class1 == 0.0 and m.accuracy == round(1 / 3, 4)


def test_thresholds_use_raw_values_and_confusion_is_two_by_two(spark):
    raw = spark.createDataFrame([(0.82996, 0.9, 0.9, 0.9)], "accuracy double, macro_f1 double, recall_class0 double, recall_class1 double")
    assert {r.metric: r.passed for r in M.threshold_checks(raw).collect()}["accuracy"] is False
    one = spark.createDataFrame([(1, 0), (1, 1)], "label int, prediction int")
    assert sorted(rows(M.confusion(one))) == [(0, 0, 0), (1, 1, 1)]
    assert rows(R.value_counts(spark.createDataFrame([("b",), ("a",), ("c",), ("c",)], "v string"), "v")) == [("c", 2), ("a", 1), ("b", 1)]


def test_histogram_max_in_last_bin(spark):
    df = spark.createDataFrame([(0.0,), (10.0,), (5.0,)], "x double")
    h = {r.bin: r.n for r in R.histogram(df, "x", 40).collect()}
    assert h[40] == 1 and h[1] == 1 and h[21] == 1 and sum(h.values()) == 3 and len(h) == 40


def test_histogram_constant(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    h = {r.bin: r.n for r in R.histogram(df, "x", 40).collect()}
    assert h[21] == 2


def test_top_values_ties(spark):
    ev = spark.createDataFrame([("keyword", v) for v in ["bbb", "aaa", "ccc", "ccc", "nan", "ab"]],
                               "signal string, value string")
    assert rows(R.top_values(ev, 2), "value", "n") == [("ccc", 2), ("aaa", 1)]


def test_delta_histogram_has_zero_rows(spark):
    df = spark.createDataFrame([(1,), (1,), (-2,)], "severity_delta int")
    got = dict(rows(R.delta_histogram(df)))
    assert got == {-4: 0, -3: 0, -2: 1, -1: 0, 0: 0, 1: 2, 2: 0, 3: 0, 4: 0}


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 3 + [(1,)], "mismatch_label int")
    got = dict(rows(class_weights(df), "mismatch_label", "weight"))
    assert got == {0: 4 / 6, 1: 2.0}


def test_null_counts(spark):
    df = spark.createDataFrame([(1, None), (None, None)], "a int, b string")
    assert dict(rows(R.null_counts(df))) == {"a": 1, "b": 2}


def _brute_split(pdf):
    import hashlib
    out = {}
    for lab, g in pdf.groupby("mismatch_label"):
        keyed = sorted(((hashlib.md5(f"{i}|42".encode()).hexdigest(), i) for i in g.ticket_id))
        n = len(keyed)
        for r, (_, i) in enumerate(keyed, start=1):
            out[i] = "train" if r <= int(n * 0.70) else ("val" if r <= int(n * 0.85) else "test")
    return out


def test_split_equals_brute_force_and_is_skew_proof(spark):
    # one class holds 90% of rows; ids are strings
    data = [(f"id{i}", 0 if i % 10 else 1) for i in range(3000)]
    df = spark.createDataFrame(data, "ticket_id string, mismatch_label int").repartition(7)
    got = {r.ticket_id: r.split for r in stratified_split(df, prefix=2).collect()}
    want = _brute_split(pd.DataFrame(data, columns=["ticket_id", "mismatch_label"]))
    assert got == want


def test_split_partition_invariant(spark):
    df = spark.range(0, 2000).select(F.col("id").cast("string").alias("ticket_id"),
                                     (F.col("id") % 3 == 0).cast("int").alias("mismatch_label"))
    a = stratified_split(df).select("ticket_id", "split")
    b = stratified_split(df.repartition(11)).select("ticket_id", "split")
    assert a.exceptAll(b).count() == 0
