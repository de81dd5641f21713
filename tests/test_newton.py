"""Newton classifier against numpy, candidates and patience, saving, and the defined cases."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from prioscope.operators import newton as N

COLUMNS = ("ticket_id string, mismatch_label int, split string, channel string, ticket_type string, resolution_hours double, "
           + ", ".join(f"{c} int" for c in N.COUNTS))


def frame(spark, n=400, seed=0, label=None):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        k = rng.integers(0, 3, 6).tolist()
        y = int(rng.random() < 1 / (1 + np.exp(2 - k[0] - 0.5 * k[4]))) if label is None else label
        rows.append((str(i), y, ("train", "train", "val", "test")[i % 4], ["Chat", "Email", None][i % 3], "A", float(rng.integers(1, 90)), *k))
    return spark.createDataFrame(rows, COLUMNS).repartition(5)


def numpy_steps(rows, categories, ridge, start, steps):
    X = np.array([[1.0, *[r[c] for c in N.COUNTS], r["resolution_hours"] / 24.0,
                   *[float(r[c] == v) for c, vs in categories.items() for v in vs[1:]]] for r in rows])
    y = np.array([r["mismatch_label"] for r in rows])
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    b, out = start, []
    for _ in range(steps):
        p = 1 / (1 + np.exp(-X @ b))
        g = X.T @ (w * (p - y)) / w.sum() + ridge * b
        h = (X * (w * p * (1 - p))[:, None]).T @ X / w.sum() + ridge * np.eye(len(b))
        b = b - np.linalg.solve(h, g)
        out.append(b)
    return out


def test_steps_equal_numpy_and_candidates_start_warm(spark):
    data = frame(spark)
    model = N.train(data, patience=9)
    assert model.categories == {"channel": ["Chat", "Email"], "ticket_type": ["A"]}
    rows = data.where("split = 'train'").collect()
    first = [v for v in model.versions if v.candidate == 0]
    assert [v.epoch for v in first] == [1, 2, 3, 4]
    for v, want in zip(first, numpy_steps(rows, model.categories, 0.1, np.zeros(9), 4)):
        np.testing.assert_allclose(v.weights, want, rtol=1e-9, atol=1e-12)
    best = max(first, key=lambda v: v.macro_f1)
    second = [v for v in model.versions if v.candidate == 1]
    for v, want in zip(second, numpy_steps(rows, model.categories, 0.001, np.array(best.weights), 4)):
        np.testing.assert_allclose(v.weights, want, rtol=1e-8, atol=1e-10)
    assert sum(v.chosen for v in model.versions) == 1 and model.best.macro_f1 == max(v.macro_f1 for v in model.versions)
    scored = N.score(model, data).collect()
    assert np.mean([r["prediction"] == r["mismatch_label"] for r in scored]) > 0.65
    assert all(0.5 <= r["confidence"] <= 1 and r["epoch"] == model.best.epoch for r in scored)


def test_patience_ends_a_candidate(spark):
    model = N.train(frame(spark, 200, 1), ridges=(10.0,), epochs=20, patience=2)
    epochs = [v.epoch for v in model.versions]
    assert epochs == list(range(1, model.best.epoch + 3)) or len(epochs) == 20


def test_result_does_not_depend_on_the_partitions(spark):
    a, b = N.train(frame(spark).repartition(1)), N.train(frame(spark).repartition(23))
    np.testing.assert_allclose(a.best.weights, b.best.weights, rtol=1e-9)


def test_one_class_empty_and_quoted_category(spark):
    one = N.train(frame(spark, 80, 2, label=1))
    assert {r["prediction"] for r in N.score(one, frame(spark, 40, 3)).collect()} == {1}
    none = N.train(frame(spark, 8).where("false"))
    assert N.score(none, frame(spark, 8)).where("confidence <> 0.5").count() == 0
    odd = frame(spark, 100).withColumn("channel", F.when(F.col("channel") == "Chat", "it's \\ odd").otherwise("b"))
    assert N.score(N.train(odd, epochs=1), odd).count() == 100


def test_save_and_load(spark, tmpdir_fresh):
    model = N.train(frame(spark, 120))
    path = os.path.join(tmpdir_fresh, "m")
    N.save(spark, model, path)
    again = N.load(spark, path)
    assert again.best.weights == pytest.approx(model.best.weights, abs=0) and len(again.versions) == len(model.versions)
    assert N.versions(spark, again).where("chosen").count() == 1
    assert N.load(spark, os.path.join(tmpdir_fresh, "nope")) is None


def test_a_candidate_takes_the_sums_of_the_pass_that_judged_its_start(spark, monkeypatch):
    made, one_pass = [], N._pass
    monkeypatch.setattr(N, "_pass", lambda *a: made.append(a[1]) or one_pass(*a))
    model = N.train(frame(spark), patience=9)
    assert len(model.versions) == 8 and len(made) == 9  # one at the zero weights, one for each version
    assert len({tuple(w) for w in made}) == 9


def test_pass_counts_rows_with_every_feature(spark):
    data = frame(spark).withColumn("resolution_hours", F.when(F.col("ticket_id").cast("int") % 5 != 0, F.col("resolution_hours")))
    data = data.withColumn("mismatch_label", F.when(F.col("ticket_id").cast("int") % 7 != 0, F.col("mismatch_label")))
    categories = {"channel": ["Chat", "Email"], "ticket_type": ["A"]}
    weights = np.linspace(-0.4, 0.5, 9)
    g, h, f1 = N._pass(N.with_features(data, categories), weights, {0: 0.75, 1: 1.5}, 2.0, "mismatch_label")
    rows = [r for r in data.collect() if r["resolution_hours"] is not None]
    X = np.array([[1.0, *[r[c] for c in N.COUNTS], r["resolution_hours"] / 24.0, float(r["channel"] == "Email")] for r in rows])
    y = np.array([np.nan if r["mismatch_label"] is None else r["mismatch_label"] for r in rows])
    train, val = np.array([r["split"] == "train" for r in rows]), np.array([r["split"] == "val" for r in rows])
    p, w = 1 / (1 + np.exp(-X @ weights)), np.where(y == 1, 1.5, 0.75)
    np.testing.assert_allclose(g, X[train].T @ np.nan_to_num(w * (p - y))[train] / 2.0, rtol=1e-9, atol=1e-12)
    np.testing.assert_allclose(h, (X * (w * p * (1 - p))[:, None])[train].T @ X[train] / 2.0, rtol=1e-9, atol=1e-12)
    pos = X @ weights >= 0
    assert f1 == N._macro_f1(*[int((val & a & b).sum()) for a, b in ((y == 1, pos), (y == 0, pos), (y == 1, ~pos), (y == 0, ~pos))])
