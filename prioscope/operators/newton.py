"""Mismatch classifier by weighted Newton steps.

The features are few: hit counts of the whole text, hours, channel and type. A step of the
class-weighted, ridge-penalised logistic regression is then one aggregate over the training
rows, sums for the gradient and the Hessian (15 and 120 numbers for 15 features), and a small
linear system on the driver. A task adds up its rows batch by batch as matrix products, Spark
adds up the tasks' sums, nothing is cached, and any engine that adds up the same rows comes to
the same model.

``train`` lets candidates (ridge strengths) compete: each starts from the best weights of
the one before, takes a step an epoch, and stops when validation macro F1 has not risen
for ``patience`` epochs. One pass gives both the validation counts of the weights at hand and
the sums for the next step; a candidate's first step takes those of the pass that judged its
start. Every epoch is a version; the best one is chosen (the first on
ties) and scores.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prioscope.functions.text import sql_lit

#: Hit counts that describe the text, and what hours are divided by.
COUNTS = ("crit_kw_count", "high_kw_count", "med_kw_count", "low_kw_count", "esc_phrase_count", "negation_count")
HOURS_UNIT = 24.0
#: Ridge strengths of the candidates, in this order; epochs of each at most, and patience.
RIDGES = (0.1, 0.001)
EPOCHS = 4
PATIENCE = 2
#: Values of a category that get a feature of their own; the others share the base.
MAX_CATEGORIES = 32


@dataclass
class Version:
    candidate: int
    epoch: int
    ridge: float
    macro_f1: float
    weights: list[float]
    chosen: bool = False


@dataclass
class NewtonModel:
    """Chosen weights with the categories behind their features, and the history of versions."""

    categories: dict[str, list[str]]
    versions: list[Version] = field(default_factory=list)

    @property
    def best(self) -> Version:
        return next(v for v in self.versions if v.chosen)


def categories_of(df: DataFrame, columns=("channel", "ticket_type")) -> dict[str, list[str]]:
    """The commonest values of each category in order of their names; the first is the base."""
    out = {}
    for c in columns:
        top = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), c).limit(MAX_CATEGORIES)
        out[c] = sorted(str(r[c]) for r in top.collect())
    return out


def feature_columns(categories: dict[str, list[str]]) -> list[str]:
    """SQL expressions of the features: constant, hit counts, hours, one indicator a category."""
    xs = ["1.0D", *[f"CAST({c} AS DOUBLE)" for c in COUNTS], f"resolution_hours / {HOURS_UNIT}D"]
    for c, values in categories.items():
        xs += [f"CASE WHEN {c} = {sql_lit(v)} THEN 1.0D ELSE 0.0D END" for v in values[1:]]
    return xs


def with_features(df: DataFrame, categories: dict[str, list[str]]) -> DataFrame:
    return df.select("*", *[F.expr(x).alias(f"__x{i}") for i, x in enumerate(feature_columns(categories))])


def _margin(weights) -> Column:
    return F.expr(" + ".join(f"__x{i} * {float(w)!r}D" for i, w in enumerate(weights)))


def _macro_f1(tp: int, fp: int, fn: int, tn: int) -> float:
    def f1(hit, wrong, missed):
        p = hit / (hit + wrong) if hit + wrong else 0.0
        r = hit / (hit + missed) if hit + missed else 0.0
        return 2 * p * r / (p + r) if p + r > 0 else 0.0
    return (f1(tn, fn, fp) + f1(tp, fp, fn)) / 2


def _sums(weights: np.ndarray, balance: dict[int, float]):
    """What a task adds up over batches of ``train, y, features``: place and value of each sum."""
    n = len(weights)
    upper = np.triu_indices(n)

    def run(batches):
        out = np.zeros(n + len(upper[0]) + 4)
        for batch in batches:
            train, y, *xs = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            x = np.column_stack(xs)
            z = x @ weights
            with np.errstate(over="ignore"):
                p = 1 / (1 + np.exp(-z))
            w = np.where(y == 1, balance[1], balance[0])
            e, v = np.where(np.isnan(y), 0.0, w * (p - y)), w * p * (1 - p)
            xt = x[train]
            out[:n] += e[train] @ xt
            out[n:-4] += ((xt * v[train, None]).T @ xt)[upper]
            yes, no, pos = ~train & (y == 1), ~train & (y != 1) & ~np.isnan(y), ~(z < 0)
            out[-4:] += [np.sum(a & b) for a, b in ((yes, pos), (no, pos), (yes, ~pos), (no, ~pos))]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out)), pa.int32()), pa.array(out)], names=["place", "value"])
    return run


def _pass(data: DataFrame, weights: np.ndarray, balance: dict[int, float], total: float, label: str) -> tuple[np.ndarray, np.ndarray, float]:
    """Gradient and Hessian (means over the class weights) on train and macro F1 on val, at ``weights``.
    Rows without some feature count nowhere."""
    n = len(weights)
    xs = [F.col(f"__x{i}") for i in range(n)]
    rows = data.where(F.col("split").isin("train", "val")).select((F.col("split") == "train").alias("train"), F.col(label).cast("double").alias("y"), *xs)
    for x in xs:
        rows = rows.where(x.isNotNull())
    sums = rows.mapInArrow(_sums(weights, balance), "place int, value double").groupBy("place").agg(F.sum("value").alias("value"))
    got = {r["place"]: r["value"] for r in sums.collect()}  # a row for each sum
    g = np.array([got.get(i, 0.0) for i in range(n)]) / total
    h = np.zeros((n, n))
    m = n + n * (n + 1) // 2
    h[np.triu_indices(n)] = np.array([got.get(k, 0.0) for k in range(n, m)]) / total
    return g, h + np.triu(h, 1).T, _macro_f1(*[int(got.get(m + k, 0)) for k in range(4)])


def train(data: DataFrame, label: str = "mismatch_label", ridges=RIDGES, epochs: int = EPOCHS, patience: int = PATIENCE,
          categories: dict[str, list[str]] | None = None) -> NewtonModel:
    """Fit on the ``train`` rows of ``data`` and choose by its ``val`` rows (column ``split``).
    Class weights are n / (2 n_c), so the classes weigh alike; a class that is absent leaves
    weights that follow the other. Write ``data`` once before (``session.materialize``)."""
    categories = categories or categories_of(data.where("split = 'train'"))
    x = with_features(data, categories)
    per = {r[label]: r["n"] for r in data.where("split = 'train'").groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(per.values())
    scale = {c: n / (2 * k) for c, k in per.items()}
    balance = {0: scale.get(0, 0.0), 1: scale.get(1, 0.0)}
    total = max(float(sum(scale[c] * k for c, k in per.items())), 1.0)
    model = NewtonModel(categories)
    start = np.zeros(len(feature_columns(categories)))
    first = _pass(x, start, balance, total, label)
    for number, ridge in enumerate(ridges):
        weights, best = start, None
        # one pass more than epochs: the last one only judges
        for epoch in range(epochs + 1):
            g, h, f1 = at = _pass(x, weights, balance, total, label) if epoch else first
            if epoch:
                v = Version(number, epoch, ridge, f1, [float(b) for b in weights])
                model.versions.append(v)
                if best is None or f1 > best.macro_f1:
                    best, best_at = v, at
                if epoch - best.epoch >= patience or epoch == epochs:
                    break
            weights = weights - np.linalg.solve(h + ridge * np.eye(len(weights)), g + ridge * weights)
        start, first = np.array(best.weights), best_at
    top = max(model.versions, key=lambda v: v.macro_f1)  # the first on ties
    model.versions = [replace(v, chosen=v is top) for v in model.versions]
    return model


def score(model: NewtonModel, df: DataFrame) -> DataFrame:
    """Append ``prediction`` (int), ``confidence`` (probability of the predicted class) and the
    version that gave them."""
    best = model.best
    p = 1 / (1 + F.exp(-F.col("__z")))
    scored = with_features(df, model.categories).select(*df.columns, _margin(best.weights).alias("__z"))
    return scored.select(*df.columns, (F.col("__z") >= 0).cast("int").alias("prediction"), F.greatest(p, 1 - p).alias("confidence"),
                         F.lit(best.candidate).alias("candidate"), F.lit(best.epoch).alias("epoch"))


def versions(spark: SparkSession, model: NewtonModel) -> DataFrame:
    """One row per epoch of every candidate."""
    return spark.createDataFrame([(v.candidate, v.epoch, v.ridge, v.macro_f1, v.weights, v.chosen) for v in model.versions],
                                 "candidate int, epoch int, ridge double, macro_f1 double, weights array<double>, chosen boolean")


def save(spark: SparkSession, model: NewtonModel, path: str) -> None:
    """The model as one JSON text, all versions included."""
    text = json.dumps({"categories": model.categories, "versions": [asdict(v) for v in model.versions]})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("error").text(path)


def load(spark: SparkSession, path: str) -> NewtonModel | None:
    """A saved model; ``None`` (rule-only mode) when it cannot be read."""
    try:
        body = json.loads("".join(r["value"] for r in spark.read.text(path).collect()))  # one line
        return NewtonModel(body["categories"], [Version(**v) for v in body["versions"]])
    except Exception:  # noqa: BLE001 - any load failure selects the rule path
        return None
