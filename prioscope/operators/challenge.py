"""Challenge evaluation (S9, M8, J5, G22): systems scored against a labelled truth."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# FIXED VALUE — correct answers needed for the challenge bonus.
BONUS_MIN_CORRECT = 7

CHALLENGE_SCHEMA = ("ticket_id string, subject string, description string, priority string, channel string, "
                    "resolution_hours string, true_label int, true_mismatch_type string, kind string")


def compare_predictions(truth: DataFrame, keyword: DataFrame, model: DataFrame) -> DataFrame:
    """Per-ticket table from separately produced prediction tables (inner joins on
    ticket_id): ticket_id, true_label, keyword_pred, model_pred, *_correct.

    Each prediction table is reduced to one row per id first (a repeated id counts as
    a mismatch if any copy says so), so a hot id cannot multiply rows in the join."""
    def one_per_id(df, out):
        return df.groupBy("ticket_id").agg(F.max("prediction").alias(out))
    j = (truth.select("ticket_id", "true_label")
         .join(one_per_id(keyword, "keyword_pred"), "ticket_id")
         .join(one_per_id(model, "model_pred"), "ticket_id"))
    return j.withColumns({
        "keyword_correct": F.col("keyword_pred") == F.col("true_label"),
        "model_correct": F.col("model_pred") == F.col("true_label"),
    })


def match_predictions(truth: DataFrame, keyword: DataFrame, model: DataFrame) -> DataFrame:
    """Every ticket of three tables (``true_label``, ``prediction``, ``prediction``), matched whole.

    A side's answer counts when all its rows for the id agree; it is null when the side has none
    or they differ. ``status`` names what keeps a ticket from being judged: ``ambiguous`` (some
    side contradicts itself), ``no_truth``, ``no_keyword``, ``no_model`` (in that order), else
    ``repeated`` (judged, some side has several equal rows) or ``ok``. ``n_truth``, ``n_keyword`` and
    ``n_model`` count the rows behind it. Rows without an id share one row. Each side is
    pre-aggregated, so a hot id cannot multiply rows."""
    def side(df, value, name):
        v = F.col(value)
        return df.groupBy("ticket_id").agg(F.when(F.min(v) == F.max(v), F.min(v)).alias(name), F.count(F.lit(1)).alias(f"n_{name}"),
                                           (F.min(v) != F.max(v)).alias(f"split_{name}"))

    sides = [side(truth, "true_label", "truth"), side(keyword, "prediction", "keyword"), side(model, "prediction", "model")]
    # one long table and a pivot by aggregation: a full outer match of any ids, null ones too
    names = ("truth", "keyword", "model")
    rows = None
    for df, own in zip(sides, names):
        part = df.select("ticket_id", *[(F.col(f"{p}{n}") if n == own else F.lit(None).cast(t)).alias(f"{p}{n}")
                                        for n in names for p, t in (("", "int"), ("n_", "long"), ("split_", "boolean"))])
        rows = part if rows is None else rows.unionByName(part)
    got = rows.groupBy("ticket_id").agg(*[F.max(c).alias(c) for c in rows.columns if c != "ticket_id"])
    got = got.select("ticket_id", *names, *[F.coalesce(f"n_{n}", F.lit(0)).cast("long").alias(f"n_{n}") for n in names],
                     F.greatest(*[F.coalesce(f"split_{n}", F.lit(False)) for n in names]).alias("split"))
    status = F.when(F.col("split"), "ambiguous")
    for n in names:
        status = status.when(F.col(f"n_{n}") == 0, f"no_{n}")
    status = status.when(F.greatest(*[F.col(f"n_{n}") for n in names]) > 1, "repeated").otherwise("ok")
    return got.select(
        "ticket_id", F.col("truth").alias("true_label"), F.col("keyword").alias("keyword_pred"), F.col("model").alias("model_pred"),
        (F.col("keyword") == F.col("truth")).alias("keyword_correct"), (F.col("model") == F.col("truth")).alias("model_correct"),
        "n_truth", "n_keyword", "n_model", status.alias("status"))


def scoreboard(per_ticket: DataFrame) -> DataFrame:
    """Totals: n, correct answers per system (one aggregate)."""
    return per_ticket.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("keyword_pred") == F.col("true_label")).alias("keyword_correct"),
        F.count_if(F.col("model_pred") == F.col("true_label")).alias("model_correct"),
    )


def bonus(board: DataFrame) -> DataFrame:
    return board.withColumn("bonus_earned", F.col("model_correct") >= BONUS_MIN_CORRECT)


def write_results(per_ticket: DataFrame, path: str) -> None:
    """The evaluation as JSON lines: ``results`` per ticket, and the totals with the bonus flag."""
    per_ticket.write.mode("error").json(os.path.join(path, "results"))
    bonus(scoreboard(per_ticket)).coalesce(1).write.mode("error").json(os.path.join(path, "totals"))


def read_challenge(spark: SparkSession, path: str) -> DataFrame:
    """Labelled challenge tickets from JSON lines; rows without an id or a label are refused."""
    rows = spark.read.schema(CHALLENGE_SCHEMA).json(path)
    return rows.where(F.col("ticket_id").isNotNull() & F.col("true_label").isin(0, 1))
