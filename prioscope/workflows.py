"""End-to-end jobs composed from the operators: the three flows of the original tool.

* ``label_and_train``: ticket export -> audited pseudo-labels (Parquet) -> exact
  stratified split -> class-weighted model -> test metrics (JSON) + saved model.
* ``predict_batch``: ticket export -> prediction rows (CSV) + dossiers of the flagged
  tickets (JSON lines); uses a saved model when one loads, else the rule-only path.
* ``dashboard``: dossiers -> KPI, type counts, delta counts, crosstab, top keywords.

Inputs are read whole; every table is written by Spark (partitioned files), nothing
is gathered on the driver except 1-row metric tables.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prioscope.lexicon import CORE
from prioscope.operators import dossier as D
from prioscope.operators import metrics as M
from prioscope.operators import model as ML
from prioscope.operators import newton
from prioscope.operators import reports as R
from prioscope.operators.audit import audit, model_predictions, rule_predictions
from prioscope.operators.clean import clean, time_baseline
from prioscope.operators.dataset import stratified_split, with_model_input
from prioscope.session import materialize
from prioscope.sources.dossiers import read_dossiers, write_dossiers, write_predictions_csv
from prioscope.sources.tickets import read_tickets

LABEL_COLUMNS = [
    "ticket_id", "full_text", "subject", "description", "priority_norm", "priority_score",
    "channel", "ticket_type", "resolution_hours", "nlp_severity", "rt_severity",
    "inferred_severity", "inferred_severity_label", "severity_delta", "mismatch_label",
    "mismatch_type", "crit_kw_count", "high_kw_count", "esc_phrase_count", "negation_count",
    "top_keywords",
]


def audited_tickets(spark: SparkSession, path: str, fmt: str = "csv", lexicon=CORE,
                    mode: str = "fused", baseline: DataFrame | None = None, rejects: str | None = None) -> DataFrame:
    """Audited tickets of an export. ``baseline`` is a stored one (``stored_baseline``); without it
    the hours of the export itself are the reference. Refused records go to ``rejects``."""
    t = clean(read_tickets(spark, path, fmt, rejects=rejects), impute=False)
    return audit(t, lexicon, mode, baseline=baseline if baseline is not None else time_baseline(t))


def stored_baseline(spark: SparkSession, model_dir: str | None) -> DataFrame | None:
    """The hours baseline that ``label_and_train`` put beside its model, if it is there."""
    try:
        return spark.read.parquet(os.path.join(model_dir, "..", "baseline")) if model_dir else None
    except AnalysisException:
        return None


def label_and_train(spark: SparkSession, path: str, out_dir: str, fmt: str = "csv",
                    reg_params=(0.0, 0.01), classifier: str = "text") -> dict:
    """Pseudo-label, split, train, evaluate; returns the test metrics.

    ``classifier="text"`` fits the Spark ML pipeline over whole texts, ``"newton"`` the one over
    counts whose every step can be repeated (``operators.newton``). The hours baseline is
    stored for later scoring, refused records are written to ``rejects``."""
    t = clean(read_tickets(spark, path, fmt, rejects=os.path.join(out_dir, "rejects") if fmt == "csv" else None), impute=False)
    base = os.path.join(out_dir, "baseline")
    time_baseline(t).write.mode("error").parquet(base)
    labelled = audit(t, CORE, "fused", baseline=spark.read.parquet(base)).select(*LABEL_COLUMNS, "med_kw_count", "low_kw_count")
    labelled.write.mode("error").parquet(os.path.join(out_dir, "pseudo_labeled"))
    data = materialize(stratified_split(with_model_input(
        spark.read.parquet(os.path.join(out_dir, "pseudo_labeled")))), "train-split")
    where, test = os.path.join(out_dir, "model"), data.where("split = 'test'")
    if classifier == "newton":
        model = newton.train(data)
        newton.save(spark, model, where)
        scored = newton.score(model, test)
    else:
        model = ML.train(data.where("split = 'train'"), data.where("split = 'val'"), reg_params)
        ML.save(model, where)
        scored = ML.score(model, test)
    metrics = M.classification_metrics(scored, "mismatch_label", "prediction")
    metrics.coalesce(1).write.mode("error").json(os.path.join(out_dir, "metrics"))
    return metrics.first().asDict()


def predict_batch(spark: SparkSession, path: str, out_dir: str, model_dir: str | None = None,
                  fmt: str = "csv") -> None:
    """Prediction rows for every ticket and dossiers for the flagged ones. The scored tickets are
    written once and both sinks read them; hours are judged by the model's stored baseline."""
    a = audited_tickets(spark, path, fmt, mode="nlp", baseline=stored_baseline(spark, model_dir),
                        rejects=os.path.join(out_dir, "rejects") if fmt == "csv" else None)
    text = ML.load(model_dir) if model_dir else None
    counts = newton.load(spark, model_dir) if model_dir and text is None else None
    if text is None and counts is None:
        scored = materialize(a.withColumn("confidence", F.lit(0.80)), "scored")
        preds, flagged = rule_predictions(scored), scored
    else:
        scored = ML.score(text, with_model_input(a)) if text is not None else newton.score(counts, a)
        scored = materialize(scored, "scored")
        preds, flagged = model_predictions(scored), scored.withColumn("mismatch_label", F.col("prediction"))
    write_predictions_csv(preds, os.path.join(out_dir, "predictions"))
    write_dossiers(D.build_dossiers(flagged, style="cli"), os.path.join(out_dir, "dossiers"))


def dashboard(spark: SparkSession, dossier_path: str) -> dict[str, DataFrame]:
    """Dashboard tables over stored dossiers (empty tables when there are none)."""
    d = read_dossiers(spark, dossier_path).select("dossier.*")
    d = d.withColumn("priority_norm", F.col("assigned_priority")) \
         .withColumn("inferred_severity_label", F.col("inferred_severity"))
    return {
        "kpis": R.kpis(d),
        "mismatch_types": R.value_counts(d, "mismatch_type"),
        "severity_delta": R.value_counts(d, "severity_delta").orderBy("severity_delta"),
        "crosstab": R.crosstab(d),
        "top_keywords": R.top_values(D.evidence_rows(
            read_dossiers(spark, dossier_path)), 15),
    }
