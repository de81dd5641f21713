"""End-to-end jobs on a CSV export written from the sf0.001 adapter tickets."""

import os

from pyspark.sql import functions as F

from prioscope import workflows as W
from prioscope.sources.driver_tables import raw_tickets
from conftest import SF001


def _export(spark, root):
    raw = raw_tickets(spark, SF001)
    out = raw.select(
        F.col("ticket_id").alias("Ticket ID"), F.col("subject").alias("Ticket Subject"),
        F.col("description").alias("Ticket Description"), F.col("priority").alias("Priority Level"),
        F.col("channel").alias("Ticket Channel"), F.col("ticket_type").alias("Issue Category"),
        F.col("resolution_hours").cast("string").alias("Resolution Time Hours"))
    path = os.path.join(root, "export")
    out.coalesce(2).write.option("header", True).option("escape", '"').csv(path)
    return path, raw.count()


def test_train_predict_dashboard(spark, tmpdir_fresh):
    path, n = _export(spark, tmpdir_fresh)
    a = W.audited_tickets(spark, path)
    assert a.count() == n
    m = W.label_and_train(spark, path, os.path.join(tmpdir_fresh, "run"), reg_params=(0.01,))
    assert set(m) == {"accuracy", "macro_f1", "recall_class0", "recall_class1"}
    out_rules = os.path.join(tmpdir_fresh, "pred_rules")
    W.predict_batch(spark, path, out_rules)
    preds = spark.read.option("header", True).csv(os.path.join(out_rules, "predictions"))
    assert preds.count() == n
    out_model = os.path.join(tmpdir_fresh, "pred_model")
    W.predict_batch(spark, path, out_model, model_dir=os.path.join(tmpdir_fresh, "run", "model"))
    assert spark.read.option("header", True).csv(os.path.join(out_model, "predictions")).count() == n
    board = W.dashboard(spark, os.path.join(out_rules, "dossiers"))
    k = board["kpis"].first()
    flagged = preds.where("mismatch_label = '1'").count()
    assert k.total == flagged and k.mismatches == flagged
    empty = W.dashboard(spark, os.path.join(tmpdir_fresh, "none"))
    assert empty["kpis"].first().total == 0


def test_count_model_scores_by_its_stored_baseline(spark, tmpdir_fresh):
    path, n = _export(spark, tmpdir_fresh)
    run, out = os.path.join(tmpdir_fresh, "run"), os.path.join(tmpdir_fresh, "pred")
    m = W.label_and_train(spark, path, run, classifier="newton")
    assert set(m) == {"accuracy", "macro_f1", "recall_class0", "recall_class1"}
    few = os.path.join(tmpdir_fresh, "few")
    os.makedirs(few)
    with open(os.path.join(few, "a.csv"), "w") as f:
        f.write('Ticket ID,Ticket Subject,Ticket Description,Priority Level,Resolution Time Hours\n'
                '1,Site,"it is down,\nall of it",Low,\n2,a,b,Low,5,surplus\n3,Logo,colour,Critical,900\n')
    W.predict_batch(spark, few, out, model_dir=os.path.join(run, "model"))
    got = {r.ticket_id: r for r in spark.read.option("header", True).csv(os.path.join(out, "predictions")).collect()}
    assert sorted(got) == ["1", "3"]
    median = spark.read.parquet(os.path.join(run, "baseline")).first().hours_median
    a = W.audited_tickets(spark, few, mode="nlp", baseline=W.stored_baseline(spark, os.path.join(run, "model")))
    assert {r.ticket_id: r.resolution_hours for r in a.collect()} == {"1": median, "3": 900.0}
    assert spark.read.json(os.path.join(out, "rejects")).first().record == "2,a,b,Low,5,surplus"
    assert W.stored_baseline(spark, os.path.join(tmpdir_fresh, "none", "model")) is None
