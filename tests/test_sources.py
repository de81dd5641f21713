"""Sinks and sources: dossier JSON round trip, absent path, CSV edge, helpers."""

import os

from pyspark.sql import functions as F

from prioscope.functions.text import from_pipe, to_pipe
from prioscope.operators import dossier as D
from prioscope.operators.audit import audit, predict
from prioscope.operators.clean import clean, keep_present
from prioscope.sources.dossiers import read_dossiers, write_dossiers, write_predictions_csv
from test_dossier import _audited


def test_dossier_json_round_trip(spark, tmpdir_fresh):
    d = D.build_dossiers(_audited(spark))
    path = os.path.join(tmpdir_fresh, "dossiers")
    write_dossiers(d, path)
    back = read_dossiers(spark, path)
    assert sorted(r.dossier for r in back.collect()) == sorted(r.dossier for r in d.collect())
    v = D.valid_only(D.validate_dossiers(back, _audited(spark)))
    assert v.count() == 2


def test_absent_dossier_path_is_empty(spark, tmpdir_fresh):
    back = read_dossiers(spark, os.path.join(tmpdir_fresh, "missing"))
    assert back.count() == 0 and "dossier" in back.columns


def test_pipe_helpers(spark):
    df = spark.createDataFrame([("a| b ||c",), (None,)], "s string")
    got = [r[0] for r in df.select(from_pipe(F.col("s"))).collect()]
    assert got == [["a", "b", "c"], []]
    assert df.select(to_pipe(from_pipe(F.col("s")))).first()[0] == "a|b|c"


def test_predictions_csv(spark, tmpdir_fresh):
    df = spark.createDataFrame([("t1", ["down", "outage"])], "ticket_id string, top_keywords array<string>")
    path = os.path.join(tmpdir_fresh, "csv")
    write_predictions_csv(df, path)
    back = spark.read.option("header", True).csv(path).first()
    assert back.top_keywords == "down|outage"


def test_keep_present(spark):
    df = spark.createDataFrame([(1, 2)], "a int, c int")
    assert keep_present(df, ["c", "b", "a"]).columns == ["c", "a"]


def test_predict_without_model_is_rule_mode(spark):
    t = clean(spark.createDataFrame([("1", "It is down", "Low")], "ticket_id string, description string, priority string"))
    p = predict(audit(t, mode="nlp")).first()
    assert (p.mismatch_label, p.mismatch_type, p.confidence) == (1, "Hidden Crisis", 0.8)
