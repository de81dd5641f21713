"""Our own ten challenge tickets (one per kind), scored by the keyword-only baseline.

Texts are our own; their assigned priority, score and severity are pinned by hand so
the baseline answers 4 of 10 correctly.
"""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from prioscope.lexicon import BASELINE, CORE
from prioscope.operators.audit import audit
from prioscope.operators.clean import clean
from prioscope.operators.challenge import bonus, scoreboard

CHALLENGE = [
    # id, subject, description, priority, true_label, kind, expected (severity, score, label)
    ("C01", "Quick note", "The nightly sync failed and we cannot restart it", "Low", 1, "crisis under a mild subject", (3, 3.0, 1)),
    ("C02", "URGENT EMERGENCY", "Please respond immediately, asap: can we update our invoice address?",
     "Critical", 1, "alarm words over a routine request", (4, 16.0, 0)),
    ("C03", "Thanks!", "Great service as always; by the way all customer records vanished overnight",
     "Low", 1, "crisis inside praise", (1, 0.0, 0)),
    ("C04", "Logo", "The logo colour looks wrong on the sign-in page", "Critical", 1,
     "cosmetic request marked Critical", (2, 2.0, 1)),
    ("C05", "Platform", "Our whole platform has been unavailable for every customer since this morning",
     "Medium", 1, "calm text on a serious outage", (1, 0.0, 0)),
    ("C06", "URGENT: BROKEN", "A tooltip has a typo", "High", 1, "trivial defect under a loud subject", (4, 8.0, 0)),
    ("C07", "Backups", "Last week's backups seem to be missing from the archive", "Low", 1,
     "silent backup loss", (1, 0.0, 0)),
    ("C08", "Profile", "How do I change my profile picture?", "Low", 0, "harmless question", (1, 0.0, 0)),
    ("C09", "Invoice", "There might be a small error in the totals, maybe a wrong rounding", "Medium", 1,
     "hedged financial error", (3, 4.0, 0)),
    ("C10", "Exports", "Exports take a bit longer than usual; we use the CSV button meanwhile", "Medium", 0,
     "minor delay with a workaround", (1, 0.0, 0)),
]

SCHEMA = T.StructType([T.StructField(n, t) for n, t in [
    ("ticket_id", T.StringType()), ("subject", T.StringType()), ("description", T.StringType()),
    ("priority", T.StringType()), ("true_label", T.IntegerType()), ("kind", T.StringType())]])


def _frame(spark):
    return spark.createDataFrame([c[:6] for c in CHALLENGE], SCHEMA)


def test_baseline_scores_pinned(spark):
    t = clean(_frame(spark))
    a = audit(t, BASELINE, mode="nlp").orderBy("ticket_id").collect()
    got = [(r.nlp_severity, r.nlp_score, r.mismatch_label) for r in a]
    assert got == [c[6] for c in CHALLENGE]


def test_scoreboard_four_of_ten(spark):
    t = clean(_frame(spark))
    base = audit(t, BASELINE, mode="nlp").select("ticket_id", "true_label",
                                                  F.col("mismatch_label").alias("keyword_pred"))
    core = audit(t, CORE, mode="nlp").select("ticket_id", F.col("mismatch_label").alias("model_pred"))
    board = bonus(scoreboard(base.join(core, "ticket_id"))).first()
    assert (board.n, board.keyword_correct) == (10, 4)
    assert board.bonus_earned is False


def test_compare_predictions_one_row_per_ticket(spark):
    from prioscope.operators.challenge import compare_predictions
    truth = spark.createDataFrame([("a", 1), ("b", 0)], "ticket_id string, true_label int")
    kw = spark.createDataFrame([("a", 1), ("a", 0), ("a", 1), ("b", 0)], "ticket_id string, prediction int")
    out = compare_predictions(truth, kw, kw)
    assert sorted((r.ticket_id, r.keyword_pred) for r in out.collect()) == [("a", 1), ("b", 0)]


def test_match_names_gaps_repeats_and_contradictions(spark):
    from prioscope.operators.challenge import match_predictions
    pred = "ticket_id string, prediction int"
    truth = spark.createDataFrame([("a", 0), ("b", 1), ("c", 1), ("d", 1), ("e", 0), (None, 1)], "ticket_id string, true_label int")
    keyword = spark.createDataFrame([("a", 0), ("a", 1), ("b", 1), ("b", 1), ("d", 1), ("f", 1), (None, 1)], pred)
    model = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1), ("e", 0), ("f", 1), (None, 0)], pred)
    got = {r.ticket_id: r for r in match_predictions(truth, keyword, model).collect()}
    assert {k: r.status for k, r in got.items()} == {
        "a": "ambiguous", "b": "repeated", "c": "no_keyword", "d": "no_model", "e": "no_keyword", "f": "no_truth", None: "ok"}
    assert got["a"].keyword_pred is None and got["a"].keyword_correct is None and got["a"].model_correct is True
    assert (got["b"].n_keyword, got["b"].keyword_correct, got["b"].model_correct) == (2, True, False)
    assert (got["f"].n_truth, got["f"].true_label, got[None].keyword_correct) == (0, None, True)


def test_results_and_loader(spark, tmpdir_fresh):
    import json
    import os
    from prioscope.operators.challenge import read_challenge, write_results
    t = clean(_frame(spark))
    a = audit(t, BASELINE, mode="nlp").select("ticket_id", "true_label", F.col("mismatch_label").alias("keyword_pred"))
    out = os.path.join(tmpdir_fresh, "out")
    write_results(a.withColumn("model_pred", F.col("true_label")), out)
    totals = spark.read.json(os.path.join(out, "totals")).first()
    assert (totals.n, totals.keyword_correct, totals.model_correct, totals.bonus_earned) == (10, 4, 10, True)
    assert spark.read.json(os.path.join(out, "results")).count() == 10
    path = os.path.join(tmpdir_fresh, "in.json")
    with open(path, "w") as f:
        for c in CHALLENGE:
            f.write(json.dumps(dict(zip(("ticket_id", "subject", "description", "priority", "true_label", "kind"), c))) + "\n")
        f.write('{"ticket_id": "x"}\n{"true_label": 1}\nbroken\n')
    back = read_challenge(spark, path)
    assert back.count() == 10
    assert audit(clean(back), BASELINE, mode="nlp").agg(F.sum((F.col("mismatch_label") == F.col("true_label")).cast("int"))).first()[0] == 4


def test_number_text(spark):
    from prioscope.functions.text import number_text
    xs = [0.0, 24.0, 52.5, 1e7, 12345678.25, 1e15, 123456789012345.6, 1e16, 1.5e16, 1e22, 0.001, 0.00012345678901234567, 0.0001, 5e-05, 1.25e-7, -3e8, 1e100]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    assert [r[0] for r in df.select(number_text(F.col("x"))).collect()] == [repr(x) for x in xs]
