"""Fusion, labels, types, rule/model prediction styles; sf0.01 goldens."""

import itertools

from pyspark.sql import functions as F

from prioscope.functions.scoring import fused_score, fused_severity, mismatch_label, mismatch_type
from prioscope.operators.audit import model_predictions
from conftest import SF01


def test_fusion_all_pairs(spark):
    pairs = list(itertools.product(range(1, 5), range(1, 5)))
    df = spark.createDataFrame(pairs, "a int, b int")
    got = df.select("a", "b", fused_severity(fused_score(F.col("a"), F.col("b"))).alias("s")).collect()
    assert all(r.s == (6 * r.a + 4 * r.b + 5) // 10 for r in got)


def test_mismatch_types(spark):
    df = spark.createDataFrame([(2,), (-2,), (1,), (-3,)], "d int")
    lab = mismatch_label(F.col("d"))
    got = [tuple(r) for r in df.select(lab, mismatch_type(lab, F.col("d"))).collect()]
    assert got == [(1, "Hidden Crisis"), (1, "False Alarm"), (0, "Consistent"), (1, "False Alarm")]


def test_model_label_with_zero_delta_is_false_alarm(spark):
    df = spark.createDataFrame([("t1", "High", "High", 0, "Consistent", 1, 0.9)],
                               "ticket_id string, priority_norm string, inferred_severity_label string, "
                               "severity_delta int, mismatch_type string, prediction int, confidence double")
    assert model_predictions(df).first().mismatch_type == "False Alarm"
    assert model_predictions(df, style="app").first().mismatch_type == "Consistent"


def test_goldens_sf001(spark):
    """Expected counts at sf0.01 (computed independently, see FIXTURES)."""
    from prioscope.plans.queries import audited
    a = audited(spark, SF01).cache()
    counts = {r[0]: r[1] for r in a.groupBy("mismatch_type").count().collect()}
    assert counts == {"Consistent": 11055, "Hidden Crisis": 1760, "False Alarm": 2185}
    dist = lambda c: [r[1] for r in a.groupBy(c).count().orderBy(c).collect()]
    assert dist("nlp_severity") == [3729, 3597, 2934, 4740]
    assert dist("rt_severity") == [3811, 8462, 1549, 1178]
    assert dist("inferred_severity") == [3085, 4673, 6370, 872]
    assert dist("severity_delta") == [603, 1582, 3410, 3890, 3755, 1586, 174]
    agree = a.agg(F.avg((F.col("nlp_severity") == F.col("rt_severity")).cast("double"))).first()[0]
    assert round(agree, 6) == 0.241733
    a.unpersist()


def test_full_lexicon_golden_sf001(spark):
    from prioscope.plans.queries import audited
    a = audited(spark, SF01, lexicon="full")
    assert [r[1] for r in a.groupBy("nlp_severity").count().orderBy("nlp_severity").collect()] == \
        [3729, 2734, 2934, 5603]


def test_baseline_values_sf001(spark):
    from prioscope.operators.clean import time_baseline
    from prioscope.plans.queries import tickets
    b = time_baseline(tickets(spark, SF01)).first()
    assert (b.hours_median, round(b.hours_mean, 6), round(b.hours_std, 6)) == (34.5, 44.557053, 40.716015)


def test_repartition_invariance(spark):
    from prioscope.plans.queries import audited, tickets
    from prioscope.operators.audit import audit
    from prioscope.operators.clean import time_baseline
    t = tickets(spark, SF01)
    a1 = audited(spark, SF01).select("ticket_id", "mismatch_type")
    t2 = t.repartition(13)
    a2 = audit(t2, baseline=time_baseline(t2)).select("ticket_id", "mismatch_type")
    assert a1.exceptAll(a2).count() == 0 and a2.exceptAll(a1).count() == 0


def test_rule_only_flag_filter_runs_each_keyword_test_once(spark):
    """A filter on the rule-only label must not drag the keyword tests into a pushed
    predicate (one copy per reference), which overflowed codegen and re-ran them."""
    from prioscope.lexicon import CORE
    from prioscope.operators.audit import mismatches_only
    from prioscope.plans.queries import audited
    flagged = mismatches_only(audited(spark, SF01, mode="nlp"))
    plan = flagged._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == len(CORE.esc)
    assert plan.count("Contains(__text_lc") == len(CORE.crit) * 3 + len(CORE.high) + len(CORE.neg)
    got = flagged.groupBy("mismatch_type").count().collect()
    assert {r["mismatch_type"] for r in got} <= {"Hidden Crisis", "False Alarm"}


def test_unused_text_signal_is_pruned(spark):
    """A report that reads no text column runs no keyword test at all."""
    from prioscope.plans.queries import QUERIES
    plan = QUERIES["time_signal"](spark, SF01)._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(" not in plan and "RLIKE" not in plan
