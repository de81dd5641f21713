"""Dossiers: evidence order and grounding, validator, JSON extraction, styles."""

from pyspark.sql import functions as F

from prioscope.operators import dossier as D
from conftest import rows

AUDITED_SCHEMA = ("ticket_id string, full_text string, subject string, channel string, "
                  "resolution_hours double, priority_norm string, inferred_severity_label string, "
                  "severity_delta int, mismatch_label int, mismatch_type string, crit_kw_count int, "
                  "esc_phrase_count int, negation_count int, top_keywords array<string>")


def _audited(spark):
    return spark.createDataFrame([
        ("T1", "Outage: system crash, team blocked", "Outage", "Phone", 80.0, "Low", "Critical", 3, 1,
         "Hidden Crisis", 2, 1, 1, ["outage", "system crash"]),
        ("T2", "Please update invoice", "Invoice", "Email", 2.0, "Critical", "Low", -3, 1,
         "False Alarm", 0, 0, 0, []),
        ("T3", "Fine", "Fine", "Chat", 30.0, "Medium", "Medium", 0, 0, "Consistent", 0, 0, 0, []),
    ], AUDITED_SCHEMA)


def test_notebook_evidence_order(spark):
    ev = D.evidence_rows(D.build_dossiers(_audited(spark)))
    got = rows(ev.where("ticket_id = 'T1'").orderBy("pos"), "signal", "value", "weight")
    assert got == [
        ("keyword", "outage", "high"), ("keyword", "system crash", "medium"),
        ("escalation_phrase", "1 escalation phrase(s) detected in description", "high"),
        ("negation", "1 negation pattern(s) detected (e.g. 'cannot', 'not working')", "medium"),
        ("resolution_time", "80.0 hours", None), ("channel", "Phone", None)]
    interp = rows(ev.where("ticket_id = 'T1' and signal in ('resolution_time', 'channel')").orderBy("pos"),
                  "interpretation")
    assert interp[0][0].startswith("Significantly above average")
    assert interp[1][0].startswith("Phone/Social")


def test_only_flagged_and_type_by_sign(spark):
    d = D.build_dossiers(_audited(spark)).select("dossier.*")
    assert sorted(rows(d, "ticket_id", "mismatch_type")) == [("T1", "Hidden Crisis"), ("T2", "False Alarm")]
    text = d.where("ticket_id = 'T2'").first().constraint_analysis
    assert text.startswith("The ticket was assigned Critical") and "2.0 hours" in text


def test_app_style_all_tickets(spark):
    d = D.build_dossiers(_audited(spark), style="app").select("dossier.*")
    t3 = d.where("ticket_id = 'T3'").first()
    assert t3.mismatch_type == "Consistent" and t3.constraint_analysis == "Priority aligns with ticket content."
    assert t3.feature_evidence[0].value == "30.0 hours"


def test_validator(spark):
    d = D.build_dossiers(_audited(spark))
    bad_kw = F.struct(F.lit("keyword").alias("signal"), F.lit("meltdown").alias("value"),
                      F.lit("high").alias("weight"), F.lit(None).cast("string").alias("interpretation"))
    short = F.struct(F.lit("keyword").alias("signal"), F.lit("zzz").alias("value"),
                     F.lit("high").alias("weight"), F.lit(None).cast("string").alias("interpretation"))
    d = d.withColumn("dossier", F.col("dossier").withField(
        "feature_evidence", F.concat("dossier.feature_evidence", F.array(bad_kw, short))))
    d = d.withColumn("dossier", F.col("dossier").dropFields("confidence"))
    v = {r.ticket_id: r.violations for r in D.validate_dossiers(d).collect()}
    assert v["T1"] == ["Missing key: confidence", 'Hallucinated keyword evidence: "meltdown"']


def test_null_is_not_absent_and_texts_are_not_mixed(spark):
    d = D.build_dossiers(_audited(spark), confidence=F.lit(None).cast("double"))
    assert all(r.violations == [] for r in D.validate_dossiers(d).collect())
    one = d.where("ticket_id = 'T1'").drop("full_text", "subject")
    t = spark.createDataFrame([("T1", "zz outage", "system crash"), ("T1", "bb", "zeta")], "ticket_id string, full_text string, subject string")
    v = D.validate_dossiers(one, t).first().violations  # the text of the row (bb, zeta)
    assert v == ['Hallucinated keyword evidence: "outage"', 'Hallucinated keyword evidence: "system crash"']


def test_validator_joins_ticket_text(spark):
    d = D.build_dossiers(_audited(spark)).drop("full_text", "subject")
    tickets = _audited(spark).select("ticket_id", "full_text", "subject")
    assert all(r.valid for r in D.validate_dossiers(d, tickets).collect())


def test_json_extraction(spark):
    df = spark.createDataFrame([
        ("a", '```json\n{"ticket_id": "1", "severity_delta": 2}\n```'),
        ("b", 'Sure! Here it is: {"ticket_id": "2", "mismatch_type": "False Alarm"} hope it helps'),
        ("c", '{"ticket_id": "3", "severity_'),
        ("d", "no json at all"),
        ("e", '{"mismatch_type": "False Alarm", "severity_delta": 2.0}'),
        ("f", '{"ticket_id": "6", "severity_delta": }'),
    ], "k string, response string")
    got = {r.k: r.parsed for r in D.parse_responses(df).collect()}
    assert got["e"].ticket_id is None and got["e"].severity_delta == 2 and got["f"] is None
    assert got["a"].ticket_id == "1" and got["a"].severity_delta == 2
    assert got["b"].mismatch_type == "False Alarm"
    assert got["c"] is None and got["d"] is None


def test_json_round_trip(spark):
    j = D.dossier_json(D.build_dossiers(_audited(spark)))
    back = D.parse_responses(j.withColumnRenamed("dossier_json", "response"))
    assert all(r.parsed is not None and r.parsed.ticket_id == r.ticket_id for r in back.collect())


def test_pending_anti_join(spark):
    a = _audited(spark)
    cache = a.where("ticket_id = 'T1'")
    assert rows(D.pending(a.where("mismatch_label = 1"), cache), "ticket_id") == [("T2",)]


def test_prompt_cuts_description(spark):
    a = _audited(spark).withColumn("full_text", F.lit("x" * 1000))
    assert "- description: " + "x" * 1000 + "\n" in D.with_prompt(a).first().prompt
    p = D.with_prompt(a, max_chars=400).first().prompt
    assert "- description: " + "x" * 400 + "\n" in p and "x" * 401 not in p


def test_validator_join_with_duplicated_ids_does_not_multiply(spark):
    d = D.build_dossiers(_audited(spark)).drop("full_text", "subject")
    t = _audited(spark).select("ticket_id", "full_text", "subject")
    hot = t.unionByName(t).unionByName(t)  # every id three times
    assert D.validate_dossiers(d, hot).count() == d.count()


def test_grounding_against_all_texts_of_an_id(spark):
    tickets = spark.createDataFrame([("a", "Server is DOWN", "Help"), ("a", "other text", "Billing"), ("a", "other text", "Billing"), ("b", "quiet day", None),
                                     ("c", "billing outage", "x"), (None, "zeppelin", "")], "ticket_id string, full_text string, subject string")

    def row(i, *words):
        items = [("keyword", w, "high", None) for w in words] + [("channel", "nowhere", None, None)]
        return (i, (i, items))

    d = spark.createDataFrame([row("a", "down", "billing"), row("a", "outage"), row("b", "billing outage", "day", "zzzz"), row("z", "down"), row(None, "quiet"), ("n", ("n", None))],
                              "ticket_id string, dossier struct<ticket_id string, feature_evidence array<struct<signal string, value string, weight string, interpretation string>>>")
    got = sorted(((r.ticket_id or "", r.n_texts, r.ungrounded, r.elsewhere, r.messages) for r in D.ground_dossiers(d, tickets).collect()))
    two = "Ambiguous ticket id: 2 texts"
    assert got == [
        ("", 0, ["quiet"], [1], ["No ticket text", 'Ungrounded keyword: "quiet" (in 1 other tickets)']),
        ("a", 2, [], [], [two]),
        ("a", 2, ["outage"], [1], [two, 'Ungrounded keyword: "outage" (in 1 other tickets)']),
        ("b", 1, ["billing outage", "zzzz"], [1, 0], ['Ungrounded keyword: "billing outage" (in 1 other tickets)', 'Ungrounded keyword: "zzzz" (in 0 other tickets)']),
        ("n", 0, [], [], ["No ticket text"]),
        ("z", 0, ["down"], [1], ["No ticket text", 'Ungrounded keyword: "down" (in 1 other tickets)'])]


def test_a_response_is_parsed_once(spark):
    df = spark.createDataFrame([(1, 'x {"ticket_id":"7","severity_delta":2.0,"confidence":0.5} y')], "k int, response string")
    got = D.parse_responses(df)
    plan = got.select("parsed.mismatch_type", "parsed.severity_delta")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(") == 1 and plan.count("regexp_replace(") == 1
    row = got.first()
    assert got.columns == ["k", "response", "parsed"]
    assert (row.parsed.ticket_id, row.parsed.severity_delta, row.parsed.confidence, row.parsed.mismatch_type) == ("7", 2, 0.5, None)
