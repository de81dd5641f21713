"""Registered queries: ``(spark, sf_dir) -> DataFrame`` over the driver tables.

Every query reads the given tables (tickets are derived from ``orders`` and
``events``; document scoring reads ``documents`` whole). Computed columns carry the
same names as the DuckDB oracle in ``plans.oracle``. Floating outputs that depend on
summation order are rounded to 6 places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prioscope.lexicon import APP, BASELINE, CORE, FULL, Lexicon
from prioscope.operators import dossier as D
from prioscope.operators import metrics as M
from prioscope.operators import reports as R
from prioscope.operators.audit import audit, rule_confidence, rule_predictions, signal_mismatch
from prioscope.operators.clean import clean, time_baseline
from prioscope.operators.dataset import (class_weights, imbalance, stratified_split,
                                         with_model_input)
from prioscope.operators.ids import tag_scan, ticket_id_from_position, with_position
from prioscope.operators.challenge import bonus, match_predictions, scoreboard
from prioscope.operators.signals import with_text_signal
from prioscope.sources.driver_tables import raw_tickets, spread, table, tickets_from

# Our own lexicon for the prose in ``documents`` (licence lines, leaked tokens, IPs,
# e-mail addresses): shows a custom lexicon over whole long texts.
DOCUMENT_LEXICON = Lexicon.of(
    "documents",
    crit=["token =", "licensed under"],
    high=["license", "apache", "mit "],
    esc=[r"token.{0,5}=", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", r"@mail[0-9]\.example\.com"],
    neg=["non-commercial", "nc "],
)

R6 = 6


def _r(c, digits=R6):
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def _kw(c="top_keywords"):
    return F.array_join(F.col(c), "|").alias(c)


# ---------------------------------------------------------------- pipelines
def tickets(spark: SparkSession, sf: str) -> DataFrame:
    """Typed tickets, hours not yet imputed."""
    return clean(raw_tickets(spark, sf), impute=False)


def audited(spark: SparkSession, sf: str, lexicon=CORE, mode: str = "fused") -> DataFrame:
    t = tickets(spark, sf)
    return audit(t, lexicon, mode, baseline=time_baseline(t))


def flagged(spark: SparkSession, sf: str) -> DataFrame:
    return audited(spark, sf).where(F.col("mismatch_label") == 1)


def dossiers(spark: SparkSession, sf: str, style: str = "notebook") -> DataFrame:
    """Notebook-style dossiers explain the fused pseudo-labels; the CLI and app
    styles explain the rule-only inference, whose severity is the text signal alone."""
    mode = "fused" if style == "notebook" else "nlp"
    return D.build_dossiers(audited(spark, sf, mode=mode), style, rule_confidence(style))


def labelled_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """label = fused pseudo-label, prediction = rule-only (text severity) label.

    Both labels come from one audit pass (same rows, same text signal), so no join."""
    a = audited(spark, sf)
    return a.select("ticket_id", F.col("mismatch_label").alias("label"),
                    signal_mismatch("nlp_severity").alias("prediction"))


# ---------------------------------------------------------------- cleaning
def q_clean_tickets(spark, sf):
    t = clean(raw_tickets(spark, sf))
    return t.select(*[c for c in ("ticket_id", "subject", "description", "full_text", "priority_raw",
                                  "priority_norm", "priority_score", "channel", "ticket_type",
                                  "resolution_hours")])


def q_priority_wide(spark, sf):
    from prioscope.functions.scoring import level_score, priority_norm
    raw = raw_tickets(spark, sf)
    alt = F.col("priority_alt")
    norm = priority_norm(alt, "wide", "default")
    return raw.select("ticket_id", "priority_alt", norm.alias("priority_norm"),
                      priority_norm(alt, "wide", "keep").alias("priority_kept"),
                      priority_norm(alt, "strict", "default").alias("priority_strict"),
                      level_score(norm).alias("priority_score"))


def q_ticket_ids(spark, sf):
    orders = tag_scan(table(spark, sf, "orders").select("o_orderkey"))
    pos = with_position(orders, "pos")
    return pos.select(F.col("o_orderkey").alias("order_key"), "pos",
                      ticket_id_from_position("pos").alias("ticket_id"))


def hours_text(spark, sf):
    """Resolution times as an export would carry them: padded, signed, exponent,
    junk-suffixed, non-finite and empty texts, all derived from ``events.value``."""
    ev = table(spark, sf, "events")
    v = F.col("value")
    kind = F.pmod(F.col("event_id"), F.lit(8))
    txt = (F.when(kind == 0, F.format_string("%.2f", v))
           .when(kind == 1, F.format_string("  %.2f\t", v))
           .when(kind == 2, F.format_string("%.2fh", v))
           .when(kind == 3, F.concat(F.floor(v).cast("string"), F.lit("e0")))
           .when(kind == 4, F.lit("inf"))
           .when(kind == 5, F.lit(""))
           .when(kind == 6, F.lit("1e999"))
           .otherwise(F.format_string("+%.2f", v)))
    return ev.select(F.col("event_id").cast("string").alias("ticket_id"), txt.alias("resolution_hours"))


def q_hours_coerced(spark, sf):
    from prioscope.operators.clean import impute_hours
    t = clean(hours_text(spark, sf), impute=False)
    t = t.withColumn("hours_imputed", F.col("resolution_hours").isNull().cast("int"))
    return impute_hours(t, time_baseline(t)).select("ticket_id", "resolution_hours", "hours_imputed")


def q_blank_rejects(spark, sf):
    from prioscope.operators.clean import blank_rejects
    return blank_rejects(raw_tickets(spark, sf)).select("ticket_id", "description")


# ---------------------------------------------------------------- signals
def _text_signal(lexicon):
    def q(spark, sf):
        s = with_text_signal(tickets(spark, sf), lexicon)
        return s.select("ticket_id", "crit_kw_count", "high_kw_count", "med_kw_count", "low_kw_count",
                        "esc_phrase_count", "negation_count", "nlp_score", "nlp_severity", _kw())
    return q


def q_document_keyword_hits(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    s = with_text_signal(docs, DOCUMENT_LEXICON, text_col="text")
    return s.select("doc_id", "crit_kw_count", "high_kw_count", "esc_phrase_count",
                    "negation_count", "nlp_score", "nlp_severity", _kw())


def q_time_signal(spark, sf):
    a = audited(spark, sf)
    return a.select("ticket_id", "resolution_hours", _r("rt_zscore").alias("rt_zscore"), "rt_severity")


def q_hours_baseline(spark, sf):
    b = time_baseline(tickets(spark, sf))
    return b.select("n", "hours_median", _r("hours_mean").alias("hours_mean"),
                    _r("hours_std").alias("hours_std"))


def q_audited_tickets(spark, sf):
    a = audited(spark, sf)
    return a.select("ticket_id", "priority_norm", "priority_score", "resolution_hours",
                    "crit_kw_count", "high_kw_count", "esc_phrase_count", "negation_count",
                    "nlp_severity", "rt_severity", _r("fused_score").alias("fused_score"),
                    "inferred_severity", "inferred_severity_label", "severity_delta",
                    "mismatch_label", "mismatch_type", _kw())


def q_rule_predictions(spark, sf):
    return rule_predictions(audit(tickets(spark, sf), mode="nlp"), style="cli")


def q_rule_predictions_app(spark, sf):
    return rule_predictions(audit(tickets(spark, sf), mode="nlp"), style="app")


def q_model_input(spark, sf):
    return with_model_input(audited(spark, sf)).select("ticket_id", "model_input")


# ---------------------------------------------------------------- reports
def q_ablation(spark, sf):
    return R.ablation(audited(spark, sf)).withColumn("mismatch_rate", _r("mismatch_rate"))


def q_signal_agreement(spark, sf):
    return R.agreement(audited(spark, sf)).withColumn("agreement", _r("agreement"))


def q_value_counts_priority(spark, sf):
    return R.value_counts(tickets(spark, sf), "priority_norm")


def q_value_counts_type(spark, sf):
    return R.value_counts(audited(spark, sf), "mismatch_type")


def q_null_counts(spark, sf):
    return R.null_counts(raw_tickets(spark, sf))


def q_mismatch_rate_by_priority(spark, sf):
    return R.mismatch_rate_by(audited(spark, sf)).withColumn("mismatch_rate", _r("mismatch_rate"))


def q_mismatch_summary(spark, sf):
    return R.mismatch_summary(audited(spark, sf)).withColumn("mismatch_rate", _r("mismatch_rate"))


def q_delta_histogram(spark, sf):
    return R.delta_histogram(audited(spark, sf))


def q_hours_histogram(spark, sf):
    h = R.histogram(tickets(spark, sf), "resolution_hours", 40)
    return h.select("bin", _r("bin_lo").alias("bin_lo"), _r("bin_hi").alias("bin_hi"), "n")


def q_hours_describe(spark, sf):
    d = R.describe(audited(spark, sf), "resolution_hours")
    return d.select(*[_r(c).alias(c) if c != "count" else F.col(c) for c in d.columns])


def q_kpis(spark, sf):
    return R.kpis(audited(spark, sf)).withColumn("mismatch_share", _r("mismatch_share"))


def q_priority_crosstab(spark, sf):
    return R.crosstab(audited(spark, sf))


def q_top_keywords(spark, sf):
    return R.top_values(D.evidence_rows(dossiers(spark, sf)), 15)


def q_class_weights(spark, sf):
    return class_weights(audited(spark, sf)).withColumn("weight", _r("weight"))


def q_imbalance(spark, sf):
    i = imbalance(audited(spark, sf))
    return i.withColumn("share_mismatch", _r("share_mismatch")).withColumn("ratio", _r("ratio"))


def q_stratified_split(spark, sf):
    a = audited(spark, sf).select("ticket_id", "mismatch_label")
    return stratified_split(a)


def q_split_rates(spark, sf):
    return R.split_rates(q_stratified_split(spark, sf)).withColumn("mismatch_rate", _r("mismatch_rate"))


# ---------------------------------------------------------------- metrics
def q_confusion(spark, sf):
    return M.confusion(labelled_predictions(spark, sf))


def q_classification_metrics(spark, sf):
    return M.classification_metrics(labelled_predictions(spark, sf))


def q_classification_report(spark, sf):
    r = M.classification_report(labelled_predictions(spark, sf))
    return r.select("class_name", *[_r(c).alias(c) for c in ("precision", "recall", "f1")], "support")


def q_thresholds(spark, sf):
    raw = M.classification_metrics(labelled_predictions(spark, sf), digits=None)
    return M.threshold_checks(raw).withColumn("value", _r("value"))


# ---------------------------------------------------------------- dossiers
def q_dossier_evidence(spark, sf):
    return D.evidence_rows(dossiers(spark, sf))


def q_dossier_evidence_cli(spark, sf):
    return D.evidence_rows(dossiers(spark, sf, "cli"))


def q_dossier_evidence_app(spark, sf):
    return D.evidence_rows(dossiers(spark, sf, "app"))


def q_dossier_text(spark, sf):
    d = dossiers(spark, sf).select("dossier.*")
    return d.select("ticket_id", "assigned_priority", "inferred_severity", "mismatch_type",
                    "severity_delta", "constraint_analysis", "confidence",
                    F.size("feature_evidence").alias("n_evidence"))


def q_dossier_text_cli(spark, sf):
    d = dossiers(spark, sf, "cli").select("dossier.*")
    return d.select("ticket_id", "mismatch_type", "severity_delta", "constraint_analysis",
                    F.size("feature_evidence").alias("n_evidence"))


def q_dossier_text_app(spark, sf):
    d = dossiers(spark, sf, "app").select("dossier.*")
    return d.select("ticket_id", "mismatch_type", "constraint_analysis", "confidence",
                    F.size("feature_evidence").alias("n_evidence"))


def q_dossier_validation(spark, sf):
    """Validate every dossier after seeding one ungrounded keyword item per dossier:
    the ticket's channel name, which the ticket text does not contain."""
    d = dossiers(spark, sf)
    seeded = F.struct(F.lit("keyword").alias("signal"),
                      F.col("dossier.feature_evidence")[F.size("dossier.feature_evidence") - 1]["value"]
                      .alias("value"), F.lit("high").alias("weight"),
                      F.lit(None).cast("string").alias("interpretation"))
    d = d.withColumn("dossier", F.col("dossier").withField(
        "feature_evidence", F.concat(F.col("dossier.feature_evidence"), F.array(seeded))))
    v = D.validate_dossiers(d)  # dossiers carry their ticket text: no join needed
    return v.select("ticket_id", F.size("violations").alias("n_violations"),
                    F.array_join("violations", " ; ").alias("violations"), "valid")


def q_dossier_violations(spark, sf):
    """Stored dossier texts of every kind, by ticket id modulo 6: as built, a null field, an absent
    key, a delta written as a float, an ungrounded keyword, no object at all."""
    j = dossiers(spark, sf).select("ticket_id", F.to_json("dossier", {"ignoreNullFields": "false"}).alias("j"), "full_text", "subject")
    kind = F.pmod(F.col("ticket_id").cast("bigint"), F.lit(6))
    text = (F.when(kind == 1, F.regexp_replace("j", '"confidence":[0-9.]+', '"confidence":null'))
            .when(kind == 2, F.regexp_replace("j", ',"confidence":[0-9.]+', ""))
            .when(kind == 3, F.regexp_replace("j", '"severity_delta":(-?[0-9]+)', '"severity_delta":$1.0'))
            .when(kind == 4, F.replace("j", F.lit('"feature_evidence":['), F.lit('"feature_evidence":[{"signal":"keyword","value":"zeppelin","weight":"high"},')))
            .when(kind == 5, F.lit("no dossier")).otherwise(F.col("j")))
    p = D.parse_responses(j.withColumn("dossier_json", text), "dossier_json").withColumnRenamed("parsed", "dossier")
    v = D.validate_dossiers(p)
    return v.select("ticket_id", F.array_join("violations", " ; ").alias("violations"), "valid",
                    F.col("dossier.severity_delta").alias("severity_delta"), F.col("dossier.confidence").alias("confidence"))


def q_dossier_grounding(spark, sf):
    """Dossiers against ticket texts: ids that leave 2 by 9 have a second text, those that leave 5
    by 14 none, and every third dossier cites a word of other tickets."""
    a = audited(spark, sf)
    k = F.col("ticket_id").cast("bigint")
    texts = a.where(k % 14 != 5).select("ticket_id", "full_text", "subject")
    texts = texts.union(texts.where(k % 9 == 2).withColumn("full_text", F.concat(F.lit("Reopened: "), "full_text")))
    cited = F.struct(F.lit("keyword").alias("signal"), F.lit("open the archive").alias("value"), F.lit("high").alias("weight"),
                     F.lit(None).cast("string").alias("interpretation"))
    d = D.build_dossiers(a, "notebook", rule_confidence("notebook"))
    d = d.withColumn("dossier", F.col("dossier").withField("feature_evidence", F.when(
        k % 3 == 0, F.concat("dossier.feature_evidence", F.array(cited))).otherwise(F.col("dossier.feature_evidence"))))
    g = D.ground_dossiers(d, texts)
    return g.select("ticket_id", "n_texts", F.array_join("messages", " ; ").alias("messages"))


def q_dossier_first_n(spark, sf, n: int = 50):
    f = flagged(spark, sf)
    return (f.orderBy("order_key").limit(n)
            .select("ticket_id", "order_key", "mismatch_type", "severity_delta"))


def q_dossiers_pending(spark, sf):
    """Flagged tickets without a stored dossier. Two runs have stored theirs before, those of the
    orders that 3 and 5 divide, some of them twice."""
    from prioscope.session import materialize, scratch_path
    from prioscope.sources.dossiers import DossierStore
    made = materialize(dossiers(spark, sf).select("ticket_id", "dossier"), "dossiers")  # one audit
    store = DossierStore(spark, scratch_path(spark, "dossier-store"))
    for n in (3, 5):
        store.append(made.where(F.col("ticket_id").cast("bigint") % n == 0))
    return store.pending(made).select("ticket_id", F.col("dossier.mismatch_type").alias("mismatch_type"))


def q_prompt_text(spark, sf):
    return D.with_prompt(flagged(spark, sf))


def q_parsed_response(spark, sf):
    """Model-style replies wrapped around each dossier's JSON (fences + prose); every
    fourth reply is cut short and must parse to null."""
    j = D.dossier_json(dossiers(spark, sf))
    body = F.when(F.pmod(F.col("ticket_id").cast("bigint"), F.lit(4)) == 0,
                  F.substring(F.col("dossier_json"), 1, 40)).otherwise(F.col("dossier_json"))
    reply = F.concat(F.lit("Here is the dossier:\n```json\n"), body, F.lit("\n```\nDone."))
    p = D.parse_responses(j.select("ticket_id", reply.alias("response")))
    return p.select("ticket_id", F.col("parsed.mismatch_type").alias("mismatch_type"),
                    F.col("parsed.severity_delta").alias("severity_delta"),
                    F.size("parsed.feature_evidence").alias("n_evidence"))


def q_challenge_scoreboard(spark, sf):
    """Keyword-only baseline vs rule model vs fused truth per ticket, then totals.

    All three systems score the same rows, so they are computed side by side in one
    pass (the baseline lexicon's columns under a prefix) instead of joining three
    prediction tables on ticket_id."""
    a = audited(spark, sf)
    a = with_text_signal(a, BASELINE, prefix="base_")
    per_ticket = a.select("ticket_id", F.col("mismatch_label").alias("true_label"),
                          signal_mismatch("base_nlp_severity").alias("keyword_pred"),
                          signal_mismatch("nlp_severity").alias("model_pred"))
    return scoreboard(per_ticket)


def _prediction_tables(spark, sf):
    """Truth, keyword baseline and rule model as tables of their own, with gaps and repeats."""
    a = with_text_signal(audited(spark, sf), BASELINE, prefix="base_")
    k = F.col("ticket_id").cast("bigint")
    one = F.array(F.lit(0))
    truth = a.where(k % 17 != 4).select("ticket_id", F.col("mismatch_label").alias("true_label"))
    keyword = (a.where(k % 11 != 5).withColumn("copy", F.explode(F.when(k % 7 == 3, F.array(F.lit(0), F.lit(1))).otherwise(one)))
               .select("ticket_id", F.abs(signal_mismatch("base_nlp_severity") - F.col("copy")).cast("int").alias("prediction")))
    model = (a.where(k % 19 != 6).withColumn("copy", F.explode(F.when(k % 13 == 2, F.array(F.lit(0), F.lit(0))).otherwise(one)))
             .select("ticket_id", signal_mismatch("nlp_severity").alias("prediction")))
    return truth, keyword, model


def q_challenge_matches(spark, sf):
    return match_predictions(*_prediction_tables(spark, sf))


def q_challenge_report(spark, sf):
    """Per ticket: truth, both systems' answers and whether they are right."""
    a = with_text_signal(audited(spark, sf), BASELINE, prefix="base_")
    keyword, model, label = signal_mismatch("base_nlp_severity"), signal_mismatch("nlp_severity"), F.col("mismatch_label")
    return a.select("ticket_id", label.alias("true_label"), F.col("mismatch_type").alias("true_mismatch_type"), keyword.alias("keyword_pred"),
                    model.alias("model_pred"), (keyword == label).alias("keyword_correct"), (model == label).alias("model_correct"))


def q_challenge_bonus(spark, sf):
    return bonus(scoreboard(q_challenge_report(spark, sf)))


# ---------------------------------------------------------------- model / streaming
def _classifier(spark, sf):
    """Labelled tickets with their split, and the model chosen on them."""
    from prioscope.operators import newton
    from prioscope.session import materialize
    a = audited(spark, sf).select("ticket_id", "mismatch_label", "channel", "ticket_type", "resolution_hours", *newton.COUNTS)
    data = materialize(stratified_split(a), "classifier-input")
    return data, newton.train(data)


def q_classifier_predictions(spark, sf):
    from prioscope.operators import newton
    data, model = _classifier(spark, sf)
    scored = newton.score(model, data.where("split = 'test'"))
    return scored.select("ticket_id", "mismatch_label", "prediction", F.round("confidence", 4).alias("confidence"), "candidate", "epoch")


def q_classifier_versions(spark, sf):
    """Epochs of all candidates with their validation score, and which one was chosen."""
    from prioscope.operators import newton
    _, model = _classifier(spark, sf)
    return newton.versions(spark, model).select("candidate", "epoch", "ridge", _r("macro_f1").alias("macro_f1"), "chosen")


def q_classifier_thresholds(spark, sf):
    """Test metrics of the chosen model, unrounded, against the acceptance thresholds."""
    from prioscope.operators import newton
    data, model = _classifier(spark, sf)
    scored = newton.score(model, data.where("split = 'test'"))
    raw = M.classification_metrics(scored, "mismatch_label", "prediction", digits=None)
    return M.threshold_checks(raw).withColumn("value", _r("value"))


def _stream_source(spark, sf):
    ev_schema = table(spark, sf, "events").schema
    ev = spark.readStream.schema(ev_schema).parquet(f"{sf.rstrip('/')}/events*.parquet")
    return tickets_from(table(spark, sf, "orders"), ev, how="inner")


def q_stream_scored(spark, sf):
    from prioscope.streaming.stream import freeze_baseline, run_to_table, score_stream
    base = freeze_baseline(spark, tickets(spark, sf))
    s = score_stream(_stream_source(spark, sf), base)
    out = s.select("ticket_id", "nlp_severity", "rt_severity", "inferred_severity",
                   "mismatch_label", "mismatch_type")
    return run_to_table(spark, out, "stream-scored")


#: Arrivals are replayed in slices of so many days.
SLICE_DAYS = 10


def arrival_slices(spark, sf) -> DataFrame:
    """``events`` with the slice in which a row arrives: by its day, one slice later for ids that
    leave 5 by 37; ids that leave 3 by 11 come twice, those that leave 7 by 23 again one later."""
    ev = table(spark, sf, "events")
    ev = ev.withColumn("ts", F.col("ts").cast("timestamp"))
    first = F.broadcast(ev.agg(F.to_date(F.min("ts")).alias("first")))  # one row
    late = (F.col("event_id") % 37 == 5).cast("int")
    own = (F.datediff(F.to_date("ts"), "first") / SLICE_DAYS).cast("int") + late
    copies = F.array_compact(F.array(own, F.when(F.col("event_id") % 11 == 3, own), F.when(F.col("event_id") % 23 == 7, own + 1)))
    return ev.crossJoin(first).select(*ev.columns, F.explode(copies).alias("slice"))


def _replay(spark, sf, queries: dict) -> dict[str, str]:
    """Drain the streaming ``queries`` (name -> (stream of raw tickets -> stream, partition column))
    after each slice has arrived, then after the end marker; returns their tables."""
    from prioscope.session import materialize, scratch_path
    from prioscope.streaming.stream import drain, end_marker, read_arrivals, timed
    slices = materialize(arrival_slices(spark, sf), "slices")
    edge = slices.agg(F.max("slice").alias("n"), F.max("ts").alias("last")).first()
    schema, inbox = slices.drop("slice").schema, scratch_path(spark, "arrivals")
    orders = table(spark, sf, "orders")
    outs = {}
    for number in range(edge["n"] + 2):
        part = slices.where(F.col("slice") == number).drop("slice") if number <= edge["n"] else end_marker(slices.drop("slice"), edge["last"])
        part.write.mode("append").parquet(inbox)
        for name, (build, column) in queries.items():
            outs.setdefault(name, scratch_path(spark, name))
            drain(build(tickets_from(orders, timed(read_arrivals(spark, inbox, schema)), how="inner")), outs[name], partition_by=column)
    return outs


def q_stream_arrivals(spark, sf):
    """How each row of the replayed arrivals came: on time, repeated or late."""
    from prioscope.streaming.stream import split_arrivals
    out = _replay(spark, sf, {"arrivals-split": (lambda s: split_arrivals(s.select("ticket_id", "ts")), "arrival")})
    rows = spark.read.parquet(out["arrivals-split"])
    return rows.groupBy("ticket_id", "arrival").agg(F.count(F.lit(1)).alias("copies"))


def q_stream_daily_counts(spark, sf):
    """Tickets per day and type: de-duplicated and counted by the stream, late ones added."""
    from prioscope.streaming.stream import (daily_counts, daily_totals, freeze_baseline, late_tickets,
                                            score_stream, split_arrivals)
    base = freeze_baseline(spark, tickets(spark, sf))
    out = _replay(spark, sf, {
        "daily-windows": (lambda s: daily_counts(score_stream(s, base)), None),
        "daily-arrivals": (split_arrivals, "arrival")})
    rows = spark.read.parquet(out["daily-arrivals"])
    late = late_tickets(rows.where("arrival = 'on_time'").drop("arrival"), rows.where("arrival = 'late'").drop("arrival"))
    return daily_totals(spark.read.parquet(out["daily-windows"]), audit(clean(late, impute=False), baseline=base))


QUERIES = {
    "clean_tickets": q_clean_tickets,
    "priority_wide": q_priority_wide,
    "ticket_ids": q_ticket_ids,
    "hours_coerced": q_hours_coerced,
    "blank_rejects": q_blank_rejects,
    "text_signal_core": _text_signal(CORE),
    "text_signal_full": _text_signal(FULL),
    "text_signal_app": _text_signal(APP),
    "text_signal_baseline": _text_signal(BASELINE),
    "document_keyword_hits": q_document_keyword_hits,
    "hours_baseline": q_hours_baseline,
    "time_signal": q_time_signal,
    "audited_tickets": q_audited_tickets,
    "rule_predictions": q_rule_predictions,
    "rule_predictions_app": q_rule_predictions_app,
    "model_input": q_model_input,
    "ablation": q_ablation,
    "signal_agreement": q_signal_agreement,
    "value_counts_priority": q_value_counts_priority,
    "value_counts_type": q_value_counts_type,
    "null_counts": q_null_counts,
    "mismatch_rate_by_priority": q_mismatch_rate_by_priority,
    "mismatch_summary": q_mismatch_summary,
    "delta_histogram": q_delta_histogram,
    "hours_histogram": q_hours_histogram,
    "hours_describe": q_hours_describe,
    "kpis": q_kpis,
    "priority_crosstab": q_priority_crosstab,
    "top_keywords": q_top_keywords,
    "class_weights": q_class_weights,
    "imbalance": q_imbalance,
    "stratified_split": q_stratified_split,
    "split_rates": q_split_rates,
    "confusion": q_confusion,
    "classification_metrics": q_classification_metrics,
    "classification_report": q_classification_report,
    "thresholds": q_thresholds,
    "dossier_evidence": q_dossier_evidence,
    "dossier_text": q_dossier_text,
    "dossier_text_cli": q_dossier_text_cli,
    "dossier_text_app": q_dossier_text_app,
    "dossier_validation": q_dossier_validation,
    "dossier_first_n": q_dossier_first_n,
    "dossiers_pending": q_dossiers_pending,
    "prompt_text": q_prompt_text,
    "parsed_response": q_parsed_response,
    "dossier_evidence_cli": q_dossier_evidence_cli,
    "dossier_evidence_app": q_dossier_evidence_app,
    "dossier_grounding": q_dossier_grounding,
    "dossier_violations": q_dossier_violations,
    "challenge_matches": q_challenge_matches,
    "challenge_report": q_challenge_report,
    "challenge_bonus": q_challenge_bonus,
    "challenge_scoreboard": q_challenge_scoreboard,
    "classifier_predictions": q_classifier_predictions,
    "classifier_versions": q_classifier_versions,
    "classifier_thresholds": q_classifier_thresholds,
    "stream_scored": q_stream_scored,
    "stream_arrivals": q_stream_arrivals,
    "stream_daily_counts": q_stream_daily_counts,
}
