"""Text signal: one test per matching trap (substring, patterns, presets)."""

import pytest
from pyspark.sql import types as T

from prioscope.lexicon import APP, BASELINE, CORE, FULL
from prioscope.operators.signals import with_text_signal


def score(spark, text, lexicon=CORE):
    df = spark.createDataFrame([(text,)], T.StructType([T.StructField("full_text", T.StringType())]))
    return with_text_signal(df, lexicon).first()


def test_substring_not_word(spark):
    r = score(spark, "countdown")
    assert r.crit_kw_count == 1 and r.top_keywords == ["down"]


def test_known_word_inside_gap(spark):
    assert score(spark, "need to know").esc_phrase_count == 1


def test_sue_inside_issue_under_full(spark):
    r = score(spark, "an issue", FULL)
    assert r.esc_phrase_count == 1 and r.nlp_severity == 4
    assert score(spark, "an issue", CORE).nlp_severity == 2


def test_phrase_counts_in_two_lists(spark):
    r = score(spark, "not working")
    assert (r.crit_kw_count, r.negation_count) == (1, 1)


@pytest.mark.parametrize("text,esc", [("illegal route to action", 1), ("illegal course of action", 0)])
def test_gap_limit(spark, text, esc):
    assert score(spark, text).esc_phrase_count == esc


@pytest.mark.parametrize("text,esc", [("need\nit now", 0), ("need\rit now", 1)])
def test_dot_excludes_only_newline(spark, text, esc):
    assert score(spark, text).esc_phrase_count == esc


def test_app_only_keyword(spark):
    assert score(spark, "security incident", APP).crit_kw_count == 1
    assert score(spark, "security incident", CORE).crit_kw_count == 0


def test_baseline_lacks_entries(spark):
    core, base = score(spark, "legal action, doesn't", CORE), score(spark, "legal action, doesn't", BASELINE)
    assert (core.esc_phrase_count, core.negation_count) == (1, 1)
    assert (base.esc_phrase_count, base.negation_count) == (0, 0)


@pytest.mark.parametrize("text,sev", [("typo", 1), ("typo wishlist", 2)])
def test_low_words_half_weight(spark, text, sev):
    r = score(spark, text, FULL)
    assert r.nlp_severity == sev and r.nlp_score == (0.5 if sev == 1 else 1.0)


def test_upper_case(spark):
    assert score(spark, "URGENT").crit_kw_count == 1


@pytest.mark.parametrize("text", ["", None])
def test_empty_and_null(spark, text):
    r = score(spark, text)
    assert (r.crit_kw_count, r.high_kw_count, r.esc_phrase_count, r.negation_count) == (0, 0, 0, 0)
    assert r.nlp_severity == 1 and r.top_keywords == []


def test_top_keywords_order_and_cap(spark):
    r = score(spark, "data loss after outage, system crash, hacked")
    assert r.top_keywords == ["outage", "system crash", "data loss"]


def test_app_top_keywords_mix(spark):
    r = score(spark, "outage with an error and a bug", APP)
    assert r.top_keywords == ["outage", "error", "bug"]


def test_severity_thresholds(spark):
    assert score(spark, "slow").nlp_severity == 2            # 2
    assert score(spark, "slow and wrong").nlp_severity == 3  # 4
    assert score(spark, "slow wrong bug").nlp_severity == 4  # 6
    assert score(spark, "down").nlp_severity == 3            # crit 4


def test_prefix_scores_side_by_side(spark):
    df = spark.createDataFrame([("legal action now",)], "full_text string")
    out = with_text_signal(with_text_signal(df, CORE), BASELINE, prefix="b_").first()
    assert out.esc_phrase_count == 1 and out.b_esc_phrase_count == 0


def test_multiline_long_text_whole(spark):
    text = ("lorem ipsum " * 5000) + "\nthe service is down"
    assert score(spark, text).crit_kw_count == 1
