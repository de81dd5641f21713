"""Classifier: trains on the weighted split, scores, saves/loads; no model -> rules."""

import os

from prioscope.operators import model as ML
from prioscope.operators.audit import model_predictions
from prioscope.operators.dataset import stratified_split, with_model_input
from prioscope.operators.metrics import classification_metrics
from prioscope.plans.queries import audited
from conftest import SF001


def test_train_score_save_load(spark, tmpdir_fresh):
    a = with_model_input(audited(spark, SF001))
    data = stratified_split(a).cache()
    m = ML.train(data.where("split = 'train'"), data.where("split = 'val'"), reg_params=(0.0, 0.01))
    scored = ML.score(m, data.where("split = 'test'"))
    n_test = data.where("split = 'test'").count()
    assert scored.count() == n_test
    assert scored.where("confidence < 0.5 or confidence > 1").count() == 0
    mt = classification_metrics(scored, "mismatch_label", "prediction").first()
    assert 0.0 <= mt.accuracy <= 1.0
    preds = model_predictions(scored)
    assert set(preds.columns) >= {"ticket_id", "mismatch_label", "mismatch_type", "confidence"}
    path = os.path.join(tmpdir_fresh, "model")
    ML.save(m, path)
    again = ML.score(ML.load(path), data.where("split = 'test'"))
    assert again.select("ticket_id", "prediction").exceptAll(scored.select("ticket_id", "prediction")).count() == 0
    data.unpersist()


def test_missing_model_selects_rule_mode(tmpdir_fresh, spark):
    assert ML.load(os.path.join(tmpdir_fresh, "nope")) is None
