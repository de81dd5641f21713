"""Mismatch classifier on Spark ML.

Text + metadata features -> class-weighted logistic regression. Training is Spark
ML's distributed tree-aggregate per iteration; scoring is ``PipelineModel.transform``,
a per-row projection. A missing model selects the rule-only path
(``audit.rule_predictions``).
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import (IDF, HashingTF, OneHotEncoder, RegexTokenizer, StringIndexer,
                                VectorAssembler)
from pyspark.ml.functions import vector_to_array
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prioscope.operators.dataset import class_weights
from prioscope.operators.metrics import classification_metrics


def build_pipeline(reg_param: float = 0.0, max_iter: int = 30, num_features: int = 1 << 14,
                   text_col: str = "model_input", label: str = "mismatch_label",
                   weight_col: str = "class_weight") -> Pipeline:
    stages = [
        RegexTokenizer(inputCol=text_col, outputCol="__tokens", pattern=r"\W+", toLowercase=True),
        HashingTF(inputCol="__tokens", outputCol="__tf", numFeatures=num_features),
        IDF(inputCol="__tf", outputCol="__tfidf"),
        StringIndexer(inputCols=["channel", "ticket_type"], outputCols=["__ch_i", "__tt_i"],
                      handleInvalid="keep"),
        OneHotEncoder(inputCols=["__ch_i", "__tt_i"], outputCols=["__ch_v", "__tt_v"],
                      handleInvalid="keep"),
        VectorAssembler(inputCols=["__tfidf", "__ch_v", "__tt_v", "resolution_hours"],
                        outputCol="features", handleInvalid="keep"),
        LogisticRegression(featuresCol="features", labelCol=label, weightCol=weight_col,
                           regParam=reg_param, maxIter=max_iter, family="binomial"),
    ]
    return Pipeline(stages=stages)


def with_class_weight(df: DataFrame, label: str = "mismatch_label",
                      out: str = "class_weight") -> DataFrame:
    """Attach the balanced weight of each row's class (2-row table, broadcast)."""
    w = class_weights(df, label).select(label, F.col("weight").alias(out))
    return df.join(F.broadcast(w), label, "left")


def train(train_df: DataFrame, val_df: DataFrame | None = None, reg_params=(0.0, 0.01),
          label: str = "mismatch_label", **kw) -> PipelineModel:
    """Fit one model per regParam; keep the best validation macro F1 (first on ties).

    The weighted training table is persisted (memory, spilling to disk) for the
    duration of the fits: every stage's fit and every optimiser iteration reads it,
    and recomputing the upstream audit for each would multiply the work. A lost
    executor's blocks are recomputed from lineage.
    """
    cols = [label, "model_input", "channel", "ticket_type", "resolution_hours"]
    weighted = with_class_weight(train_df.select(*cols), label).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        best, best_f1 = None, -1.0
        for rp in reg_params:
            model = build_pipeline(reg_param=rp, label=label, **kw).fit(weighted)
            if val_df is None:
                return model
            f1 = classification_metrics(model.transform(val_df), label, "prediction", digits=None) \
                .first()["macro_f1"]
            if f1 > best_f1:
                best, best_f1 = model, f1
        return best
    finally:
        weighted.unpersist()


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Append ``prediction`` (int) and ``confidence`` (probability of the predicted class)."""
    out = model.transform(df)
    probs = vector_to_array(F.col("probability"))
    keep = [c for c in df.columns] + ["prediction", "confidence"]
    return out.withColumn("prediction", F.col("prediction").cast("int")) \
              .withColumn("confidence", F.array_max(probs)).select(*keep)


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel | None:
    """Load a saved model; ``None`` (rule-only mode) when it cannot be read."""
    try:
        return PipelineModel.load(path)
    except Exception:  # noqa: BLE001 - any load failure selects the rule path
        return None
