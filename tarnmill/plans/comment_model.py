"""From labelled comments to a comment classifier and its report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnmill.functions.text import CLASSIFIER_DELETED, clean_comment
from tarnmill.operators import classify
from tarnmill.operators.textmodel import TextModel
from tarnmill.sources import records


def clean_corpus(comments: DataFrame, deleted: str = CLASSIFIER_DELETED) -> DataFrame:
    """``text`` cleaned for word vectors; one set of deleted characters serves the
    vectors and the classifier unless another is given."""
    return comments.select(clean_comment(F.col("text"), deleted).alias("text"))


def search_classifier(
    folds: DataFrame,
    num_folds: int,
    folder: str,
    grid: Mapping[str, Sequence[float]] = classify.GRID,
    vectors=None,
) -> TextModel:
    """Grid search over the folds; writes the results as CSV and the best model."""
    results = classify.grid_search(folds, num_folds, grid, vectors)
    records.write_csv(results, f"{folder}/grid")
    model = classify.fit_best(folds, results, vectors)
    model.save(folds.sparkSession, f"{folder}/model")
    return model


def evaluate_classifier(model: TextModel, labelled: DataFrame, folder: str) -> DataFrame:
    """Confusion metrics and AUC of cleaned ``label, text`` rows; writes the predictions."""
    truth = labelled.withColumnRenamed("label", "truth")
    scored = classify.predict(model, truth, clean=False).select(
        "text", F.col("truth").alias("label"), F.col("label").alias("predicted_label"), "prob"
    )
    records.write_csv(classify.prediction_table(scored), f"{folder}/predictions")
    auc = classify.roc_auc(scored).scalar()
    return classify.confusion_metrics(scored).withColumn("auc", auc)
