"""Comment classifier: training, prediction, selection and its metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnmill.functions.text import clean_comment
from tarnmill.operators import skipgram, textmodel
from tarnmill.operators.prefix import running_total
from tarnmill.operators.textmodel import TextModel

# Labels, the label of an empty comment, and the digits a probability
# is rounded to in a report.
POSITIVE = "positive"
NEGATIVE = "negative"
NO_LABEL = "NA"
REPORT_DIGITS = 4

DEFAULTS = {"word_ngrams": 2, "buckets": 1 << 13, "dim": 10, "lr": 3.0, "epochs": 25}
GRID = {"word_ngrams": [1, 2, 3], "buckets": [1 << 12], "dim": [10, 20], "lr": [1.0, 3.0, 10.0], "epochs": [10, 25]}


def word_vectors(cleaned: DataFrame, dim: int = 100, text: str = "text", partitions: int | None = None, min_count: int = 5) -> DataFrame:
    """``word, vector``: unsupervised word vectors (skip-gram) of cleaned comments, trained in parallel."""
    return skipgram.word_vectors(cleaned, dim, text, partitions, min_count)


def fit_classifier(labelled: DataFrame, params: Mapping[str, float] = DEFAULTS, vectors: DataFrame | None = None) -> TextModel:
    """Fit on ``label, text`` with text already cleaned, from zero knowledge or from
    pre-trained ``vectors`` (word, vector) of the model's dimension."""
    params = {**DEFAULTS, **params}
    rows = labelled.select("label", "text", F.array(F.lit(0)).alias("train"), F.array().cast("array<int>").alias("valid"))
    blocks = textmodel.new_blocks([params], [0], vectors)
    return TextModel(textmodel.fit(textmodel.prepared(rows, [params], POSITIVE), blocks, int(params["epochs"]))[0])


def predict(model: TextModel, comments: DataFrame, clean: bool = True) -> DataFrame:
    """Add ``label`` and ``prob`` to rows with ``text``; an empty comment gets ``NA`` and 0."""
    source = comments.withColumn("__raw", F.col("text"))
    if clean:
        source = source.withColumn("text", clean_comment(F.col("text")))
    scored = model.chance(source, "__p")
    label, prob = _decision(F.col("__p"))
    empty = F.col("__raw") == ""
    return scored.select(
        *[F.col("__raw").alias("text") if c == "text" else F.col(c) for c in comments.columns],
        F.when(empty, NO_LABEL).otherwise(label).alias("label"),
        F.when(empty, 0.0).otherwise(prob).alias("prob"),
    )


def _decision(chance: Column) -> tuple[Column, Column]:
    """The likelier label and its probability."""
    positive = chance >= 0.5
    return F.when(positive, POSITIVE).otherwise(NEGATIVE), F.when(positive, chance).otherwise(1 - chance)


def gather_predictions(scored: DataFrame, key: str = "file_id") -> DataFrame:
    """Predictions of each file in block order. A group is one file, whose whole text
    was one row before, so it stays as small as that row."""
    ordered = F.array_sort(F.collect_list(F.struct("block_no", "label", "prob")))
    grouped = scored.groupBy(key).agg(ordered.alias("p"))
    return grouped.select(
        key, F.transform("p", lambda p: F.struct(p["label"].alias("label"), p["prob"].alias("prob"))).alias("predictions")
    )


def is_suitable_file(predictions: Column, threshold: float) -> Column:
    """Whether any comment is positive with the threshold, on probabilities as reported."""
    return F.exists(
        predictions, lambda p: (p["label"] == POSITIVE) & (F.round(p["prob"], REPORT_DIGITS) >= threshold)
    )


def suitable_comments(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.where((F.col("label") == POSITIVE) & (F.col("prob") >= threshold))


def suitable_files(files: DataFrame, scored: DataFrame, threshold: float, key: str = "file_id") -> DataFrame:
    """Files with a suitable comment, straight from the comment rows: the keys are made
    distinct before the join, so a file with many comments is one row."""
    rounded = scored.withColumn("prob", F.round("prob", REPORT_DIGITS))
    return files.join(suitable_comments(rounded, threshold).select(key).distinct(), key, "left_semi")


def fold_accuracy(predictions: DataFrame) -> DataFrame:
    """Share of right labels per fold: ``fold, accuracy``."""
    right = F.avg((F.col("label") == F.col("predicted_label")).cast("double"))
    return predictions.groupBy("fold").agg(right.alias("accuracy"))


def mean_accuracy(predictions: DataFrame) -> DataFrame:
    """Mean over the folds of the accuracy per fold, one row."""
    return fold_accuracy(predictions).agg(F.avg("accuracy").alias("avg_accuracy"))


def predict_folds(folds: DataFrame, params: Mapping[str, float], num_folds: int, vectors: DataFrame | None = None) -> DataFrame:
    """Predictions for the validation part of each fold from a model fitted on its
    training part: ``fold, label, predicted_label, prob``. All folds are fitted together.
    ``folds`` has ``fold, part``, or one row a text with its folds (``textmodel.placed``)."""
    params = {**DEFAULTS, **params}
    rows = textmodel.prepared(textmodel.placed(folds, num_folds), [params], POSITIVE, ["label"])
    blocks = textmodel.new_blocks([params], range(num_folds), vectors)
    scored = textmodel.predicted(rows, textmodel.fit(rows, blocks, int(params["epochs"])))
    label, prob = _decision(F.col("chance"))
    return scored.select("fold", "label", label.alias("predicted_label"), prob.alias("prob"))


def grid_search(folds: DataFrame, num_folds: int, grid: Mapping[str, Sequence[float]] = GRID, vectors: DataFrame | None = None) -> DataFrame:
    """Mean validation accuracy of every parameter setting: ``setting``, the parameters
    and ``avg_accuracy``.

    ``folds`` as for ``predict_folds``. All settings and folds are fitted together: one pass over the stored features for each
    epoch of the longest setting, and one over the validation rows for each number of epochs.
    """
    names = sorted(grid)
    settings = [{**DEFAULTS, **dict(zip(names, values))} for values in product(*[grid[name] for name in names])]
    rows = textmodel.prepared(textmodel.placed(folds, num_folds), settings, POSITIVE)
    blocks, done, found = textmodel.new_blocks(settings, range(num_folds), vectors), 0, {}
    for epochs in sorted({int(s["epochs"]) for s in settings}):
        blocks = textmodel.fit(rows, blocks, epochs - done)
        found[epochs], done = textmodel.validated(rows, blocks), epochs
    results = []
    for number, s in enumerate(settings):
        run = ((int(s["word_ngrams"]), int(s["buckets"])), float(s["lr"]), int(s["dim"]))
        own = [found[int(s["epochs"])][fold, *run] for fold in range(num_folds)]
        results.append((number, *[float(s[name]) for name in names], sum(own) / len(own)))
    schema = ", ".join(["setting int", *[f"{name} double" for name in names], "avg_accuracy double"])
    return folds.sparkSession.createDataFrame(results, schema)


def best_setting(results: DataFrame) -> DataFrame:
    """The first setting with the highest accuracy, one row."""
    return results.orderBy(F.desc("avg_accuracy"), "setting").limit(1)


def fit_best(folds: DataFrame, results: DataFrame, vectors: DataFrame | None = None) -> TextModel:
    """The best setting fitted on all labelled rows of one fold (train and validation)."""
    params = {k: v for k, v in best_setting(results).first().asDict().items() if k not in ("setting", "avg_accuracy")}
    first = F.col("fold") == 0 if "fold" in folds.columns else F.array_contains("train", 0) | F.array_contains("valid", 0)
    return fit_classifier(folds.where(first), params, vectors)


def confusion_metrics(predictions: DataFrame) -> DataFrame:
    """Counts, accuracy, precision, recall and F1 of the positive class, one row; a
    ratio without cases is NULL."""
    truth = F.col("label") == POSITIVE
    right = F.col("label") == F.col("predicted_label")
    counts = predictions.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(truth & right).alias("true_positive"),
        F.count_if(~truth & right).alias("true_negative"),
        F.count_if(~truth & ~right).alias("false_positive"),
        F.count_if(truth & ~right).alias("false_negative"),
    )
    tp = F.col("true_positive").cast("double")
    ratios = counts.withColumns(
        {
            "accuracy": F.try_divide(tp + F.col("true_negative"), F.col("total")),
            "precision": F.try_divide(tp, F.col("true_positive") + F.col("false_positive")),
            "recall": F.try_divide(tp, F.col("true_positive") + F.col("false_negative")),
        }
    )
    f1 = F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return ratios.withColumn("f1", f1)


def roc_points(predictions: DataFrame) -> DataFrame:
    """``score, positives, negatives, tp_before, fp_before`` per distinct score.

    The score is the probability of the positive class. Counts per score are summed
    first; the running totals then go through score buckets, highest score first.
    """
    score = F.when(F.col("predicted_label") == POSITIVE, F.col("prob")).otherwise(1 - F.col("prob"))
    counts = predictions.groupBy(score.alias("score")).agg(
        F.count_if(F.col("label") == POSITIVE).alias("positives"),
        F.count_if(F.col("label") != POSITIVE).alias("negatives"),
    )
    falling = counts.withColumn("falling", -F.col("score"))
    totals = {"tp_before": F.col("positives"), "fp_before": F.col("negatives")}
    return running_total(falling, ["falling"], totals).drop("falling")


def roc_curve(predictions: DataFrame) -> DataFrame:
    """``score, fpr, tpr`` at every distinct score."""
    points = roc_points(predictions)
    totals = predictions.agg(
        F.count_if(F.col("label") == POSITIVE).alias("p"), F.count_if(F.col("label") != POSITIVE).alias("n")
    )
    p, n = totals.select("p").scalar(), totals.select("n").scalar()
    return points.select(
        "score",
        F.try_divide(F.col("fp_before") + F.col("negatives"), n).alias("fpr"),
        F.try_divide(F.col("tp_before") + F.col("positives"), p).alias("tpr"),
    )


def roc_auc(predictions: DataFrame) -> DataFrame:
    """Area under the curve by trapezoids, one row: each score adds its negatives times
    the mean of the true positives before and after it."""
    area = F.sum(F.col("negatives") * (2 * F.col("tp_before") + F.col("positives"))).cast("double")
    totals = roc_points(predictions).agg(area.alias("area"), F.sum("positives").alias("p"), F.sum("negatives").alias("n"))
    return totals.select(F.try_divide(F.col("area"), 2.0 * F.col("p") * F.col("n")).alias("auc"))


def prediction_table(predictions: DataFrame) -> DataFrame:
    """``entry, label, predicted_label, correct, probability`` as written to a report."""
    return predictions.select(
        F.col("text").alias("entry"),
        "label",
        "predicted_label",
        (F.col("label") == F.col("predicted_label")).alias("correct"),
        F.format_string(f"%.{REPORT_DIGITS}f", "prob").alias("probability"),
    )
