"""Comment classification, selection and classifier metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import standins as s
from tarnmill.functions.text import clean_comment
from tarnmill.operators import classify
from tarnmill.session import stored
from tarnmill.sources import records

QUERIES, ORACLES, query = s.registry()


@query(
    "suitable_files",
    f"WITH {s.SCORED} SELECT DISTINCT file_id FROM scored WHERE label = 'positive' AND round(prob, 4) >= CAST(0.9 AS DOUBLE)",
)
def suitable_files(spark, sf):
    files = s.files(spark, sf).select("file_id")
    return classify.suitable_files(files, s.scored_comments(spark, sf), 0.9)


@query(
    "suitable_by_predictions",
    f"WITH {s.SCORED} SELECT file_id, bool_or(label = 'positive' AND round(prob, 4) >= CAST(0.9 AS DOUBLE)) AS suitable FROM scored GROUP BY file_id",
)
def suitable_by_predictions(spark, sf):
    gathered = classify.gather_predictions(s.scored_comments(spark, sf))
    return gathered.select("file_id", classify.is_suitable_file(F.col("predictions"), 0.9).alias("suitable"))


@query(
    "suitable_comments",
    f"WITH {s.SCORED} SELECT file_id, block_no, prob FROM scored WHERE label = 'positive' AND prob >= CAST(0.7 AS DOUBLE)",
)
def suitable_comments(spark, sf):
    return classify.suitable_comments(s.scored_comments(spark, sf), 0.7).select("file_id", "block_no", "prob")


@query(
    "gathered_predictions",
    f"WITH {s.SCORED} SELECT file_id, string_agg(label || ':' || CAST(CAST(round(prob * 10007) AS BIGINT) AS VARCHAR), ' ' ORDER BY block_no) AS predictions FROM scored GROUP BY file_id",
)
def gathered_predictions(spark, sf):
    gathered = classify.gather_predictions(s.scored_comments(spark, sf))
    shown = F.transform("predictions", lambda p: F.concat(p["label"], F.lit(":"), F.round(p["prob"] * 10007).cast("bigint").cast("string")))
    return gathered.select("file_id", F.array_join(shown, " ").alias("predictions"))


@query(
    "fold_accuracy",
    f"""WITH {s.PREDICTIONS} SELECT fold, round(avg(CASE WHEN label = predicted_label THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS accuracy
    FROM predictions GROUP BY fold""",
)
def fold_accuracy(spark, sf):
    return classify.fold_accuracy(s.predictions(spark, sf)).select("fold", F.round("accuracy", 6).alias("accuracy"))


@query(
    "mean_accuracy",
    f"""WITH {s.PREDICTIONS}, folds AS (
      SELECT fold, avg(CASE WHEN label = predicted_label THEN CAST(1 AS DOUBLE) ELSE 0 END) AS a FROM predictions GROUP BY fold)
    SELECT round(avg(a), 6) AS avg_accuracy FROM folds""",
)
def mean_accuracy(spark, sf):
    return classify.mean_accuracy(s.predictions(spark, sf)).select(F.round("avg_accuracy", 6).alias("avg_accuracy"))


@query(
    "confusion_metrics",
    f"""WITH {s.PREDICTIONS}, c AS (
      SELECT count(*) AS total, count_if(label = 'positive' AND predicted_label = 'positive') AS true_positive,
             count_if(label = 'negative' AND predicted_label = 'negative') AS true_negative,
             count_if(label = 'negative' AND predicted_label = 'positive') AS false_positive,
             count_if(label = 'positive' AND predicted_label = 'negative') AS false_negative FROM predictions),
    r AS (SELECT *, CAST(true_positive + true_negative AS DOUBLE) / nullif(total, 0) AS a,
             CAST(true_positive AS DOUBLE) / nullif(true_positive + false_positive, 0) AS p,
             CAST(true_positive AS DOUBLE) / nullif(true_positive + false_negative, 0) AS q FROM c)
    SELECT CAST(total AS BIGINT) AS total, CAST(true_positive AS BIGINT) AS true_positive, CAST(true_negative AS BIGINT) AS true_negative,
           CAST(false_positive AS BIGINT) AS false_positive, CAST(false_negative AS BIGINT) AS false_negative,
           round(a, 6) AS accuracy, round(p, 6) AS precision, round(q, 6) AS recall, round(2 * p * q / nullif(p + q, 0), 6) AS f1 FROM r""",
)
def confusion_metrics(spark, sf):
    metrics = classify.confusion_metrics(s.predictions(spark, sf))
    ratios = ["accuracy", "precision", "recall", "f1"]
    return metrics.withColumns({name: F.round(name, 6) for name in ratios})


_ROC = f"""WITH {s.PREDICTIONS}, scored AS (
  SELECT CASE WHEN predicted_label = 'positive' THEN prob ELSE CAST(1 AS DOUBLE) - prob END AS score, label FROM predictions),
counts AS (SELECT score, count_if(label = 'positive') AS p, count_if(label <> 'positive') AS n FROM scored GROUP BY score),
points AS (SELECT score, p, n, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS all_p, sum(n) OVER () AS all_n
  FROM counts WINDOW w AS (ORDER BY score DESC))"""


@query("roc_curve", f"{_ROC} SELECT round(score, 6) AS score, round(CAST(fp AS DOUBLE) / all_n, 6) AS fpr, round(CAST(tp AS DOUBLE) / all_p, 6) AS tpr FROM points")
def roc_curve(spark, sf):
    return classify.roc_curve(s.predictions(spark, sf)).select(*[F.round(c, 6).alias(c) for c in ("score", "fpr", "tpr")])


@query("roc_auc", f"{_ROC} SELECT round(CAST(sum(n * (2 * tp - p)) AS DOUBLE) / (CAST(2 AS DOUBLE) * any_value(all_p) * any_value(all_n)), 6) AS auc FROM points")
def roc_auc(spark, sf):
    return classify.roc_auc(s.predictions(spark, sf)).select(F.round("auc", 6).alias("auc"))


@query(
    "prediction_report",
    f"""WITH {s.PREDICTIONS} SELECT file_id, md5(text) AS entry, label, predicted_label, label = predicted_label AS correct,
    printf('%.4f', prob) AS probability FROM predictions""",
)
def prediction_report(spark, sf):
    rows = s.predictions(spark, sf).withColumn("text", F.concat_ws("|", F.col("file_id").cast("string"), F.md5("text")))
    report = classify.prediction_table(rows)
    parts = F.split("entry", r"\|")
    return report.select(
        parts[0].cast("bigint").alias("file_id"), parts[1].alias("entry"), "label", "predicted_label", "correct", "probability"
    )


# ---------------------------------------------------------------- learners (no SQL)

def _labelled(spark, sf):
    """Cleaned labelled documents, each with those of three folds that train on it and those that hold it out."""
    rows = s.predictions(spark, sf).select("file_id", "label", clean_comment(F.col("text")).alias("text"))
    folds = F.array(*[F.lit(i) for i in range(3)])
    valid = F.filter(folds, lambda fold: (F.col("file_id") + fold) % 5 == 0)
    return stored(rows.withColumns({"train": F.array_except(folds, valid), "valid": valid}))


@query("word_vectors")
def word_vectors(spark, sf):
    cleaned = s.files(spark, sf).select(clean_comment(F.col("text")).alias("text"))
    vectors = records.vector_table(classify.word_vectors(cleaned, 100))
    return vectors.select("word", F.size("vector").alias("dim"))


@query("fold_predictions")
def fold_predictions(spark, sf):
    return classify.predict_folds(_labelled(spark, sf), classify.DEFAULTS, 3)


@query(
    "fold_label_counts",
    f"""WITH {s.PREDICTIONS}, thirds AS (SELECT unnest([0, 1, 2]) AS k)
    SELECT CAST(k AS INTEGER) AS fold, label, count(*) AS n FROM predictions, thirds WHERE (file_id + k) % 5 = 0 GROUP BY k, label""",
)
def fold_label_counts(spark, sf):
    scored = classify.predict_folds(_labelled(spark, sf), {**classify.DEFAULTS, "epochs": 1}, 3)
    return scored.where("prob >= 0.5").groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n"))


@query("grid_results")
def grid_results(spark, sf):
    return classify.grid_search(_labelled(spark, sf), 3)


@query("predicted_comments")
def predicted_comments(spark, sf):
    model = classify.fit_classifier(_labelled(spark, sf).where("array_contains(train, 0)"), classify.DEFAULTS)
    comments = s.files(spark, sf).select("file_id", F.posexplode("lines").alias("block_no", "text"))
    return classify.predict(model, comments).select("file_id", "block_no", "label", "prob")
