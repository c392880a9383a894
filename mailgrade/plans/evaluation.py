"""Compare several scorers on the same mail: held-out metrics and per-fold metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics, rules, sampling, selection
from ..schema import ACCURACY_THRESHOLD, MACRO_F1_THRESHOLD
from ..session import materialise

CANDIDATES = ("weak_label", "rule_based", "stand_in", "stand_in_adjusted")
WITHOUT_FOLDS = ("stand_in",)


def candidate_predictions(scored: DataFrame) -> DataFrame:
    """``(id, y_true, is_test, fold, model, y_pred)``.

    ``scored`` is mail with a model's ``prediction`` and ``probability``. The
    candidates are the weak label itself (a leak, which the guard must notice),
    the rules, the model, and the model after both adjustments. The texts are
    read once; the narrow result is written out before it is split and folded.
    """
    base = rules.rule_classify(rules.weak_label(scored)).withColumn("_plain", F.col("prediction"))
    adjusted = rules.downgrade_far_horizon(rules.bump_urgency(base, rules.TRAINED[0]))
    narrow = materialise(
        adjusted.select(
            "id", F.col("priority").alias("y_true"), F.col("priority").alias("weak_label"),
            F.col("rule_class").alias("rule_based"), F.col("_plain").alias("stand_in"),
            F.col("prediction").alias("stand_in_adjusted"),
        )
    )
    split = sampling.stratified_split(narrow, "y_true")
    folded = sampling.stratified_folds(split, "y_true")
    return folded.unpivot(
        ["id", "y_true", "is_test", "fold"], list(CANDIDATES), "model", "y_pred"
    )


def held_out_metrics(predictions: DataFrame) -> DataFrame:
    """``(model, accuracy, macro_f1)`` on the test part."""
    counts = metrics.confusion_counts(predictions.filter("is_test"), by=["model"])
    return metrics.accuracy_macro_f1(counts, ["model"])


def evaluation_document(metrics_rows: DataFrame, training: DataFrame, predictions: DataFrame) -> DataFrame:
    """What is stored about an evaluation, a row per model.

    Held-out numbers, fold means and training time, the counts of true against predicted classes
    (``matrix``, rows by true class) and their sum, the thresholds of the gate, the model's place,
    and for the chosen one whether the fallback is asked for (null for the others).
    """
    counts = metrics.confusion_counts(predictions.filter("is_test"), by=["model"])
    # Sixteen cells a model.
    cells = F.sort_array(F.collect_list(F.struct("y_true", "y_pred", "n")))
    rows = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda t: F.transform(F.filter("_cells", lambda c: c["y_true"] == t), lambda c: c["n"]))
    matrices = counts.groupBy("model").agg(cells.alias("_cells"), F.sum("n").alias("n_test")).select("model", rows.alias("matrix"), "n_test")
    chosen = selection.fallback_decision(metrics_rows, training).select(F.col("model").alias("_chosen"), "needs_fallback")
    return (
        selection.ranked(metrics_rows, training)
        .join(matrices, "model")
        .join(F.broadcast(chosen), F.col("model") == F.col("_chosen"), "left")
        .drop("_chosen")
        .withColumns({"accuracy_threshold": F.lit(ACCURACY_THRESHOLD), "macro_f1_threshold": F.lit(MACRO_F1_THRESHOLD)})
    )


def fold_summary(predictions: DataFrame) -> DataFrame:
    """``(model, cv_*)`` for the candidates that are cross-validated."""
    folded = predictions.filter(~F.col("model").isin(*WITHOUT_FOLDS))
    counts = metrics.confusion_counts(folded, by=["model", "fold"])
    return metrics.cross_validation_summary(metrics.accuracy_macro_f1(counts, ["model", "fold"]))
