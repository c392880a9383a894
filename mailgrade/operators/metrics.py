"""Classification metrics.

All class metrics follow from the 4 x 4 confusion counts, so the predictions are
read once and aggregated to 16 rows per group; the rest works on those.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import mail as M
from ..schema import LABELS
from ..session import stored

CLASSES = len(LABELS)


def _share(part: Column, whole: Column) -> Column:
    """part / whole, 0 when there is nothing to divide by."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def _class_ids() -> Column:
    return F.sequence(F.lit(0), F.lit(CLASSES - 1))


def confusion_counts(
    df: DataFrame, truth: str = "y_true", pred: str = "y_pred", by: Sequence[str] = ()
) -> DataFrame:
    """``(*by, y_true, y_pred, n)`` with all 16 cells per group, zeros included."""
    by = list(by)
    cells = df.groupBy(*by, F.col(truth).alias("y_true"), F.col(pred).alias("y_pred")).agg(
        F.count("*").alias("n")
    )
    filled = F.flatten(
        F.transform(
            _class_ids(),
            lambda t: F.transform(
                _class_ids(),
                lambda p: F.struct(
                    t.alias("y_true"), p.alias("y_pred"),
                    F.coalesce(
                        F.get(F.filter("_cells", lambda c: (c["y_true"] == t) & (c["y_pred"] == p)),
                              F.lit(0))["n"],
                        F.lit(0),
                    ).alias("n"),
                ),
            ),
        )
    )
    # One group holds at most 16 cells here.
    return (
        cells.groupBy(*by)
        .agg(F.collect_list(F.struct("y_true", "y_pred", "n")).alias("_cells"))
        .select(*by, F.inline(filled))
    )


def confusion_matrix(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per true class, one column per predicted class."""
    cells = [
        F.sum(F.when(F.col("y_pred") == i, F.col("n")).otherwise(0)).alias(f"pred_{name}")
        for i, name in enumerate(LABELS)
    ]
    return counts.groupBy(*by, "y_true").agg(*cells)


MEASURES = ("precision", "recall", "f1")


def _class_totals(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per group and class: hits, support, predicted and the measures."""
    sides = F.array(
        F.struct(F.col("y_true").alias("class_id"), F.lit(True).alias("as_true")),
        F.struct(F.col("y_pred").alias("class_id"), F.lit(False).alias("as_true")),
    )
    hit = F.col("y_true") == F.col("y_pred")
    return (
        counts.select(*by, "n", hit.alias("hit"), F.inline(sides))
        .groupBy(*by, "class_id")
        .agg(
            F.sum(F.when(F.col("as_true") & F.col("hit"), F.col("n")).otherwise(0)).alias("hits"),
            F.sum(F.when(F.col("as_true"), F.col("n")).otherwise(0)).alias("support"),
            F.sum(F.when(~F.col("as_true"), F.col("n")).otherwise(0)).alias("predicted"),
        )
        .withColumns(
            {
                "precision": _share(F.col("hits"), F.col("predicted")),
                "recall": _share(F.col("hits"), F.col("support")),
                "f1": _share(F.lit(2) * F.col("hits"), F.col("support") + F.col("predicted")),
                "class": M.label_name(F.col("class_id")),
                "present": (F.col("support") > 0) | (F.col("predicted") > 0),
            }
        )
    )


def per_class(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, class_id, class, precision, recall, f1, support)``."""
    return _class_totals(counts, by).select(*by, "class_id", "class", *MEASURES, "support")


def accuracy_macro_f1(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, accuracy, macro_f1)``; macro over classes present in truth or prediction."""
    return (
        _class_totals(counts, by)
        .groupBy(*by)
        .agg(
            _share(F.sum("hits"), F.sum("support")).alias("accuracy"),
            F.avg(F.when(F.col("present"), F.col("f1"))).alias("macro_f1"),
        )
    )


def classification_report(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per-class rows plus ``accuracy``, ``macro avg`` and ``weighted avg``."""
    support = F.sum("support")
    macro = [F.avg(F.when(F.col("present"), F.col(m))).alias(f"_macro_{m}") for m in MEASURES]
    weighted = [
        _share(F.sum(F.col(m) * F.col("support")), support).alias(f"_weighted_{m}")
        for m in MEASURES
    ]

    def row(name: str, columns: Sequence[str]) -> Column:
        values = [F.col(c).alias(m) for c, m in zip(columns, MEASURES)]
        return F.struct(F.lit(name).alias("class"), *values, F.col("_support").alias("support"))

    extra = F.array(
        row("accuracy", ["_accuracy"] * 3),
        row("macro avg", [f"_macro_{m}" for m in MEASURES]),
        row("weighted avg", [f"_weighted_{m}" for m in MEASURES]),
    )
    # Four rows per group are gathered here.
    return (
        _class_totals(counts, by)
        .groupBy(*by)
        .agg(
            F.collect_list(F.struct("class", *MEASURES, "support")).alias("_rows"),
            support.alias("_support"), _share(F.sum("hits"), support).alias("_accuracy"),
            *macro, *weighted,
        )
        .select(*by, F.inline(F.concat("_rows", extra)))
    )


def metrics_long(report: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The report as ``(*by, class, metric, value)`` rows."""
    return report.withColumn("support", F.col("support").cast("double")).unpivot(
        [*by, "class"], [*MEASURES, "support"], "metric", "value"
    )


_SCORE_BUCKETS = 1024


def score_buckets(steps: DataFrame, buckets: int = _SCORE_BUCKETS) -> DataFrame:
    """Add ``_bucket``, which rises with the score and holds about as many rows everywhere."""
    shares = [i / buckets for i in range(1, buckets)]
    borders = steps.groupBy("class_id").agg(F.percentile_approx("score", shares, 10 * buckets).alias("_borders"))
    # The number of borders at or below the score, by halving.
    halves = F.array(*(F.lit(1 << k) for k in reversed(range(buckets.bit_length()))))
    place = F.aggregate(
        halves, F.lit(0),
        lambda at, step: F.when(F.get("_borders", at + step - 1) <= F.col("score"), at + step).otherwise(at),
    )
    # One row per class.
    return steps.join(F.broadcast(borders), "class_id").withColumn("_bucket", place).drop("_borders")


def roc_points(
    df: DataFrame, truth: str = "y_true", probability: str = "probability"
) -> DataFrame:
    """One-vs-rest ROC points ``(class_id, score, tp, fp, pos, neg, tp_step, fp_step)``.

    Equal scores are merged first, and the merged rows are written once. The
    running counts are then built in two levels, inside a score bucket and over
    the bucket totals, so that no window spans a whole class. Bucket borders are
    quantiles of a class' different scores: crowded scores get narrow buckets.
    """
    scored = df.select(
        F.posexplode(probability).alias("class_id", "score"), F.col(truth).alias("_truth")
    ).withColumn("_hit", (F.col("_truth") == F.col("class_id")).cast("long"))
    merged = stored(
        scored.groupBy("class_id", "score").agg(
            F.sum("_hit").alias("tp_step"), F.sum(F.lit(1) - F.col("_hit")).alias("fp_step")
        ),
        "roc-steps",
    )
    steps = score_buckets(merged)
    before = (
        Window.partitionBy("class_id").orderBy(F.desc("_bucket"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    whole = Window.partitionBy("class_id")
    # At most _SCORE_BUCKETS + 1 rows per class.
    totals = (
        steps.groupBy("class_id", "_bucket")
        .agg(F.sum("tp_step").alias("_tp"), F.sum("fp_step").alias("_fp"))
        .select(
            "class_id", "_bucket",
            F.coalesce(F.sum("_tp").over(before), F.lit(0)).alias("_tp_before"),
            F.coalesce(F.sum("_fp").over(before), F.lit(0)).alias("_fp_before"),
            F.sum("_tp").over(whole).alias("pos"), F.sum("_fp").over(whole).alias("neg"),
        )
    )
    inside = (
        Window.partitionBy("class_id", "_bucket").orderBy(F.desc("score"))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        steps.join(F.broadcast(totals), ["class_id", "_bucket"])
        .select(
            "class_id", "score", "tp_step", "fp_step", "pos", "neg",
            (F.col("_tp_before") + F.sum("tp_step").over(inside)).alias("tp"),
            (F.col("_fp_before") + F.sum("fp_step").over(inside)).alias("fp"),
        )
    )


def thinned(points: DataFrame, buckets: int = _SCORE_BUCKETS) -> DataFrame:
    """The points where a curve bends: between them it is straight, so its area stays.

    A point goes if the step to it and the step from it raise both counts alike. The first and
    the last point of a class stay. Neighbours are looked up inside a score bucket and, at a
    bucket's border, in the bucket before or after it, so that no window spans a whole class.
    """
    bucketed = score_buckets(points, buckets)
    inside = Window.partitionBy("class_id", "_bucket").orderBy(F.desc("score"))
    after = F.struct("tp_step", "fp_step")
    # A row for each bucket of a class.
    ends = bucketed.groupBy("class_id", "_bucket").agg(F.max_by(after, "score").alias("_first"))
    over = Window.partitionBy("class_id").orderBy(F.desc("_bucket"))
    ends = ends.select("class_id", "_bucket", F.lead("_first").over(over).alias("_next_bucket"), (F.row_number().over(over) == 1).alias("_leads"))
    known = bucketed.withColumns({"_next": F.lead(after).over(inside), "_place": F.row_number().over(inside)}).join(F.broadcast(ends), ["class_id", "_bucket"])
    following = F.coalesce("_next", "_next_bucket")
    straight = following.isNotNull() & (following["tp_step"] == F.col("tp_step")) & (following["fp_step"] == F.col("fp_step"))
    first = F.col("_leads") & (F.col("_place") == 1)
    return known.filter(~straight | first).select(*points.columns)


def roc_auc(points: DataFrame) -> DataFrame:
    """``(class_id, class, auc)`` by the trapezoid rule; null without both outcomes. For all points, not thinned ones."""
    area = F.sum(F.col("fp_step") * (F.col("tp") - F.col("tp_step") / F.lit(2.0)))
    return (
        points.groupBy("class_id")
        .agg(area.alias("_area"), F.max("pos").alias("_pos"), F.max("neg").alias("_neg"))
        .select(
            "class_id", M.label_name(F.col("class_id")).alias("class"),
            F.try_divide(F.col("_area"), (F.col("_pos") * F.col("_neg")).cast("double")).alias("auc"),
        )
    )


def distribution(df: DataFrame, label: str, *, digits: int | None = None) -> DataFrame:
    """``(label, n, percent)`` of all rows."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    percent = F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(1)))
    return counts.withColumn("percent", percent if digits is None else F.round(percent, digits))


def cross_validation_summary(fold_metrics: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Mean and population deviation over folds of ``accuracy`` and ``macro_f1``."""
    return fold_metrics.groupBy(*by).agg(
        F.avg("accuracy").alias("cv_accuracy_mean"),
        F.stddev_pop("accuracy").alias("cv_accuracy_std"),
        F.avg("macro_f1").alias("cv_f1_macro_mean"),
        F.stddev_pop("macro_f1").alias("cv_f1_macro_std"),
    )
