"""Which features speak for a prediction: linear terms and tree importances."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.matching import computed_once, constant
from ..functions.vectors import parts
from . import training
from .sampling import sample_cap

ROW_TOP, GLOBAL_TOP = 10, 20


def _linear_part(model: PipelineModel):
    return next(s for s in reversed(model.stages) if hasattr(s, "coefficientMatrix"))


def _coefficients(classifier) -> list[list[float]]:
    return classifier.coefficientMatrix.toArray().tolist()


def row_attribution(scored: DataFrame, model: PipelineModel, k: int = ROW_TOP) -> DataFrame:
    """Add ``signals``: the k largest ``|value * coefficient|`` of the predicted class.

    The terms are ranked inside the row; the coefficients are a constant of
    classes x features.
    """
    linear = _linear_part(model)
    weights = constant(_coefficients(linear), "array<double>")
    names = constant(training.vector_names(model, linear.numFeatures))
    # The model's own class, before rules or horizon may have moved the prediction.
    own = F.col("model_class") if "model_class" in scored.columns else F.col("prediction")
    ranked = F.sort_array(
        F.zip_with(
            F.col("_p.indices"), F.col("_p.values"),
            lambda i, v: F.struct(
                (-F.abs(v * F.get(F.get(weights, F.col("_class")), i))).alias("rank"),
                i.alias("idx"),
            ),
        )
    )
    signals = F.transform(
        F.slice(ranked, 1, k),
        lambda s: F.struct(F.get(names, s["idx"]).alias("name"), (-s["rank"]).alias("weight")),
    )
    looked_up = scored.withColumns({"_p": parts("features"), "_class": own})
    return computed_once(looked_up, {"signals": signals}).drop("_p", "_class")


def _cells(rows: DataFrame) -> DataFrame:
    return (
        rows.withColumn("_p", parts("features"))
        .select(F.explode(F.arrays_zip("_p.indices", "_p.values")).alias("e"))
        .select(F.col("e.indices").alias("idx"), F.col("e.values").alias("value"))
    )


def global_attribution(
    rows: DataFrame, classifier, names: list[str], key: str = "id", k: int = GLOBAL_TOP,
    sample_rows: int | None = None, background_rows: int | None = None,
) -> DataFrame:
    """``(name, weight)``: mean ``|coefficient * (value - background mean)|``, k largest.

    The means run over all rows, or over samples of the sizes asked for, and over classes. A feature that is 0 in a row still
    deviates from its background mean, which is added in closed form.
    """
    spark = rows.sparkSession
    matrix = classifier.coefficientMatrix.toArray()
    mean_size = abs(matrix).mean(axis=0).tolist()
    table = spark.createDataFrame(
        list(zip(range(len(names)), names, mean_size)), "idx int, name string, size double"
    )
    n = rows.count()
    background = rows if background_rows is None else sample_cap(rows, background_rows, key)
    sample = rows if sample_rows is None else sample_cap(rows, sample_rows, key, seed=7)
    n_background, n_sample = min(background_rows or n, n), min(sample_rows or n, n)
    # One row per feature from here on.
    means = _cells(background).groupBy("idx").agg(
        (F.sum("value") / F.lit(n_background)).alias("mean")
    )
    features = table.join(F.broadcast(means), "idx", "left").withColumn(
        "mean", F.coalesce("mean", F.lit(0.0))
    )
    present = (
        _cells(sample)
        .join(F.broadcast(features.select("idx", "mean")), "idx")
        .groupBy("idx")
        .agg(F.sum(F.abs(F.col("value") - F.col("mean"))).alias("off"), F.count("*").alias("n"))
    )
    off = F.coalesce("off", F.lit(0.0)) + (F.lit(n_sample) - F.coalesce("n", F.lit(0))) * F.abs(
        "mean"
    )
    return (
        features.join(F.broadcast(present), "idx", "left")
        .select("name", (F.col("size") * off / F.lit(n_sample)).alias("weight"))
        .orderBy(F.desc("weight"), "name")
        .limit(k)
    )


def feature_importance(
    spark, classifier, names: list[str], k: int = GLOBAL_TOP
) -> DataFrame:
    """``(name, importance)`` of a tree model, k largest."""
    values = classifier.featureImportances.toArray().tolist()
    rows = [(n, float(v)) for n, v in zip(names, values)]
    return (
        spark.createDataFrame(rows, "name string, importance double")
        .orderBy(F.desc("importance"), "name")
        .limit(k)
    )
