"""Features as one pipeline, the three classifiers, evaluation and cross-validation.

The same fitted :class:`~pyspark.ml.PipelineModel` serves training and scoring, so
their columns cannot drift apart.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import parts
from ..schema import FOLDS, MAX_TERMS, SEED
from ..session import materialise
from . import features as ft
from . import logistic, metrics, sampling, trees
from .blocks import packed
from .smote import smote as oversample
from .smote import synthetic
from .tfidf import MailTfidf, MailTfidfModel, with_terms

LABEL = "priority"


class MailColumns(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the feature columns of a layout and the ``terms`` of each mail."""

    layout = Param(Params._dummy(), "layout", "full, narrow or compact", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, layout: str = "narrow"):
        super().__init__()
        self._set(layout=layout)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        compact = self.getOrDefault(self.layout) == "compact"
        columns = ft.compact_features(dataset) if compact else ft.mail_features(dataset)
        if "embedding" in dataset.columns:
            columns = columns.withColumn(
                "embedding_vector", array_to_vector(F.col("embedding").cast("array<double>"))
            )
        return with_terms(columns, compact)


LAYOUTS = {"full": ft.FULL, "narrow": ft.NARROW, "compact": ft.COMPACT}


class FeaturePipeline(Pipeline):
    """Mail columns, TF-IDF and their vector; only the terms have to be fitted, so no other column is computed for it."""

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        columns, weights, vector = self.getStages()
        docs = with_terms(dataset, columns.getOrDefault(columns.layout) == "compact")
        return PipelineModel(stages=[columns, weights.fit(docs), vector])


def feature_pipeline(
    layout: str = "narrow", max_terms: int = MAX_TERMS, embeddings: bool = False
) -> Pipeline:
    """Hand-made columns, then TF-IDF, then embeddings, as one sparse vector."""
    inputs = [*LAYOUTS[layout], "tfidf", *(["embedding_vector"] if embeddings else [])]
    return FeaturePipeline(
        stages=[
            MailColumns(layout=layout),
            MailTfidf(maxTerms=max_terms),
            VectorAssembler(inputCols=inputs, outputCol="features"),
        ]
    )


class Recipe:
    """How a classifier is fitted; ``fit_all`` fits several at once from blocks of rows."""

    #: Whether rows are weighed so that every class of a fit counts the same.
    balanced = False

    def fit_all(self, rows: DataFrame, blocks: DataFrame, size: int, fits: int, classes: int, weights: np.ndarray) -> list[Model]:
        raise NotImplementedError


@dataclass(frozen=True)
class Logistic(Recipe):
    c: float = 1.0
    max_iter: int = 1000

    def fit_all(self, rows, blocks, size, fits, classes, weights):
        found = logistic.fit_all(blocks, size, fits, classes, self.c, self.max_iter)
        return [logistic.as_model(rows.sparkSession, x) for x in found]


@dataclass(frozen=True)
class RandomForest(Recipe):
    how: trees.Forest = trees.Forest()
    balanced = True

    def fit_all(self, rows, blocks, size, fits, classes, weights):
        grown, importance = trees.plant(blocks, trees.find_bins(rows, size), fits, classes, weights, self.how)
        return [trees.TreesModel.of(own, False, size, classes, share) for own, share in zip(grown, importance)]


@dataclass(frozen=True)
class BoostedTrees(Recipe):
    how: trees.Boosting = trees.Boosting()

    def fit_all(self, rows, blocks, size, fits, classes, weights):
        grown = trees.boost(blocks, trees.find_bins(rows, size), fits, classes, self.how)
        return [trees.TreesModel.of(own, True, size, classes) for own in grown]


def logistic_regression(c: float = 1.0, max_iter: int = 1000) -> Recipe:
    """Multinomial, L2; ``c`` weighs the summed loss of all rows."""
    return Logistic(c, max_iter)


def random_forest(trees_: int = 200, depth: int = 30, least_split: int = 5, least_leaf: int = 2) -> Recipe:
    """Class-balanced forest."""
    return RandomForest(trees.Forest(trees_, depth, least_split, least_leaf))


def boosted_trees(rounds: int = 300, depth: int = 6, rate: float = 0.1, rows: float = 0.8, columns: float = 0.8) -> Recipe:
    """Softmax boosting: a tree for each class in each round."""
    return BoostedTrees(trees.Boosting(rounds, depth, rate, rows, columns))


def predict(model, df: DataFrame) -> DataFrame:
    """Add ``prediction`` (int) and ``probability`` (``array<double>``)."""
    keep = [*df.columns, "features"] if "features" not in df.columns else df.columns
    out = model.transform(df)
    out = out.withColumn("probability", vector_to_array("probability")).withColumn(
        "prediction", F.col("prediction").cast("int")
    )
    return out.select(*keep, "prediction", "probability")


def feature_table(mail: DataFrame, model: PipelineModel, key: str = "id") -> DataFrame:
    """``(key, label, features)`` written out once, because fitting reads it many times."""
    return materialise(model.transform(mail).select(key, LABEL, "features"))


def _fitted(recipe: Recipe, rows: DataFrame, fits: int, key: str) -> list[Model]:
    """All fits of ``rows`` (key, label, features, ``weights`` with one for each fit)."""
    inside = [F.sum((F.col("weights")[f] > 0).cast("long")).alias(f"n{f}") for f in range(fits)]
    counts = {r[LABEL]: r for r in rows.groupBy(LABEL).agg(*inside, F.max(parts("features")["size"]).alias("size")).collect()}
    classes, size = max(counts) + 1, max(r["size"] for r in counts.values())
    sizes = np.array([[counts[c][f"n{f}"] if c in counts else 0 for c in range(classes)] for f in range(fits)], float)
    weights = np.ones(sizes.shape)
    if recipe.balanced:
        total, present = sizes.sum(axis=1, keepdims=True), (sizes > 0).sum(axis=1, keepdims=True)
        weights = np.divide(total, present * sizes, out=np.zeros_like(sizes), where=sizes > 0)
    blocks = packed(rows, key, LABEL, "weights")
    return recipe.fit_all(rows, blocks, size, fits, classes, weights)


def fit(recipe: Recipe, rows: DataFrame, smote: bool = False, key: str = "id") -> Model:
    """Fit on ``(key, label, features)`` rows, optionally after oversampling."""
    if smote:
        rows = oversample(rows, LABEL, key=key)
    return _fitted(recipe, materialise(rows.select(key, LABEL, "features").withColumn("weights", F.array(F.lit(1.0)))), 1, key)[0]


def evaluate(model, rows: DataFrame) -> DataFrame:
    """``(accuracy, macro_f1)`` on labelled rows."""
    counts = metrics.confusion_counts(predict(model, rows), LABEL, "prediction")
    return metrics.accuracy_macro_f1(counts)


def _fold_weights(k: int) -> list[Column]:
    """A row is part of all folds' fits but its own's."""
    return [(F.col("fold") != f).cast("double") for f in range(k)]


def _fold_scores(models: list[Model], folded: DataFrame) -> DataFrame:
    """``(fold, accuracy, macro_f1)``; each fold is predicted by the model of the others."""
    predicted = [
        predict(model, folded.filter(F.col("fold") == f)).select("fold", F.col(LABEL).alias("y_true"), F.col("prediction").alias("y_pred"))
        for f, model in enumerate(models)
    ]
    return metrics.accuracy_macro_f1(metrics.confusion_counts(reduce(DataFrame.unionByName, predicted), by=["fold"]), ["fold"])


def cross_validate(recipe: Recipe, rows: DataFrame, k: int = FOLDS, key: str = "id") -> DataFrame:
    """``(fold, accuracy, macro_f1)``; each fold is predicted by a model of the others.

    Runs on the original rows, without oversampling. All folds share every pass.
    """
    folded = materialise(sampling.stratified_folds(rows.select(key, LABEL, "features"), LABEL, key, k).withColumn("weights", F.array(*_fold_weights(k))))
    return _fold_scores(_fitted(recipe, folded, k, key), folded)


def train_and_measure(
    name: str, recipe: Recipe, rows: DataFrame, smote: bool = False, folds: int = FOLDS, key: str = "id",
) -> tuple[Model, DataFrame]:
    """``(model, summary)``: fit on the training part, test on the rest, cross-validate.

    The fit and those of all folds share every pass over the rows; ``train_time_s`` is the time
    of all of them. The summary row has the columns the model selection reads, and ``confusion``:
    (true class, predicted class, rows) of the test part as JSON text.
    """
    split = sampling.stratified_split(rows.select(key, LABEL, "features"), LABEL, key)
    folded = materialise(sampling.stratified_folds(split, LABEL, key, folds) if folds else split.withColumn("fold", F.lit(0)))
    started = time.time()
    weights = F.array((~F.col("is_test")).cast("double"), *_fold_weights(folds))
    given = folded.select(F.col(key).cast("string").alias(key), LABEL, "features", weights.alias("weights"))
    if smote:
        train = folded.filter("NOT is_test").select(key, LABEL, "features")
        only_first = F.array(F.lit(1.0), *[F.lit(0.0)] * folds)
        given = given.unionByName(synthetic(train, LABEL, key=key).withColumn("weights", only_first))
    models = _fitted(recipe, materialise(given), 1 + folds, key)
    seconds = round(time.time() - started, 2)
    tested = predict(models[0], folded.filter("is_test")).select(F.col(LABEL).alias("y_true"), F.col("prediction").alias("y_pred"))
    cells = metrics.confusion_counts(tested)
    matrix = cells.agg(F.to_json(F.sort_array(F.collect_list(F.array("y_true", "y_pred", "n")))).alias("confusion"))  # sixteen cells
    summary = metrics.accuracy_macro_f1(cells).crossJoin(matrix).withColumns({"model": F.lit(name), "train_time_s": F.lit(seconds)})
    if folds:
        summary = summary.crossJoin(metrics.cross_validation_summary(_fold_scores(models[1:], folded), by=()))  # one row each
    return models[0], summary


def training_totals(rows: DataFrame, width: int, key: str = "id", folds: int = FOLDS) -> DataFrame:
    """One row: samples, training and test rows, feature width, seed, folds."""
    split = sampling.stratified_split(rows, LABEL, key)
    return split.agg(
        F.count("*").alias("n_samples"),
        F.count(F.when(~F.col("is_test"), 1)).alias("n_train"),
        F.count(F.when(F.col("is_test"), 1)).alias("n_test"),
    ).withColumns(
        {"n_features": F.lit(width), "random_state": F.lit(SEED), "cv_folds": F.lit(folds)}
    )


def scorer(features: PipelineModel, classifier) -> PipelineModel:
    """Features and classifier as one model that scores raw mail."""
    return PipelineModel(stages=[*features.stages, classifier])


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def vector_names(features: PipelineModel, size: int = 0) -> list[str]:
    """Names of the vector's positions: layout columns, vocabulary terms, embedding dimensions.

    ``size`` is the length of the vector, needed only when it ends in an embedding.
    """
    columns = next(s for s in features.stages if isinstance(s, MailColumns))
    terms = [t for s in features.stages if isinstance(s, MailTfidfModel) for t in s.getOrDefault(s.terms)]
    names = [*LAYOUTS[columns.getOrDefault(columns.layout)], *terms]
    return names + [f"embedding_{i}" for i in range(size - len(names))]
