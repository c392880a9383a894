"""Weak labels, the rule classifier and the two adjustments of a score."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import phrases as P
from ..functions import mail as M
from ..functions import matching
from ..functions import probability as pr
from ..schema import CRITICAL, HIGH, LOW, NORMAL

# Names of scorers whose "normal" the rules may raise.
TRAINED = ("logistic_regression", "random_forest", "xgboost")


def _in_folder(folder: Column, *marks: str) -> Column:
    low = F.lower(folder)
    return matching.contains_any(low, marks)


def weak_label(df: DataFrame, book: P.PhraseBook = P.DEFAULT, whole_word: bool = False) -> DataFrame:
    """Add ``priority`` (0..3): the first rule that applies decides."""
    sender = F.lower(M.text("sender"))
    folder = M.text("folder")
    text = F.col("_label_text")
    critical = (
        matching.contains_any(text, book.critical)
        | _in_folder(folder, "urgent", "critical")
        | M.is_csuite(sender, book.csuite, whole_word)
    )
    low = (
        matching.contains_any(text, book.low)
        | _in_folder(folder, "spam", "junk", "newsletter", "notification")
        | F.startswith(sender, F.lit("no-reply"))
        | F.startswith(sender, F.lit("noreply"))
    )
    priority = (
        F.when(critical, F.lit(CRITICAL))
        .when(matching.contains_any(text, book.high), F.lit(HIGH))
        .when(low, F.lit(LOW))
        .otherwise(F.lit(NORMAL))
    )
    labelled = df.withColumn("_label_text", M.label_text(M.text("subject"), M.text("body")))
    return matching.computed_once(labelled, {"priority": priority}).drop("_label_text")


def _with_class(df: DataFrame, shares: str, name: str) -> DataFrame:
    vector = F.col(shares)
    return matching.computed_once(df, {shares: vector, name: pr.argmax(vector)})


def rule_scores(df: DataFrame, text: Column, book: P.PhraseBook = P.DEFAULT) -> DataFrame:
    """Score a text with the rules.

    Adds ``critical_score``, ``high_score``, ``normal_score``, ``low_score``,
    ``is_far`` (far-horizon wording without near-term urgency), ``rule_proba``
    and ``rule_class``.
    """
    every = book.critical + book.high + book.low + book.distant + book.near
    t, hits = F.col("_rule_text"), F.col("_rule_hits")
    far = matching.any_among(hits, book.distant) & ~matching.any_among(hits, book.near)
    damp = F.when(F.col("is_far"), F.lit(0.15)).otherwise(F.lit(1.0))

    def bonus(test: Column, value: float) -> Column:
        return F.when(test, F.lit(value)).otherwise(F.lit(0.0))

    forwarded = F.startswith(t, F.lit("fw:")) | F.startswith(t, F.lit("fwd:"))
    critical = F.lit(2.0) * matching.count_among(hits, book.critical) + bonus(
        M.occurrences(t, "!") > 2, 1.0
    )
    high = (
        matching.count_among(hits, book.high).cast("double")
        + bonus(F.contains(t, F.lit("?")), 0.5)
        + bonus(F.startswith(t, F.lit("re:")), 0.3)
    )
    low = matching.count_among(hits, book.low).cast("double") + bonus(forwarded, 1.0)
    scores = F.array("critical_score", "high_score", "normal_score", "low_score")
    scored = (
        df.withColumn("_rule_text", F.lower(text))
        .withColumn("_rule_hits", matching.found(t, every))
        .withColumn("is_far", far)
        .withColumns(
            {
                "critical_score": critical * damp,
                "high_score": high * damp,
                "normal_score": F.when(F.col("is_far"), F.lit(2.8)).otherwise(F.lit(0.6)),
                "low_score": low,
            }
        )
        .withColumn("rule_proba", pr.normalise(scores))
        .drop("_rule_text", "_rule_hits")
    )
    return _with_class(scored, "rule_proba", "rule_class")


def rule_classify(df: DataFrame, book: P.PhraseBook = P.DEFAULT) -> DataFrame:
    """Add ``rule_class`` and ``rule_proba`` from text, sender and folder."""
    scored = rule_scores(
        df, M.rule_text(M.text("subject"), M.text("body"), M.text("sender")), book
    ).drop("critical_score", "high_score", "normal_score", "low_score", "is_far")
    raised = pr.normalise(
        F.transform(
            F.col("rule_proba"), lambda v, i: v + F.when(i == HIGH, 0.3).otherwise(0.0)
        )
    )
    lift = M.is_csuite(F.col("sender"), book.csuite) & (F.col("rule_class") > HIGH)
    junk = _in_folder(M.text("folder"), "spam", "junk") if "folder" in df.columns else F.lit(False)
    final = F.when(junk, pr.shares(pr.JUNK)).when(lift, raised).otherwise(F.col("rule_proba"))
    return _with_class(scored.withColumn("rule_proba", final), "rule_proba", "rule_class")


def bump_urgency(df: DataFrame, model_used: str) -> DataFrame:
    """Let confident rules raise a trained model's "normal".

    Reads and replaces ``prediction`` and ``probability``; needs ``rule_class``
    and ``rule_proba``. The raised class is the rules' class, whatever the blend
    of the two distributions favours.
    """
    if model_used not in TRAINED:
        return df
    rule_share = F.get(F.col("rule_proba"), F.col("rule_class"))
    raise_it = (
        (F.col("prediction") == NORMAL)
        & F.col("rule_class").isin(CRITICAL, HIGH)
        & (rule_share >= 0.45)
    )
    mixed = pr.blend(F.col("probability"), 0.55, F.col("rule_proba"), 0.45)
    return matching.computed_once(
        df.withColumn("_raise", raise_it),
        {
            "prediction": F.when(F.col("_raise"), F.col("rule_class")).otherwise(
                F.col("prediction")
            ),
            "probability": F.when(F.col("_raise"), mixed).otherwise(F.col("probability")),
        },
    ).drop("_raise")


def downgrade_far_horizon(df: DataFrame, book: P.PhraseBook = P.DEFAULT) -> DataFrame:
    """Move far-future planning mail from critical or high towards normal."""
    text = M.signal_text(M.text("subject"), M.text("body"), M.HORIZON_CHARS)
    planning = (
        F.col("prediction").isin(CRITICAL, HIGH)
        & matching.contains_any(text, book.distant)
        & ~matching.contains_any(text, book.near)
    )
    mixed = pr.blend(F.col("probability"), 0.38, pr.shares(pr.PLANNING), 0.62)
    moved = F.when(F.col("_planning"), mixed).otherwise(F.col("probability"))
    own = F.when(F.col("_planning"), pr.argmax(F.col("_moved"))).otherwise(F.col("prediction"))
    return matching.computed_once(
        df.withColumn("_planning", planning).withColumn("_moved", moved),
        {"prediction": own, "probability": F.col("_moved")},
    ).drop("_planning", "_moved")


class RulePriorityClassifier(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """The rule classifier as a pipeline stage.

    Reads mail columns, or plain text when ``textCol`` is set, and adds
    ``prediction`` and ``probability``. With neither at hand (for example a bare
    feature vector) every row gets the stand-in distribution.
    """

    textCol = Param(Params._dummy(), "textCol", "column with plain text", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, textCol: str | None = None):
        super().__init__()
        if textCol is not None:
            self._set(textCol=textCol)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        have = set(dataset.columns)
        if self.isSet(self.textCol):
            scored = rule_scores(dataset, M.text(self.getOrDefault(self.textCol))).drop(
                "critical_score", "high_score", "normal_score", "low_score", "is_far"
            )
        elif {"subject", "body"} <= have:
            needed = {c: F.lit("") for c in ("sender", "folder") if c not in have}
            scored = rule_classify(dataset.withColumns(needed) if needed else dataset).drop(*needed)
        else:
            return dataset.withColumns(
                {"prediction": F.lit(NORMAL), "probability": pr.shares(pr.UNREADABLE)}
            )
        return scored.withColumnsRenamed({"rule_class": "prediction", "rule_proba": "probability"})
