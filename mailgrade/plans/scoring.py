"""Score mail: model or rules, then bump, then far-horizon downgrade, then reasons."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import phrases as P
from ..functions import mail as M
from ..functions import probability as pr
from ..operators import explain, rules

RULES = "rule_based"


def _rule_path(df: DataFrame, book: P.PhraseBook) -> DataFrame:
    return rules.rule_classify(df, book).withColumnsRenamed(
        {"rule_class": "prediction", "rule_proba": "probability"}
    )


def score_probabilities(
    df: DataFrame, model: PipelineModel | None = None, model_used: str = RULES,
    book: P.PhraseBook = P.DEFAULT,
) -> DataFrame:
    """Add ``prediction`` and ``probability``.

    Without a model the rules decide. The path is chosen once for the whole
    table, on the driver, never per row.
    """
    if model is None:
        scored = _rule_path(df, book)
    else:
        from ..operators import training

        scored = training.predict(model, df).withColumn("model_class", F.col("prediction"))
        if model_used in rules.TRAINED:
            scored = rules.bump_urgency(rules.rule_classify(scored, book), model_used).drop(
                "rule_class", "rule_proba"
            )
    return rules.downgrade_far_horizon(scored, book)


def score(
    df: DataFrame, model: PipelineModel | None = None, model_used: str = RULES,
    book: P.PhraseBook = P.DEFAULT,
) -> DataFrame:
    """Mail with ``priority``, ``priority_index``, ``confidence``, ``confidence_scores``,
    ``shap_values`` and ``model_used``.

    The reasons are the rule signals on the rule path and the linear terms of the
    predicted class for a logistic regression; other models give none.
    """
    scored = score_probabilities(df, model, model_used, book)
    if model is None:
        reasoned = explain.rule_signals(scored, book)
    elif model_used == "logistic_regression":
        from ..operators import attribution

        reasoned = attribution.row_attribution(scored, model)
    else:
        reasoned = scored.withColumn(
            "signals", F.expr("CAST(array() AS ARRAY<STRUCT<name: STRING, weight: DOUBLE>>)")
        )
    return (
        reasoned.withColumns(
            {
                "priority": M.label_name(F.col("prediction")),
                "priority_index": F.col("prediction"),
                "confidence": F.get(F.col("probability"), F.col("prediction")),
                "confidence_scores": pr.score_map(F.col("probability")),
                "shap_values": explain.signal_map(F.col("signals")),
                "model_used": F.lit(model_used),
            }
        )
        .drop("signals", "prediction", "probability", "features", "model_class")
    )


def register_view(df: DataFrame, name: str = "scored_mail") -> DataFrame:
    """Make scored mail available to SQL under a name."""
    scored = score(df)
    scored.createOrReplaceTempView(name)
    return scored
