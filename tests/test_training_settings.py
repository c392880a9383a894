"""The registered training queries train at the published settings."""

import pytest
from pyspark.ml.classification import GBTClassifier

from mailgrade.operators import training
from mailgrade.plans import catalog, lifecycle
from mailgrade.schema import FOLDS, MAX_TERMS


class Asked(Exception):
    """Carries what a query asked for; nothing is trained."""


@pytest.fixture
def asked(monkeypatch):
    def measure(name, make, rows, smote=False, folds=FOLDS, key="id"):
        raise Asked(name, make, smote, folds)

    monkeypatch.setattr(training, "train_and_measure", measure)
    monkeypatch.setattr(catalog, "_training_rows", lambda spark, sf_dir: (None, None))

    def run(query):
        with pytest.raises(Asked) as e:
            query(None, None)
        return e.value.args

    return run


def test_each_model_is_oversampled_cross_validated_and_whole(spark, asked):
    seen = {q: asked(catalog.QUERIES[q]) for q in ("train_lr", "train_rf", "train_gbt")}
    assert all(smote and folds == 5 for _, _, smote, folds in seen.values())
    lr, rf, gbt = (make(100) for _, make, _, _ in seen.values())
    assert lr.getMaxIter() == 1000
    assert (rf.getNumTrees(), rf.getMaxDepth()) == (200, 30)
    booster = gbt.getClassifier()
    assert isinstance(booster, GBTClassifier) and (booster.getMaxIter(), booster.getMaxDepth()) == (300, 6)


def test_training_rows_hold_all_terms(monkeypatch):
    def pipeline(layout="narrow", max_terms=MAX_TERMS, embeddings=False):
        raise Asked(max_terms)

    monkeypatch.setattr(catalog, "_labelled", lambda spark, sf_dir: None)
    monkeypatch.setattr(training, "feature_pipeline", pipeline)
    with pytest.raises(Asked) as e:
        catalog._training_rows(None, None)
    assert e.value.args == (5000,)


def test_the_lifecycle_trains_the_published_candidates(monkeypatch):
    def train_all(mail, folder, candidates=lifecycle.CANDIDATES, layout="narrow", max_terms=None, folds=FOLDS):
        raise Asked([name for name, _, _ in candidates], max_terms, folds)

    monkeypatch.setattr(catalog, "_labelled", lambda spark, sf_dir: None)
    monkeypatch.setattr(catalog, "staging_path", lambda spark, name: name)
    monkeypatch.setattr(lifecycle, "train_all", train_all)
    with pytest.raises(Asked) as e:
        catalog.train_choose_score(None, None)
    assert e.value.args == (["logistic_regression", "random_forest", "boosted_trees"], None, 5)
