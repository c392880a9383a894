"""Published mails, metrics and choices with known outcomes."""

import pytest
from pyspark.sql import functions as F

from mailgrade import phrases as P
from mailgrade.operators import metrics, rules, selection
from mailgrade.plans.scoring import score

# sender, subject, body, label, rule class, shares in percent
MAILS = [
    ("incident@aurora-hospital.org", "CODE BLUE — immediate attention required",
     "Emergency on Ward 4. All available staff report now. This is critical and time sensitive. "
     "Respond immediately — lives at stake. ASAP.", 0, 0, (88.24, 7.35, 4.41, 0.0)),
    ("cfo@veloxfinance.io", "Regulator deadline TODAY — sign-off before 17:00",
     "Urgent action required: we must file by EOD today. Top priority. Please review and respond "
     "now. Time-sensitive compliance window.", 0, 0, (62.50, 35.16, 2.34, 0.0)),
    ("sre@northgrid.cloud", "SEV-1: production API down — respond now",
     "Customer impact is severe. Immediate attention needed. Right away — we need owners on "
     "bridge. Critical incident.", 0, 0, (94.34, 0.0, 5.66, 0.0)),
    ("jamie@studio-knot.design", "Font files for the brand refresh (v3)",
     "Sharing the updated OTFs in the drive. No rush — use whichever weight you prefer for "
     "mockups. Ping me if links break.", 1, 2, (0.0, 5.08, 94.92, 0.0)),
    ("facilities@oak-campus.edu", "Elevator B back in service",
     "Routine notice: Elevator B maintenance finished. Standard announcement for the west wing. "
     "Thanks for patience this week.", 1, 1, (0.0, 76.92, 23.08, 0.0)),
    ("promo@freshcart.market", "Monthly promotional mailing list",
     "FYI: weekly deals inside. Newsletter for subscribers only. Click unsubscribe if you no "
     "longer want promotional emails. Mailing list message.", 3, 3, (0.0, 0.0, 6.25, 93.75)),
    ("a@b.com", "viva", "asap: urgent meeting", 0, 0, (69.77, 23.26, 6.98, 0.0)),
    ("a@b.com", "lunch", "noon tomorrow ok?", 1, 1, (0.0, 71.43, 28.57, 0.0)),
    ("a@b.com", "viva meeting", "remember meeting will taken on next year", 0, 2,
     (8.82, 8.82, 82.35, 0.0)),
    ("a@b.com", "viva", "urgent: your viva is next week", 0, 0, (60.61, 30.30, 9.09, 0.0)),
]


@pytest.fixture(scope="module")
def mails(spark):
    rows = [(i, *m[:3], "") for i, m in enumerate(MAILS)]
    return spark.createDataFrame(
        rows, "id int, sender string, subject string, body string, folder string"
    )


def test_list_sizes():
    lists = (P.CRITICAL, P.HIGH, P.LOW, P.DISTANT, P.NEAR, P.CSUITE)
    assert [len(x) for x in lists] == [82, 202, 116, 20, 25, 9]
    assert all(len(set(x)) == len(x) for x in lists)
    assert set(P.CRITICAL) & set(P.HIGH) == {"viva", "defense"}


def test_labels_and_rule_classes(mails):
    rows = rules.rule_classify(rules.weak_label(mails)).orderBy("id").collect()
    for row, (_, _, _, label, rule_class, shares) in zip(rows, MAILS):
        assert (row["priority"], row["rule_class"]) == (label, rule_class)
        assert [round(100 * p, 2) for p in row["rule_proba"]] == pytest.approx(shares, abs=0.006)


def test_far_horizon_mail_is_not_urgent(mails):
    by_id = {r["id"]: r for r in score(mails).collect()}
    assert by_id[8]["priority"] in ("normal", "low")
    assert by_id[9]["priority"] == "critical"
    assert all(abs(sum(r["confidence_scores"].values()) - 1) < 1e-9 for r in by_id.values())
    assert all(r["confidence_scores"][r["priority"]] == r["confidence"] for r in by_id.values())


def test_tie_goes_to_the_lowest_class(spark):
    mail = spark.createDataFrame([("critical today rsvp",)], "text string")
    row = rules.rule_scores(mail, F.col("text")).first()
    assert row["critical_score"] == row["high_score"] == 2.0 and row["rule_class"] == 0


CONFUSION = [[76, 31, 13, 0], [17, 164, 13, 6], [14, 25, 297, 24], [0, 1, 59, 60]]


@pytest.fixture(scope="module")
def counts(spark):
    rows = [(t, p, n) for t, line in enumerate(CONFUSION) for p, n in enumerate(line) if n]
    single = spark.createDataFrame(rows, "y_true int, y_pred int, n int")
    return metrics.confusion_counts(single.withColumn("_", F.explode(F.sequence(F.lit(1), "n"))))


def test_published_metrics(counts):
    report = {r["class"]: r for r in metrics.classification_report(counts).collect()}
    expected = {
        "critical": (0.7102803738, 0.6333333333, 0.6696035242, 120),
        "high": (0.7420814480, 0.82, 0.7790973872, 200),
        "normal": (0.7774869110, 0.825, 0.8005390836, 360),
        "low": (0.6666666667, 0.5, 0.5714285714, 120),
        "macro avg": (0.7241288499, 0.6945833333, 0.7051671416, 800),
        "weighted avg": (0.7419315280, 0.74625, 0.7411717487, 800),
        "accuracy": (0.74625, 0.74625, 0.74625, 800),
    }
    assert set(report) == set(expected)
    for name, (precision, recall, f1, support) in expected.items():
        row = report[name]
        assert (row["precision"], row["recall"], row["f1"]) == pytest.approx(
            (precision, recall, f1), abs=1e-9
        )
        assert row["support"] == support


def test_empty_cells_are_zero(spark):
    one = spark.createDataFrame([(2, 2)], "y_true int, y_pred int")
    cells = metrics.confusion_counts(one)
    assert cells.count() == 16 and cells.agg(F.sum("n")).first()[0] == 1
    row = metrics.accuracy_macro_f1(cells).first()
    assert (row["accuracy"], row["macro_f1"]) == (1.0, 1.0)  # absent classes do not count


TRAINING = [
    ("logistic_regression", 0.74625, 0.7051671415972487, 18.77, 0.7435, 0.013261787209874863,
     0.6966467282212486, 0.01599321150819335),
    ("random_forest", 1.0, 1.0, 0.68, 1.0, 0.0, 1.0, 0.0),
    ("xgboost", 1.0, 1.0, 39.51, 1.0, 0.0, 1.0, 0.0),
]
COLUMNS = (
    "model string, accuracy double, macro_f1 double, train_time_s double, "
    "cv_accuracy_mean double, cv_accuracy_std double, cv_f1_macro_mean double, "
    "cv_f1_macro_std double"
)


@pytest.fixture(scope="module")
def training(spark):
    return spark.createDataFrame(TRAINING, COLUMNS)


def test_perfect_models_are_passed_over(training):
    assert selection.best_model(training, training).first()["model"] == "logistic_regression"
    flags = {r["model"]: r["suspicious"] for r in selection.ranked(training, training).collect()}
    assert flags == {"logistic_regression": False, "random_forest": True, "xgboost": True}


def test_perfect_models_are_taken_when_nothing_else_is_there(training):
    perfect = training.filter("model <> 'logistic_regression'")
    assert selection.best_model(perfect, perfect).first()["model"] == "random_forest"


def test_fallback_follows_the_rule(training):
    row = selection.fallback_decision(training, training).first()
    assert row["needs_fallback"] and row["decided_accuracy"] == 0.7435
    nothing = selection.fallback_gate(selection.fallback_decision(training, training).limit(0))
    assert nothing.first()["needs_fallback"]


def test_without_cross_validation_the_test_split_counts(training):
    none = training.limit(0)
    row = {r["model"]: r for r in selection.published_metrics(training, none).collect()}
    assert row["xgboost"]["performance_basis"] == selection.BASIS_TEST
    assert row["xgboost"]["metrics_caveat"] is None and row["xgboost"]["train_time_s"] == 0.0
    assert not selection.ranked(training, none).filter("suspicious").count()


def test_caveats(training):
    row = {r["model"]: r["metrics_caveat"] for r in
           selection.published_metrics(training, training).collect()}
    assert row["logistic_regression"] is None
    assert row["random_forest"] == f"{selection.CAVEAT_SPREAD} {selection.CAVEAT_EASY}"
