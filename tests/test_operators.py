"""Operators on small fixtures: row rules, splits, oversampling, models, sources, streams."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from mailgrade.functions import mail as M
from mailgrade.functions import terms as tm
from mailgrade.operators import (
    attribution,
    features,
    metrics,
    quality,
    rules,
    sampling,
    smote,
    tfidf,
    training,
)
from mailgrade.plans import ingest, scoring
from mailgrade.session import materialise
from mailgrade.sources import fixture as fx
from mailgrade.sources import messages, reports, requests, store, tabular
from mailgrade.streaming import scoring as streaming


@pytest.fixture(scope="module")
def labelled(spark, sf_dir):
    return materialise(rules.weak_label(fx.mail(spark, sf_dir)))


# --- row rules ---------------------------------------------------------------------------------


def test_missing_columns_get_defaults(spark):
    row = quality.with_defaults(spark.createDataFrame([("Re: x",)], "subject string")).first()
    assert row["body"] == row["sender"] == "" and row["recipient_count"] == 0
    assert (row["hour_of_day"], row["day_of_week"], row["subject_has_re"]) == (-1, -1, 1)
    given = spark.createDataFrame([("x", "7", "bad")], "subject string, hour_of_day string, "
                                  "day_of_week string")
    row = quality.with_defaults(given).first()
    assert (row["hour_of_day"], row["day_of_week"]) == (7, -1)


def test_keep_first_with_a_hot_key(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("message_id"),
        F.format_string("%05d", 3000 - F.col("id")).alias("path"),
    )
    kept = quality.keep_first(rows)
    assert kept.count() == 2001
    assert kept.filter("message_id = 'hot'").first()["path"] == "00003"
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # ranks are cut before the shuffle too


def test_unknown_priority_is_refused(spark):
    with pytest.raises(ValueError):
        quality.with_priority(spark.range(1), "urgent")


def test_costly_columns_are_not_repeated_by_filters(spark, sf_dir):
    scored = rules.rule_classify(fx.mail(spark, sf_dir))
    plan = scored.filter("rule_class = 0 AND id > 5")._jdf.queryExecution()
    text = plan.optimizedPlan().toString()
    assert text.count("regexp_extract_all") == 1
    assert "doc_id" in plan.executedPlan().toString().split("PushedFilters")[1][:200]


def test_transformer_inputs(spark):
    stage = rules.RulePriorityClassifier(textCol="t")
    texts = spark.createDataFrame([("urgent!",), (None,)], "t string")
    assert [r["prediction"] for r in stage.transform(texts).collect()] == [0, 2]
    vectors = spark.createDataFrame([(Vectors.dense([1.0]),)], ["features"])
    row = rules.RulePriorityClassifier().transform(vectors).first()
    assert (row["prediction"], list(row["probability"])) == (2, [0.05, 0.15, 0.70, 0.10])


# --- samples, splits, folds --------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 7, 100, 1000, 5000])
def test_sample_cap_is_exact(spark, n):
    rows = spark.range(1000)
    assert sampling.sample_cap(rows, n).distinct().count() == min(n, 1000)


def test_split_and_folds(spark):
    rows = spark.range(1003).select("id", F.when(F.col("id") < 3, 3).otherwise(
        (F.col("id") % 3).cast("int")).alias("priority"))
    split = sampling.stratified_split(rows)
    assert split.count() == 1003
    for r in split.groupBy("priority").agg(
        F.count("*").alias("n"), F.sum(F.col("is_test").cast("int")).alias("t")
    ).collect():
        assert r["t"] == int(r["n"] * 0.2 + 0.5)
    folds = sampling.stratified_folds(rows)
    sizes = folds.groupBy("priority").pivot("fold", list(range(5))).count().fillna(0).collect()
    assert sum(sum(r[1:]) for r in sizes) == 1003
    assert all(max(r[1:]) - min(r[1:]) <= 1 for r in sizes)


def test_class_weights(spark):
    rows = spark.createDataFrame([(0,), (0,), (0,), (1,)], "priority int")
    weights = {r["priority"]: r["weight"] for r in sampling.class_weights(rows).collect()}
    assert weights == pytest.approx({0: 4 / 6, 1: 2.0})


# --- oversampling ------------------------------------------------------------------------------


def points(spark, sizes):
    rng = np.random.default_rng(5)
    rows = [
        (f"{c}-{i}", c, Vectors.sparse(6, [0, 2, 5], [float(c), *map(float, rng.random(2))]))
        for c, n in enumerate(sizes) for i in range(n)
    ]
    return spark.createDataFrame(rows, ["id", "priority", "features"])


def test_smote_fills_every_class_between_neighbours(spark):
    rows = points(spark, [12, 5, 7])
    out = smote.smote(rows).collect()
    assert sorted(r["priority"] for r in out) == [0] * 12 + [1] * 12 + [2] * 12
    have = {}
    for r in rows.collect():
        have.setdefault(r["priority"], {})[r["id"]] = r["features"].toArray()
    for r in (r for r in out if "+" in r["id"]):
        mates = have[r["priority"]]
        base, new = mates[r["id"].split("+")[0]], r["features"].toArray()
        near = sorted((np.linalg.norm(v - base), k) for k, v in mates.items()
                      if k != r["id"].split("+")[0])[:4]
        on_a_line = [
            np.linalg.norm(np.cross((mates[k] - base)[[0, 2, 5]], (new - base)[[0, 2, 5]])) < 1e-9
            for _, k in near
        ]
        assert any(on_a_line)


def test_smote_leaves_tiny_or_gappy_data_alone(spark):
    assert smote.smote(points(spark, [9, 1])).count() == 10
    gap = points(spark, [9, 4]).withColumn("priority", F.col("priority") * 2)
    assert smote.smote(gap).count() == 13


def test_smote_in_blocks_fills_exactly_and_stays_in_the_class(spark):
    rows = points(spark, [90, 40, 33])
    repeated = rows.withColumn("id", F.regexp_replace("id", "-[1-5]$", "-0"))
    out = smote.smote(repeated, block=8).collect()
    assert sorted(r["priority"] for r in out) == [0] * 90 + [1] * 90 + [2] * 90
    have = {}
    for r in rows.collect():
        have.setdefault(r["priority"], []).append(r["features"].toArray())
    for r in (r for r in out if "+" in r["id"]):
        low, high = np.min(have[r["priority"]], axis=0), np.max(have[r["priority"]], axis=0)
        new = r["features"].toArray()
        assert (new >= low - 1e-9).all() and (new <= high + 1e-9).all()


# --- text weights and models -------------------------------------------------------------------


def test_tfidf_needs_a_vocabulary(spark):
    docs = spark.createDataFrame([(["a"],)], "terms array<string>")
    with pytest.raises(ValueError):
        tfidf.MailTfidfModel().transform(docs)


def test_tfidf_weights(spark):
    texts = ["apple apple pear", "apple plum", "plum pear plum", "kiwi fig"]
    mail = spark.createDataFrame([(i, "", t) for i, t in enumerate(texts)],
                                 "id int, subject string, body string")
    docs = tfidf.with_terms(mail)
    model = tfidf.MailTfidf().fit(docs)
    assert model.getOrDefault(model.terms) == ["apple", "pear", "plum"]
    got = {(r["id"], r["term"]): r["weight"] for r in model.weights(docs, "id").collect()}
    idf = np.log(5 / 3) + 1
    first = np.array([(1 + np.log(2)) * idf, idf])
    assert (got[0, "apple"], got[0, "pear"]) == pytest.approx(tuple(first / np.linalg.norm(first)))
    vectors = [r["tfidf"] for r in model.transform(docs).orderBy("id").collect()]
    assert vectors[3].numNonzeros() == 0 and vectors[0].size == 3


@pytest.fixture(scope="module")
def trained(spark, labelled):
    built = training.feature_pipeline(max_terms=200).fit(labelled)
    rows = training.feature_table(labelled, built)
    return built, rows, training.fit(training.logistic_regression(max_iter=30), rows)


def test_names_match_the_vector(trained):
    built, rows, _ = trained
    names = training.vector_names(built)
    assert rows.first()["features"].size == len(names) == len(features.NARROW) + 200


def test_saved_model_scores_alike(spark, sf_dir, trained, tmp_path):
    built, _, classifier = trained
    model = training.scorer(built, classifier)
    path = str(tmp_path / "model")
    training.save(model, path)
    mail = fx.mail(spark, sf_dir)
    pick = lambda m: [
        (r["id"], r["priority"], round(r["confidence"], 9), sorted(r["shap_values"]))
        for r in scoring.score(mail, m, "logistic_regression").orderBy("id").collect()
    ]
    assert pick(model) == pick(training.load(path))


def test_row_attribution_equals_numpy(spark, sf_dir, trained):
    built, _, classifier = trained
    model, names = training.scorer(built, classifier), training.vector_names(built)
    predicted = training.predict(model, fx.mail(spark, sf_dir))
    row = attribution.row_attribution(predicted, model).orderBy("id").first()
    terms = np.abs(row["features"].toArray()
                   * classifier.coefficientMatrix.toArray()[row["prediction"]])
    top = sorted(((-v, i) for i, v in enumerate(terms)))[:10]
    assert [s["name"] for s in row["signals"]] == [names[i] for _, i in top]
    assert [s["weight"] for s in row["signals"]] == pytest.approx([-v for v, _ in top])


def test_global_attribution_equals_numpy(spark, trained):
    built, rows, classifier = trained
    names = training.vector_names(built)
    got = attribution.global_attribution(rows, classifier, names, sample_rows=60,
                                         background_rows=40, k=5).collect()
    matrix = lambda df: np.array([r["features"].toArray() for r in df.collect()])
    back = matrix(sampling.sample_cap(rows, 40))
    sample = matrix(sampling.sample_cap(rows, 60, seed=7))
    off = np.abs(sample - back.mean(axis=0)).mean(axis=0)
    want = off * np.abs(classifier.coefficientMatrix.toArray()).mean(axis=0)
    order = np.argsort(-want)[:5]
    assert [r["name"] for r in got] == [names[i] for i in order]
    assert [r["weight"] for r in got] == pytest.approx(list(want[order]))


def test_boosted_trees_give_shares(trained):
    _, rows, _ = trained
    model = training.fit(training.boosted_trees(2, 2), rows)
    row = training.predict(model, rows).first()
    assert sum(row["probability"]) == pytest.approx(1.0)
    assert row["probability"].index(max(row["probability"])) == row["prediction"]


def test_roc_auc_equals_pair_counting(spark):
    rng = np.random.default_rng(3)
    rows = [(int(t), [float(round(p, 2)) for p in q]) for t, q in
            zip(rng.integers(0, 3, 200), rng.dirichlet([1, 1, 1, 1], 200))]
    frame = spark.createDataFrame(rows, "y_true int, probability array<double>")
    got = {r["class_id"]: r["auc"] for r in metrics.roc_auc(metrics.roc_points(frame)).collect()}
    for c in range(3):
        pos = [q[c] for t, q in rows if t == c]
        neg = [q[c] for t, q in rows if t != c]
        wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
        assert got[c] == pytest.approx(wins / (len(pos) * len(neg)))
    assert got[3] is None


def test_score_buckets_follow_the_data(spark):
    rng = np.random.default_rng(4)
    scores = 1 / (1 + np.exp(-rng.normal(6, 4, 20_000)))  # crowded near one
    frame = spark.createDataFrame([(0, float(x)) for x in scores], "class_id int, score double")
    sizes = [r["n"] for r in metrics.score_buckets(frame, 64).groupBy("_bucket").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 64 and max(sizes) < 2 * 20_000 / 64


# --- sources and streams -----------------------------------------------------------------------

PLAIN = b"""Message-ID: <1@x>\r
From: "Ann B" <Ann@X.com>\r
To: Bob <bob@y.org>, "C, D" <cd@z.net>\r
Subject: =?utf-8?q?Caf=C3=A9?= plans\r
Date: Mon, 14 May 2001 16:39:00 -0700 (PDT)\r
\r
  Hello there\r
"""
MULTI = b"""From: x@y.z
Subject: parts
MIME-Version: 1.0
Content-Type: multipart/mixed; boundary=B

--B
Content-Type: text/plain; charset=utf-8
Content-Transfer-Encoding: base64

w6kgb25l
--B
Content-Type: text/plain
Content-Disposition: attachment; filename=a.txt

secret
--B
Content-Type: text/html

<p>html</p>
--B
Content-Type: text/plain; charset=latin-1
Content-Transfer-Encoding: quoted-printable

caf=E9 two
--B--
"""
LATIN = "From: jos\xe9@x.y\nSubject: caf\xe9\n\nol\xe9".encode("latin-1")


def test_messages_from_files(spark, tmp_path):
    for name, content in {"al/inbox/1.": PLAIN, "al/sent/old/2.": MULTI, "bo/3": LATIN,
                          "bo/inbox/.hidden": PLAIN, "bo/inbox/4": b"\n\nno headers",
                          "bo/inbox/5": PLAIN}.items():
        file = tmp_path / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(content)
    table, rejects = ingest.ingest_folder(spark, str(tmp_path))
    rows = {r["message_id"].split("/")[-1]: r for r in table.collect()}
    assert len(rows) == 3
    first = rows["<1@x>"]
    assert (first["sender"], first["recipients"]) == ("ann@x.com", "bob@y.org, cd@z.net")
    assert (first["subject"].split(), first["body"]) == (["Café", "plans"], "Hello there")
    assert (first["hour_of_day"], first["day_of_week"], first["folder"]) == (16, 0, "inbox")
    assert first["date"] == "2001-05-14T16:39:00-07:00" and first["recipient_count"] == 2
    assert rows["2."]["body"] == "é one\ncafé two" and rows["2."]["folder"] == "sent/old"
    assert rows["3"]["subject"] == "café" and rows["3"]["body"] == "olé"
    assert [r["reject_reason"] for r in rejects.collect()] == ["no sender and no subject"]
    assert ingest.ingest_folder(spark, str(tmp_path), max_mails=2)[0].count() <= 2
    assert messages.read_messages(spark, str(tmp_path)).count() == 5


def test_broken_headers_and_charsets_lose_nothing(spark):
    files = [
        ("/mail/u/inbox/1", b"From: a@b.c\nSubject: =?utf-8?b?a?= x\n\nhi"),
        ("/mail/u/inbox/2", "From: a@b.c\nSubject: s\nContent-Type: text/plain; charset=latin-1\n"
                            "Content-Transfer-Encoding: 8bit\n\ncaf\xe9".encode("latin-1")),
        ("/mail/u/inbox/3", "From: a@b.c\nSubject: s\nContent-Type: text/plain; charset=nonsense\n\nolé".encode()),
        ("/mail/u/inbox/4", b"From: a@b.c\nSubject: s\nDate: 2026-04-23T15:21\n\nb"),
        ("/mail/u/inbox/5", b"From: a@b.c\nSubject: s\nDate: sometime\n\nb"),
        ("/mail/u/inbox/6", None),
    ]
    rows = messages.parse_messages(spark.createDataFrame(files, "path string, content binary"), "/mail").collect()
    got = {r["path"][-1]: r for r in rows}
    assert got["1"]["reject_reason"] is None and got["1"]["subject"].endswith("x") and got["1"]["body"] == "hi"
    assert (got["2"]["body"], got["3"]["body"]) == ("café", "olé")
    assert (got["4"]["date"], got["4"]["hour_of_day"]) == ("2026-04-23T15:21:00", 15)
    assert (got["5"]["date"], got["5"]["hour_of_day"]) == ("sometime", -1)
    assert got["6"]["reject_reason"] == "unreadable"


def test_folder_below_the_first_root(spark):
    paths = {"/mail/user1/mail/5": "mail", "/mail/u/mail/old/7": "mail/old", "/mail/u/5": "5", "/other/u/x/5": "unknown"}
    frame = spark.createDataFrame([(p,) for p in paths], "path string")
    got = frame.select("path", M.folder_from_path(F.col("path"), "/mail").alias("f")).collect()
    assert {r["path"]: r["f"] for r in got} == paths


def test_words_beyond_ascii(spark):
    frame = spark.createDataFrame([("by märzday", "a\U0001FBF1 b"), ("by monday", "x1 y")], "t string, w string")
    got = frame.select(M.has_deadline(F.col("t")).alias("d"), tm.words(F.col("w")).alias("w")).collect()
    assert [(r["d"], r["w"]) for r in got] == [(1, ["a1"]), (1, ["x1"])]


def test_store_keeps_rejects_and_replays_once(spark, sf_dir, tmp_path):
    mail = fx.mail(spark, sf_dir).withColumn("created_at", F.col("date"))
    scored = store.to_results(scoring.score(mail))
    path, rejects = str(tmp_path / "s"), str(tmp_path / "r")
    for _ in range(2):
        store.append(scored, path, rejects, batch_id=7)
    kept, lost = store.read(spark, path).count(), spark.read.parquet(rejects)
    assert kept + lost.count() == mail.count() and lost.filter("reject_reason IS NULL").count() == 0
    store.delete(spark, path, spark.createDataFrame([(42,)], "id long"))
    assert store.read(spark, path).count() == kept - 1


def test_csv_keeps_line_breaks_and_quotes(spark, tmp_path):
    body = 'a "quoted" line,\nand another\n'
    row = spark.createDataFrame([tuple("x" for _ in range(6)) + (body, "", "f")],
                                ", ".join(f"{c} string" for c in tabular.RAW_COLUMNS))
    tabular.write_csv(row, str(tmp_path / "csv"))
    back = tabular.read_csv(spark, str(tmp_path / "csv"), row.schema).first()
    assert back["body"] == body and back["date"] == ""


def test_requests_as_a_whole(spark):
    lines = ['{"request_id":"a","emails":[{"subject":"s"},{"sender":"x"}]}',
             '{"request_id":"b","emails":[]}', '{"request_id":"c"}']
    parsed = requests.parse_requests(spark.createDataFrame([(v,) for v in lines], "value string"))
    errors = {r["request_id"]: r["e"] for r in
              parsed.select("request_id", requests.request_error().alias("e")).collect()}
    assert errors == {"a": None, "b": requests.EMPTY_EMAILS, "c": requests.NO_EMAILS}
    exploded = requests.explode_requests(parsed)
    rows = exploded.orderBy("request_id", "index").collect()
    assert [(r["request_id"], r["index"], r["error"] is None) for r in rows] == [
        ("a", 0, True), ("a", 1, False), ("b", None, False), ("c", None, False)]
    totals = {r["request_id"]: tuple(r)[1:] for r in requests.request_totals(exploded).collect()}
    assert totals == {"a": (2, 1, 1, None), "b": (0, 0, 0, requests.EMPTY_EMAILS),
                      "c": (0, 0, 0, requests.NO_EMAILS)}


def test_store_and_delete(spark, sf_dir, tmp_path):
    mail = fx.mail(spark, sf_dir).withColumn("created_at", F.col("date"))
    scored = store.to_results(scoring.score(mail))
    path = str(tmp_path / "s")
    store.append(scored, path)
    store.append(scored.limit(0), path)
    stored = store.read(spark, path)
    n = stored.count()
    assert n == mail.filter("trim(subject) <> '' AND trim(body) <> ''").count()
    assert store.find(stored, 42).count() == 1
    store.delete(spark, path, spark.createDataFrame([(42,), (3,)], "id long"))
    assert store.read(spark, path).count() == n - 2


def test_report_sinks(spark, tmp_path):
    long = spark.createDataFrame([("m", "low", "f1", 0.5), ("m", "low", "recall", 0.25)],
                                 "model string, class string, metric string, value double")
    reports.write_long(long, str(tmp_path / "long"))
    assert reports.read_long(spark, str(tmp_path / "long")).count() == 2
    import json
    assert json.loads(reports.nested(long).first()["report"]) == {
        "m": {"low": {"f1": 0.5, "recall": 0.25}}}
    reports.write_best(long.limit(1), str(tmp_path / "best"))
    assert reports.read_best(spark, str(tmp_path / "best")) == "m"


def test_json_requests_are_scored_once_as_they_arrive(spark, sf_dir, tmp_path):
    inbox, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    mail = fx.mail(spark, sf_dir)
    for part in (0, 1):
        chosen = streaming.as_json_requests(mail.filter(F.col("id") % 2 == part))
        chosen.write.mode("append").json(inbox)
        scored = streaming.score_stream(streaming.read_requests(spark, inbox))
        streaming.write_files(
            scored.select("subject", "priority"), out, state
        ).awaitTermination()
    batch = scoring.score(mail).groupBy("priority").count().collect()
    live = spark.read.parquet(out).groupBy("priority").count().collect()
    assert sorted(map(tuple, batch)) == sorted(map(tuple, live))


def test_cuts_survive_a_hot_id(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") < 1000, -1).otherwise(F.col("id")).alias("id"), F.lit(0).alias("priority")
    )
    split = sampling.stratified_split(rows).groupBy("id").agg(F.countDistinct("is_test").alias("n"))
    assert split.filter("n > 1").count() == 0
    assert sampling.sample_cap(rows, 100).count() in (*range(95, 101), *range(1000, 1101))


def test_other_layouts(spark, sf_dir, labelled):
    from mailgrade.operators import embeddings

    mail = embeddings.join_embeddings(labelled, fx.embeddings(spark, sf_dir), 64)
    built = training.feature_pipeline("compact", 50, embeddings=True).fit(mail)
    size = built.transform(mail).first()["features"].size
    names = training.vector_names(built, size)
    assert len(names) == size == 16 + 50 + 64 and names[:2] == ["recipient_count", "has_cc"]
