"""Named queries over the given tables; each takes ``(spark, sf_dir)``."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import DenseMatrix
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, display, matching
from ..functions import mail as M
from ..functions import probability as pr
from ..functions import terms as tm
from ..operators import (
    attribution,
    dashboard,
    embeddings,
    explain,
    features,
    logistic,
    metrics,
    neighbours,
    quality,
    rules,
    sampling,
    selection,
    smote,
    tfidf,
    training,
)
from ..session import materialise, staging_path
from ..sources import fixture as fx
from ..sources import folder, messages, reports, requests, snapshots, store, tabular
from ..streaming import scoring as streaming
from . import evaluation, ingest, lifecycle, scoring

SAMPLE_SIZE = 150
EMBEDDING_SIZE = 64

QUERIES = {}


def query(build):
    QUERIES[build.__name__] = build
    return build


def _r(column, digits: int = 6):
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column, digits)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: _r(n) for n in names})


def _spread(vector: str, prefix: str = "p"):
    return [_r(F.get(F.col(vector), F.lit(i))).alias(f"{prefix}{i}") for i in range(4)]


def _labelled(spark, sf_dir) -> DataFrame:
    return rules.weak_label(fx.mail(spark, sf_dir))


def _judged(spark, sf_dir) -> DataFrame:
    """Weak label as truth, rule class as prediction."""
    return rules.rule_classify(_labelled(spark, sf_dir)).select(
        "id", F.col("priority").alias("y_true"), F.col("rule_class").alias("y_pred"),
        F.col("rule_proba").alias("probability"),
    )


def _results(spark, sf_dir) -> DataFrame:
    scored = scoring.score(fx.mail(spark, sf_dir).withColumn("created_at", F.col("date")))
    return store.to_results(scored)


# --- labels and rows ---------------------------------------------------------------------------


@query
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _labelled(spark, sf_dir).select(M.label_name(F.col("priority")).alias("priority_label"))
    return _rounded(metrics.distribution(named, "priority_label"), "percent")


@query
def assign_priority(spark, sf_dir):
    return _labelled(spark, sf_dir).select(
        "id", "priority", M.label_name(F.col("priority")).alias("priority_label")
    )


@query
def assign_priority_whole_word(spark, sf_dir):
    return rules.weak_label(fx.mail(spark, sf_dir), whole_word=True).select("id", "priority")


@query
def label_names(spark, sf_dir):
    name = M.label_name(F.col("priority"))
    return _labelled(spark, sf_dir).select(
        "id", name.alias("name"), M.label_id(name).alias("back")
    )


@query
def mail_gate(spark, sf_dir):
    return quality.with_origin(fx.mail_dirty(spark, sf_dir)).select("id", "sender", "subject")


@query
def payload_errors(spark, sf_dir):
    _, errors = quality.split_payloads(fx.mail_dirty(spark, sf_dir))
    return errors.select("id", "error")


@query
def store_quality(spark, sf_dir):
    good, bad = quality.split_store_quality(fx.mail_dirty(spark, sf_dir))
    return good.select("id", F.lit(True).alias("ready")).unionByName(
        bad.select("id", F.lit(False).alias("ready"))
    )


@query
def mail_defaults(spark, sf_dir):
    """Sparse mail (no recipients, flags or folder) filled up; dates are raw headers."""
    sparse = fx.mail_headers(spark, sf_dir).select("id", F.col("date_header").alias("date")).join(
        fx.mail_dirty(spark, sf_dir).select("id", F.nullif("subject", F.lit("")).alias("subject")),
        "id",
    )
    return quality.with_defaults(sparse).select(
        "id", "sender", "recipients", "subject", "cc", "bcc", "folder", "hour_of_day",
        "day_of_week", "recipient_count", "has_cc", "has_bcc", "subject_has_re", "subject_has_fw",
    )


@query
def raw_projection(spark, sf_dir):
    return tabular.raw_projection(fx.mail(spark, sf_dir))


@query
def sample_cap(spark, sf_dir):
    return sampling.sample_cap(fx.mail(spark, sf_dir), SAMPLE_SIZE).select("id", "subject")


@query
def dedup_first(spark, sf_dir):
    labelled = rules.weak_label(fx.mail_dup(spark, sf_dir))
    return quality.keep_first(labelled, "message_id", "seq").select(
        "id", "message_id", "seq", "priority"
    )


@query
def dedup_report(spark, sf_dir):
    """Rows before and after keep-first; one grouped count gives both."""
    per_key = fx.mail_dup(spark, sf_dir).groupBy("message_id").agg(F.count("*").alias("n"))
    return per_key.agg(
        F.sum("n").alias("before"), F.count("*").alias("after"),
        (F.sum("n") - F.count("*")).alias("dropped"),
    )


# --- scalar functions --------------------------------------------------------------------------


@query
def extract_addresses(spark, sf_dir):
    header = F.col("to_header")
    return fx.mail_headers(spark, sf_dir).select(
        "id", M.extract_addresses(header).alias("addresses"),
        F.size(M.address_array(header)).alias("n_addresses"),
    )


@query
def parse_dates(spark, sf_dir):
    moment = dates.local_time(F.col("date_header"))
    return fx.mail_headers(spark, sf_dir).select(
        "id", moment.alias("local_time"), dates.hour_of_day(moment).alias("hour_of_day"),
        dates.day_of_week(moment).alias("day_of_week"),
    )


#: Dates in words of the mail's own id; each stands for 14 May 2001 or is none.
_FREE_DATES = (
    "Mon May 14 16:39:00 2001", "14th of May 2001, 4:39 pm", "May 14th, 2001 at 4pm", "2001/05/14 16:39", "14.05.2001 16:39:00",
    "14-May-2001 16:39:00 +0200", "14-May-01 16:39", "20010514", "20010514T163900Z", "05-14-2001", "14/05/01", "Monday, 14 May 2001 16h39",
    "May 14 2001 12:05 AM", "16:39 14 May 2001", "2001 May 14", "14 May '99 08:15:30", "Mon May 14 16:39:00 EDT 2001", "31 Feb 2001", "May 2001", "12:30",
)


@query
def parse_dates_free(spark, sf_dir):
    """Dates in twenty spellings."""
    headers = F.array(*map(F.lit, _FREE_DATES))
    header = F.get(headers, (F.col("id") % len(_FREE_DATES)).cast("int"))
    return fx.mail_text(spark, sf_dir).select("id", dates.local_time(header).alias("local_time"))


@query
def sender_domain_counts(spark, sf_dir):
    domain = M.sender_domain(F.col("sender"))
    return (
        fx.mail(spark, sf_dir)
        .select(domain.alias("domain"), M.store_domain(F.col("sender")).alias("store_domain"))
        .groupBy("domain", "store_domain")
        .agg(F.count("*").alias("n"))
        .withColumn("bucket", M.domain_bucket(F.col("domain")))
    )


@query
def thread_summary(spark, sf_dir):
    subject = F.col("subject")
    return (
        fx.mail(spark, sf_dir)
        .select(
            M.thread_id(subject, F.col("message_id")).alias("thread_id"), "date",
            M.has_reply_prefix(subject).alias("reply"), M.thread_depth(subject).alias("depth"),
            M.forward_count(subject).alias("forwards"),
        )
        .groupBy("thread_id")
        .agg(
            F.count("*").alias("mails"), F.sum("reply").alias("replies"),
            F.max("depth").alias("max_depth"), F.sum("forwards").alias("forwards"),
            F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        )
    )


@query
def conversation_threads(spark, sf_dir):
    """The same thread key over the chat turns, whose first line stands for a subject."""
    opening = F.substring_index("text", "\n", 1)
    return (
        fx.table(spark, sf_dir, "conversations")
        .select(
            M.thread_id(opening, F.col("conv_id").cast("string")).alias("thread_id"), "conv_id"
        )
        .groupBy("thread_id")
        .agg(F.count("*").alias("turns"), F.countDistinct("conv_id").alias("conversations"))
    )


@query
def text_clamps(spark, sf_dir):
    subject, body = F.col("subject"), F.col("body")
    return fx.mail_text(spark, sf_dir).select(
        "id",
        F.md5(M.label_text(subject, body)).alias("label_text"),
        F.md5(M.signal_text(subject, body, M.HORIZON_CHARS)).alias("horizon_text"),
        F.md5(M.embedding_text(subject, body)).alias("embedding_text"),
    )


@query
def csuite_senders(spark, sf_dir):
    sender = F.col("sender")
    return fx.mail(spark, sf_dir).select(
        "id", M.is_csuite(sender).alias("anywhere"),
        M.is_csuite(sender, whole_word=True).alias("whole_word"),
    )


@query
def phrase_membership(spark, sf_dir):
    text = M.signal_text(F.col("subject"), F.col("body"))
    book = rules.P.DEFAULT
    lists = ("critical", "high", "low", "distant", "near")
    return fx.mail_text(spark, sf_dir).withColumn("t", text).select(
        "id",
        *(matching.contains_any(F.col("t"), getattr(book, n)).alias(n) for n in lists),
    )


# --- features ----------------------------------------------------------------------------------


@query
def feature_meta(spark, sf_dir):
    return features.mail_features(fx.mail(spark, sf_dir)).select("id", *features.META)


@query
def feature_urgency(spark, sf_dir):
    return features.mail_features(fx.mail(spark, sf_dir)).select("id", *features.URGENCY)


@query
def feature_compact(spark, sf_dir):
    return features.compact_features(fx.mail(spark, sf_dir)).select("id", *features.COMPACT)


@query
def feature_narrow(spark, sf_dir):
    """The full vector cut to the narrow layout."""
    wide = features.mail_features(fx.mail(spark, sf_dir)).select(
        "id", F.array(*(F.col(c).cast("double") for c in features.FULL)).alias("v")
    )
    cut = features.narrow_meta(F.col("v"))
    return wide.withColumn("v", cut).select(
        "id", *(F.get("v", F.lit(i)).cast("int").alias(n) for i, n in enumerate(features.NARROW))
    )


@query
def feature_names(spark, sf_dir):
    docs = tfidf.with_terms(fx.mail_text(spark, sf_dir))
    return features.feature_names(tfidf.vocabulary(docs, docs.count()))


@query
def tokenise(spark, sf_dir):
    text = F.concat("subject", F.lit(" "), "body")
    return (
        fx.mail_text(spark, sf_dir)
        .select("id", tm.words(text).alias("w"), tm.words(text, compact=True).alias("c"))
        .select(
            "id", F.size("w").alias("n_words"), F.md5(F.array_join("w", " ")).alias("words"),
            F.size("c").alias("n_compact"), F.md5(F.array_join("c", " ")).alias("compact_words"),
        )
    )


@query
def tfidf_vocabulary(spark, sf_dir):
    docs = tfidf.with_terms(fx.mail_text(spark, sf_dir))
    return _rounded(tfidf.vocabulary(docs, docs.count()), "idf")


@query
def tfidf_weights(spark, sf_dir):
    docs = tfidf.with_terms(fx.mail_text(spark, sf_dir))
    return _rounded(tfidf.MailTfidf().fit(docs).weights(docs, "id"), "weight")


@query
def tfidf_transform(spark, sf_dir):
    """Fitted on the mail, applied to chat turns as new mail; unseen terms drop out."""
    model = tfidf.MailTfidf().fit(tfidf.with_terms(fx.mail_text(spark, sf_dir)))
    turns = fx.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.lit("").alias("subject"), F.col("text").alias("body")
    )
    return _rounded(model.weights(tfidf.with_terms(turns), "conv_id", "turn"), "weight")


@query
def embedding_join(spark, sf_dir):
    joined = embeddings.join_embeddings(
        fx.mail(spark, sf_dir).select("id"), fx.embeddings(spark, sf_dir), EMBEDDING_SIZE
    )
    return joined.select(
        "id", F.size("embedding").alias("dims"),
        F.round(embeddings.length(F.col("embedding")), 4).alias("length"),
        F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"),
    )


# --- rules and scores --------------------------------------------------------------------------


@query
def rule_score(spark, sf_dir):
    mail = fx.mail(spark, sf_dir)
    scored = rules.rule_scores(mail, M.rule_text(F.col("subject"), F.col("body"), F.col("sender")))
    names = [f"{n}_score" for n in ("critical", "high", "normal", "low")]
    return scored.select(
        "id", *(_r(n).alias(n) for n in names), "is_far", "rule_class", *_spread("rule_proba")
    )


@query
def rule_classify(spark, sf_dir):
    return rules.rule_classify(fx.mail(spark, sf_dir)).select(
        "id", "rule_class", *_spread("rule_proba")
    )


@query
def rule_transformer(spark, sf_dir):
    """The same rules as a pipeline stage over plain text."""
    texts = fx.table(spark, sf_dir, "documents").select("doc_id", "text")
    return rules.RulePriorityClassifier(textCol="text").transform(texts).select(
        "doc_id", "prediction", *_spread("probability")
    )


@query
def rule_signals_top10(spark, sf_dir):
    signals = explain.rule_signals(fx.mail(spark, sf_dir)).select("id", F.posexplode("signals"))
    return signals.select(
        "id", (F.col("pos") + 1).alias("place"), F.col("col.name").alias("signal"),
        _r("col.weight").alias("weight"),
    )


@query
def urgency_bump(spark, sf_dir):
    ruled = rules.rule_classify(fx.model_scores(spark, sf_dir))
    return rules.bump_urgency(ruled, "logistic_regression").select(
        "id", "prediction", *_spread("probability")
    )


@query
def horizon_downgrade(spark, sf_dir):
    return rules.downgrade_far_horizon(fx.model_scores(spark, sf_dir)).select(
        "id", "prediction", *_spread("probability")
    )


@query
def adjusted_scores(spark, sf_dir):
    ruled = rules.rule_classify(fx.model_scores(spark, sf_dir))
    both = rules.downgrade_far_horizon(rules.bump_urgency(ruled, "logistic_regression"))
    return both.select("id", "prediction", *_spread("probability"))


@query
def score_rules(spark, sf_dir):
    scored = scoring.score(fx.mail(spark, sf_dir))
    named = [_r(F.col("confidence_scores")[n]).alias(f"score_{n}") for n in M.LABELS]
    return scored.select(
        "id", "priority", "priority_index", _r("confidence").alias("confidence"), *named,
        F.size("shap_values").alias("n_signals"), "model_used",
    )


@query
def scored_view(spark, sf_dir):
    """The scores through SQL, under the name the view is registered with."""
    scoring.register_view(fx.mail(spark, sf_dir))
    return spark.sql(
        "SELECT priority, count(*) AS n, round(min(confidence), 6) AS lowest FROM scored_mail "
        "GROUP BY priority"
    )


# --- metrics -----------------------------------------------------------------------------------


def _counts(spark, sf_dir):
    return metrics.confusion_counts(_judged(spark, sf_dir))


@query
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(_counts(spark, sf_dir))


@query
def per_class_metrics(spark, sf_dir):
    return _rounded(metrics.per_class(_counts(spark, sf_dir)), *metrics.MEASURES)


@query
def classification_report(spark, sf_dir):
    return _rounded(metrics.classification_report(_counts(spark, sf_dir)), *metrics.MEASURES)


@query
def accuracy_macro_f1(spark, sf_dir):
    return _rounded(metrics.accuracy_macro_f1(_counts(spark, sf_dir)), "accuracy", "macro_f1")


@query
def report_long(spark, sf_dir):
    """The report as it is stored, one number per row."""
    report = metrics.classification_report(_counts(spark, sf_dir))
    return _rounded(metrics.metrics_long(report), "value")


@query
def roc_points(spark, sf_dir):
    rounded = _judged(spark, sf_dir).withColumn(
        "probability", F.transform("probability", lambda p: F.round(p, 6))
    )
    points = metrics.roc_points(rounded)
    return points.select(
        "class_id", "score", _r(F.col("tp") / F.col("pos")).alias("tpr"),
        _r(F.col("fp") / F.col("neg")).alias("fpr"),
    )


@query
def roc_points_thin(spark, sf_dir):
    """The points at which the curves bend."""
    rounded = _judged(spark, sf_dir).withColumn("probability", F.transform("probability", lambda p: F.round(p, 6)))
    points = metrics.thinned(metrics.roc_points(rounded))
    return points.select("class_id", "score", _r(F.col("tp") / F.col("pos")).alias("tpr"), _r(F.col("fp") / F.col("neg")).alias("fpr"))


@query
def roc_auc(spark, sf_dir):
    rounded = _judged(spark, sf_dir).withColumn(
        "probability", F.transform("probability", lambda p: F.round(p, 6))
    )
    return _rounded(metrics.roc_auc(metrics.roc_points(rounded)), "auc")


@query
def class_weights(spark, sf_dir):
    return _rounded(sampling.class_weights(_labelled(spark, sf_dir)), "weight")


def _label_table(spark, sf_dir):
    """Ids and labels, written once: the split reads them several times."""
    return materialise(_labelled(spark, sf_dir).select("id", "priority"))


@query
def stratified_split(spark, sf_dir):
    return sampling.stratified_split(_label_table(spark, sf_dir))


@query
def stratified_folds(spark, sf_dir):
    return sampling.stratified_folds(_label_table(spark, sf_dir))


@query
def training_totals(spark, sf_dir):
    built = training.feature_pipeline().fit(fx.mail(spark, sf_dir))
    return training.training_totals(_label_table(spark, sf_dir), len(training.vector_names(built)))


# --- choosing a model --------------------------------------------------------------------------


def _candidates(spark, sf_dir):
    predictions = evaluation.candidate_predictions(fx.model_scores(spark, sf_dir))
    return evaluation.held_out_metrics(predictions), evaluation.fold_summary(predictions)


_CV = ("cv_accuracy_mean", "cv_accuracy_std", "cv_f1_macro_mean", "cv_f1_macro_std")
_CV_PUBLISHED = ("cv_accuracy_mean", "cv_accuracy_std", "cv_macro_f1_mean", "cv_macro_f1_std")


@query
def candidate_metrics(spark, sf_dir):
    held_out, training_rows = _candidates(spark, sf_dir)
    joined = selection.with_training(held_out, training_rows).drop("train_time_s")
    return _rounded(joined, "accuracy", "macro_f1", *_CV)


@query
def too_perfect(spark, sf_dir):
    return selection.ranked(*_candidates(spark, sf_dir)).select(
        "model", "suspicious", _r("selection_key").alias("selection_key"), "place"
    )


@query
def best_model(spark, sf_dir):
    return selection.best_model(*_candidates(spark, sf_dir)).select(
        "model", _r("selection_key").alias("selection_key")
    )


@query
def fallback_decision(spark, sf_dir):
    return _rounded(
        selection.fallback_decision(*_candidates(spark, sf_dir)),
        "decided_accuracy", "decided_macro_f1",
    )


@query
def fallback_gate(spark, sf_dir):
    decided = selection.fallback_decision(*_candidates(spark, sf_dir))
    given = selection.fallback_gate(decided).withColumn("report", F.lit("present"))
    missing = selection.fallback_gate(decided.filter(F.lit(False)))
    return given.unionByName(missing.withColumn("report", F.lit("missing")))


@query
def published_metrics(spark, sf_dir):
    out = selection.published_metrics(*_candidates(spark, sf_dir)).drop("train_time_s")
    return _rounded(
        out, "accuracy", "macro_f1", "held_out_accuracy", "held_out_macro_f1", *_CV_PUBLISHED
    )


@query
def model_listing(spark, sf_dir):
    out = selection.model_listing(*_candidates(spark, sf_dir))
    return _rounded(
        out, "accuracy", "macro_f1", "held_out_accuracy", "held_out_macro_f1", *_CV_PUBLISHED
    )


@query
def active_model(spark, sf_dir):
    out = selection.active_model(*_candidates(spark, sf_dir))
    return _rounded(
        out, "accuracy", "macro_f1", "held_out_accuracy", "held_out_macro_f1", *_CV_PUBLISHED
    )


# --- result store and dashboard ----------------------------------------------------------------


@query
def total_count(spark, sf_dir):
    return dashboard.total(_results(spark, sf_dir))


@query
def priority_counts(spark, sf_dir):
    return dashboard.priority_counts(_results(spark, sf_dir))


@query
def stored_priority_counts(spark, sf_dir):
    """Counts over unchecked rows, where a null group and stray names occur."""
    return dashboard.priority_counts(fx.mail_dirty(spark, sf_dir))


@query
def priority_counts_zero_filled(spark, sf_dir):
    return dashboard.priority_counts_filled(fx.mail_dirty(spark, sf_dir))


@query
def priority_scope(spark, sf_dir):
    return reduce(
        DataFrame.unionByName,
        (
            quality.with_priority(fx.mail_dirty(spark, sf_dir), p).select("id", "priority")
            for p in ("critical", "high", "normal", "low")
        ),
    )


@query
def priority_share(spark, sf_dir):
    return dashboard.priority_share(_results(spark, sf_dir))


@query
def avg_confidence(spark, sf_dir):
    return dashboard.average_confidence(_results(spark, sf_dir))


def _recent(spark, sf_dir, k):
    # Which results are newest is known before scoring; score only those.
    newest = dashboard.recent(
        fx.mail(spark, sf_dir).withColumn("created_at", F.col("date")), k
    )
    return store.to_results(scoring.score(newest)).select(
        "id", "sender", "subject", "priority", _r("confidence").alias("confidence"), "created_at"
    )


@query
def recent_10(spark, sf_dir):
    return _recent(spark, sf_dir, 10)


@query
def recent_50(spark, sf_dir):
    return _recent(spark, sf_dir, 50)


@query
def point_lookup(spark, sf_dir):
    return store.find(fx.mail(spark, sf_dir), 42).select("id", "message_id", "subject")


@query
def delete_records(spark, sf_dir):
    """Mail without the records whose labels call them toxic."""
    toxic = fx.table(spark, sf_dir, "labels").filter("toxic = 1").select(
        F.col("doc_id").alias("id")
    )
    return quality.without_deleted(fx.mail(spark, sf_dir), toxic).select("id", "message_id")


@query
def result_display(spark, sf_dir):
    ruled = rules.rule_classify(fx.mail(spark, sf_dir))
    confidence = F.get("rule_proba", F.col("rule_class"))
    millis = (F.length("body") * 3).cast("int")
    return ruled.select(
        "id",
        display.confidence_percent(confidence).alias("percent"),
        display.accuracy_band(confidence).alias("band"),
        display.body_snippet(F.col("body")).alias("snippet"),
        display.short_text(F.col("subject"), 20).alias("subject_short"),
        display.duration_text(F.when(F.col("id") % 9 != 0, millis)).alias("duration"),
        dates.display_date(F.col("date"), F.lit("2020-01-01 00:00:00").cast("timestamp_ntz"))
        .alias("shown_date"),
    )


@query
def scores_json_roundtrip(spark, sf_dir):
    """Scores to JSON text and back; every seventh text is broken and reads as empty."""
    ruled = rules.rule_classify(fx.mail(spark, sf_dir))
    text = display.to_json_text(pr.score_map(F.transform("rule_proba", lambda p: F.round(p, 6))))
    broken = ruled.select("id", F.when(F.col("id") % 7 == 0, "{oops").otherwise(text).alias("j"))
    back = display.from_json_text(F.col("j"))
    return broken.withColumn("back", back).select(
        "id", F.size("back").alias("n"), *(F.col("back")[n].alias(n) for n in M.LABELS)
    )


def _signal_maps(spark, sf_dir):
    return explain.rule_signals(fx.mail(spark, sf_dir), k=1000).select(
        "id", explain.signal_map(F.col("signals")).alias("signals")
    )


@query
def signal_map_top10(spark, sf_dir):
    top = _signal_maps(spark, sf_dir).select(
        "id", F.posexplode(display.top_signals(F.col("signals"), by_size=True))
    )
    return top.select(
        "id", (F.col("pos") + 1).alias("place"), F.col("col.key").alias("signal"),
        F.col("col.value").alias("value"),
    )


# --- sources, requests, streams ----------------------------------------------------------------


def _as_message(df: DataFrame) -> DataFrame:
    """Mail written as RFC-822 text, one ``(path, content)`` row each."""
    header = lambda name, column: F.concat(F.lit(f"{name}: "), column, F.lit("\n"))
    stamp = F.date_format("date", "d MMM yyyy HH:mm:ss")
    text = F.concat(
        header("Message-ID", F.col("message_id")), header("From", F.col("sender")),
        header("To", F.col("recipients")), header("Cc", F.col("cc")),
        header("Bcc", F.col("bcc")), header("Subject", F.col("subject")),
        header("Date", F.concat(F.coalesce(stamp, F.lit("unknown")), F.lit(" -0700"))),
        F.lit("Content-Type: text/plain; charset=utf-8\n\n"), F.col("body"),
    )
    path = F.concat(F.lit("/mail/user"), (F.col("id") % 5).cast("string"), F.lit("/"),
                    F.col("folder"), F.lit("/"), F.lpad(F.col("id").cast("string"), 12, "0"))
    return df.select(path.alias("path"), F.encode(text, "UTF-8").alias("content"))


@query
def ingest_messages(spark, sf_dir):
    """Messages composed from the mail, parsed back, labelled and measured."""
    table, _ = ingest.ingest(_as_message(fx.mail_dup(spark, sf_dir)), "/mail")
    return table.select(
        "message_id", "sender", "recipients", "cc", "bcc", "subject", "folder", "hour_of_day",
        "day_of_week", "thread_id", "priority", "priority_label", "recipient_count", "has_cc",
        "has_bcc", "is_reply", "is_forward", "subject_length", "word_count",
    )


@query
def ingest_files(spark, sf_dir):
    """The same from files in a folder, some of them with names that Spark's own sources hide."""
    root = staging_path(spark, "maildir")
    hidden = F.regexp_replace("path", "/([^/]*0)$", "/_$1")
    folder.write_folder(_as_message(fx.mail(spark, sf_dir)).withColumn("path", F.regexp_replace(hidden, "^/mail", "")), root)
    table, _ = ingest.ingest_folder(spark, root)
    return table.select(
        "message_id", "sender", "recipients", "cc", "bcc", "subject", "folder", "hour_of_day",
        "day_of_week", "thread_id", "priority", "priority_label", "recipient_count", "has_cc",
        "has_bcc", "is_reply", "is_forward", "subject_length", "word_count",
    )


#: Bodies that are no ASCII, and the charset that the message does not name.
_BODIES = (
    ("Здравствуйте, прошу прислать отчёт до пятницы.", "windows-1251"),
    ("お世話になっております。明日の会議の資料をお送りします。", "shift_jis"),
    ("您好，请在星期五之前把报告发给我，谢谢。", "gbk"),
)


@query
def ingest_encoded(spark, sf_dir):
    """Mail in charsets it does not name, in parts, and in transfer encodings."""
    text = lambda *parts: F.encode(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]), "UTF-8")
    number = F.col("id").cast("string")
    subject = F.concat(F.lit("=?utf-8?B?"), F.base64(F.encode(F.concat(F.lit("Grüße "), number), "UTF-8")), F.lit("?="))
    head = lambda kind: text("From: a@b.example\nMessage-ID: <", number, "@x>\nSubject: ", subject, f"\n{kind}\n\n")
    plain = [F.concat(head("Content-Type: text/plain"), F.unhex(F.lit(body.encode(charset).hex()))) for body, charset in _BODIES]
    joined = text(
        "--cut\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64\n\n", F.base64(F.encode(F.concat(F.lit("déjà vu "), number), "UTF-8")),
        "\n--cut\nContent-Type: text/html\n\n<p>no</p>\n--cut\nContent-Type: text/plain\nContent-Disposition: attachment\n\nno\n--cut--\n",
    )
    parts = F.concat(head("Content-Type: multipart/mixed; boundary=cut"), joined)
    quoted = F.concat(head("Content-Type: text/plain; charset=iso-8859-1\nContent-Transfer-Encoding: quoted-printable"), text("caf=E9 =\n", number))
    content = F.get(F.array(*plain, parts, quoted), (F.col("id") % 5).cast("int"))
    files = fx.mail_text(spark, sf_dir).select(F.concat(F.lit("/mail/inbox/"), number).alias("path"), content.alias("content"))
    return messages.parse_messages(files, "/mail").select("message_id", "subject", F.md5("body").alias("body"), "reject_reason")


@query
def ingest_rejects(spark, sf_dir):
    """What ingest turns away: unreadable files, and mail without sender and subject."""
    files = _as_message(
        fx.mail_dirty(spark, sf_dir).selectExpr(
            "*", "'' recipients", "'' cc", "'' bcc", "CAST(NULL AS TIMESTAMP_NTZ) date",
            "'inbox' folder",
        )
    ).withColumn("content", F.when(~F.col("path").endswith("11"), F.col("content")))
    _, rejects = ingest.ingest(files, "/mail")
    return rejects


@query
def csv_roundtrip(spark, sf_dir):
    """Mail with its line breaks through the quoted CSV sink and source."""
    path = staging_path(spark, "mail-csv")
    raw = tabular.raw_projection(
        fx.mail(spark, sf_dir).withColumn("date", F.col("date").cast("string"))
    )
    tabular.write_csv(raw, path)
    back = tabular.read_csv(spark, path, raw.schema)
    return back.select(
        "message_id", "sender", "recipients", "cc", "bcc", "subject", "folder",
        F.md5("body").alias("body"),
    )


@query
def report_roundtrip(spark, sf_dir):
    """The long report through its JSON sink."""
    path = staging_path(spark, "report")
    report = metrics.classification_report(_counts(spark, sf_dir))
    long = metrics.metrics_long(report).withColumn("model", F.lit("rule_based"))
    reports.write_long(long, path)
    return _rounded(reports.read_long(spark, path), "value")


@query
def report_nested(spark, sf_dir):
    """The report through its nested JSON form."""
    path = staging_path(spark, "nested")
    long = metrics.metrics_long(metrics.classification_report(_counts(spark, sf_dir))).withColumn("model", F.lit("rule_based"))
    reports.write_nested(long, path)
    return _rounded(reports.read_nested(spark, path), "value")


@query
def evaluation_document(spark, sf_dir):
    """What is stored about an evaluation: matrices, thresholds, places and the gate."""
    predictions = evaluation.candidate_predictions(fx.model_scores(spark, sf_dir))
    found = evaluation.evaluation_document(evaluation.held_out_metrics(predictions), evaluation.fold_summary(predictions), predictions)
    return found.select(
        "model", "place", "n_test", F.to_json("matrix").alias("matrix"), _r("accuracy").alias("accuracy"), _r("macro_f1").alias("macro_f1"),
        "accuracy_threshold", "macro_f1_threshold", "needs_fallback",
    )


def _request_rows(spark, sf_dir):
    """Requests of up to ten mails each, as JSON text."""
    mail = fx.mail_dirty(spark, sf_dir)
    one = F.struct("sender", "subject", "body")
    asked = (
        mail.groupBy(F.floor(F.col("id") / 10).cast("string").alias("request_id"))
        .agg(F.sort_array(F.collect_list(F.struct("id", one.alias("m")))).alias("e"))
        .select("request_id", F.col("e.m").alias("emails"))
    )
    # Every ninth request comes twice more: without the array, and with an empty one.
    ninth = asked.filter(F.col("request_id").cast("long") % 9 == 0)
    bare = ninth.select(F.to_json(F.struct(F.concat("request_id", F.lit("-none")).alias("request_id"))).alias("value"))
    empty = ninth.select(
        F.to_json(F.struct(F.concat("request_id", F.lit("-empty")).alias("request_id"), F.slice("emails", 1, 0).alias("emails"))).alias("value")
    )
    return asked.select(F.to_json(F.struct("request_id", "emails")).alias("value")).union(bare).union(empty)


@query
def batch_requests(spark, sf_dir):
    rows = requests.explode_requests(requests.parse_requests(_request_rows(spark, sf_dir)))
    return requests.request_totals(rows)


@query
def batch_scores(spark, sf_dir):
    """Requests exploded, the valid mails scored, the others listed with their error."""
    rows = requests.explode_requests(requests.parse_requests(_request_rows(spark, sf_dir)))
    scored = scoring.score(rows)
    valid = F.col("error").isNull()
    return scored.select(
        "request_id", "index", "error",
        F.when(valid, F.col("priority")).alias("priority"),
        F.when(valid, _r("confidence")).alias("confidence"),
    )


@query
def store_append(spark, sf_dir):
    """Scored mail appended to a partitioned store and read back."""
    path = staging_path(spark, "store")
    store.append(_results(spark, sf_dir), path)
    return store.read(spark, path).select("id", "priority", "model_used", "created_at")


@query
def store_delete(spark, sf_dir):
    """Scored mail appended, the toxic ones deleted, and every tenth of all appended again."""
    path, results = staging_path(spark, "store"), _results(spark, sf_dir)
    store.append(results.filter("id % 10 <> 0"), path)
    toxic = fx.table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id"))
    store.delete(spark, path, toxic)
    store.append(results.filter("id % 10 = 0"), path)
    return store.read(spark, path).select("id", "priority", "model_used", "created_at")


def _streamed(query_, spark, path):
    query_.awaitTermination()
    return spark.read.parquet(path)


@query
def stream_score(spark, sf_dir):
    """The mail as a stream of files, scored and appended to a store."""
    path, checkpoint = staging_path(spark, "stream-store"), staging_path(spark, "stream-state")
    arriving = fx.mail_stream(spark, sf_dir).withColumn("created_at", F.col("date"))
    scored = store.to_results(streaming.score_stream(arriving))
    stored = _streamed(streaming.write_to_store(scored, path, checkpoint), spark, path)
    return stored.select("id", "priority", _r("confidence").alias("confidence"), "model_used")


@query
def stream_counts(spark, sf_dir):
    path, checkpoint = staging_path(spark, "counts"), staging_path(spark, "counts-state")
    scored = streaming.score_stream(fx.mail_stream(spark, sf_dir))
    counts = streaming.count_stream(scored)
    streaming.write_counts(counts, path, checkpoint).awaitTermination()
    return snapshots.read(spark, path)


@query
def stream_dedup(spark, sf_dir):
    """Repeated mail in one stream, some of it undated; of each message id the first by path comes through.

    Ids whose wait the stream's own dates have not ended yet stay in the state, the undated ones among them.
    """
    path, checkpoint = staging_path(spark, "first"), staging_path(spark, "first-state")
    copies = F.when(F.col("id") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(
        F.array(F.lit(0))
    )
    arriving = (
        fx.mail_stream(spark, sf_dir)
        .withColumn("date", F.when(F.col("id") % 23 != 0, F.col("date").cast("timestamp")))
        .withColumn("seq", F.explode(copies))
        # The copy that arrives later has the earlier path.
        .withColumn("path", F.concat(F.when(F.col("seq") == 1, "a").otherwise("b"), F.col("id").cast("string")))
        .select("id", "message_id", "date", "subject", "path")
    )
    firsts = streaming.keep_first_stream(arriving)
    written = _streamed(streaming.write_files(firsts, path, checkpoint), spark, path)
    return written.select("id", "message_id", "subject", "path")


# --- trained models ----------------------------------------------------------------------------


def _training_rows(spark, sf_dir):
    mail = _labelled(spark, sf_dir)
    model = training.feature_pipeline().fit(fx.mail(spark, sf_dir))  # labels are no part of the vector
    return model, training.feature_table(mail, model)


def _summary(summary: DataFrame) -> DataFrame:
    return summary.drop("train_time_s", "confusion")


@query
def train_lr(spark, sf_dir):
    _, rows = _training_rows(spark, sf_dir)
    return _summary(training.train_and_measure("logistic_regression", training.logistic_regression(), rows, smote=True)[1])


@query
def train_rf(spark, sf_dir):
    _, rows = _training_rows(spark, sf_dir)
    return _summary(training.train_and_measure("random_forest", training.random_forest(), rows, smote=True)[1])


@query
def train_gbt(spark, sf_dir):
    _, rows = _training_rows(spark, sf_dir)
    return _summary(training.train_and_measure("xgboost", training.boosted_trees(), rows, smote=True)[1])


@query
def cv_scores(spark, sf_dir):
    _, rows = _training_rows(spark, sf_dir)
    return training.cross_validate(training.logistic_regression(), rows)


@query
def smote_counts(spark, sf_dir):
    """Class sizes before and after oversampling; the after sizes are equal."""
    _, rows = _training_rows(spark, sf_dir)
    before = rows.groupBy("priority").agg(F.count("*").alias("before"))
    after = smote.smote(rows).groupBy("priority").agg(F.count("*").alias("after"))
    return before.join(after, "priority")


@query
def feature_matrix(spark, sf_dir):
    """Width and filled positions of the assembled sparse vector."""
    from ..functions.vectors import parts

    joined = lambda mail: embeddings.join_embeddings(mail, fx.embeddings(spark, sf_dir), EMBEDDING_SIZE)
    model = training.feature_pipeline(embeddings=True).fit(joined(fx.mail(spark, sf_dir)))
    return model.transform(joined(_labelled(spark, sf_dir))).withColumn("p", parts("features")).select(
        "id", F.col("p.size").alias("width"),
        F.size(F.filter("p.values", lambda v: v != 0)).alias("filled"),
    )


@query
def lr_balance(spark, sf_dir):
    """At the minimum the shares of a class add up to its rows, since intercepts are free."""
    _, rows = _training_rows(spark, sf_dir)
    model = training.fit(training.logistic_regression(), rows)
    shares = training.predict(model, rows).select(F.posexplode("probability").alias("priority", "share"))
    return shares.groupBy("priority").agg(F.round(F.sum("share"), 2).alias("expected"))


def _meta_rows(spark, sf_dir) -> DataFrame:
    wide = features.mail_features(_labelled(spark, sf_dir))
    return VectorAssembler(inputCols=list(features.NARROW), outputCol="features").transform(wide).select("id", "priority", "features")


@query
def smote_neighbours(spark, sf_dir):
    """The five nearest mails of their class, by the columns that are no terms, of all mails of smaller classes."""
    given = materialise(_meta_rows(spark, sf_dir))
    sizes = given.groupBy("priority").agg(F.count("*").alias("n"))
    most = sizes.agg(F.max("n").alias("most"))
    small = given.join(F.broadcast(sizes.crossJoin(most).filter("n < most").select("priority")), "priority")
    rows = smote._rows(small, "priority", "id", "features")
    near = neighbours.nearest(rows, smote.MAX_NEIGHBOURS, smote._tie())
    name = rows.select("_row", F.col("_key").cast("long").alias("id"))
    found = near.join(name, "_row").select("id", F.posexplode("_near").alias("place", "x")).select("id", (F.col("place") + 1).alias("place"), F.col("x.tie").alias("neighbour"))
    return found


@query
def smote_rows(spark, sf_dir):
    """How many synthetic rows each mail gives, and how many of them take a neighbour that is not among its five nearest."""
    found = smote.drawn(_meta_rows(spark, sf_dir))
    rows, made = found
    name = rows.select("_row", F.col("_key").cast("long").alias("id"), F.col("_class").alias("priority"))
    counted = made.join(name, "_row").withColumn("far", (~F.col("_place").between(1, 5) | ~F.col("_share").between(0, 1)).cast("long"))
    return counted.groupBy("priority").agg(F.count("*").alias("made"), F.sum("far").alias("astray"), (F.max("_n") - F.min("_n") + 1 >= 1).alias("numbered"))


def _fixed_model(spark) -> PipelineModel:
    """A model with given coefficients that was saved and loaded again."""
    path, columns = staging_path(spark, "fixed"), list(features.NARROW)
    values = np.array([[((c + 1) * (j + 3)) % 7 - 3.0 for c in range(4)] for j in range(len(columns))]) / 1000
    linear = logistic.as_model(spark, np.vstack([values, [[0.0, 0.1, 0.2, 0.3]]]))
    stages = [training.MailColumns(layout="narrow"), VectorAssembler(inputCols=columns, outputCol="features"), linear]
    training.save(PipelineModel(stages=stages), path)
    return training.load(path)


@query
def row_attribution_fixed(spark, sf_dir):
    """The columns that speak most for the class that a given model predicts."""
    model = _fixed_model(spark)
    told = attribution.row_attribution(training.predict(model, fx.mail(spark, sf_dir)), model)
    top = told.select("id", F.posexplode("signals").alias("place", "s"))
    return top.select("id", (F.col("place") + 1).alias("place"), F.col("s.name").alias("name"), _r("s.weight").alias("weight")).filter("weight > 0")


@query
def unreadable_distribution(spark, sf_dir):
    """Rows without text get the stand-in distribution."""
    bare = fx.embeddings(spark, sf_dir).select("id", "embedding")
    told = rules.RulePriorityClassifier().transform(bare)
    return told.select("id", "prediction", *_spread("probability"))


@query
def score_fixed_model(spark, sf_dir):
    """Mail scored by a model with given coefficients that was saved and loaded again."""
    scored = training.predict(_fixed_model(spark), fx.mail(spark, sf_dir))
    return scored.select("id", "prediction", *[_r(F.get("probability", F.lit(c)), 5).alias(f"p{c}") for c in range(4)])


@query
def score_lr(spark, sf_dir):
    """Mail scored by a trained model that was saved and loaded again."""
    path = staging_path(spark, "model")
    built, rows = _training_rows(spark, sf_dir)
    classifier = training.fit(training.logistic_regression(), rows)
    training.save(training.scorer(built, classifier), path)
    scored = scoring.score(fx.mail(spark, sf_dir), training.load(path), "logistic_regression")
    return scored.select(
        "id", "priority", "confidence", F.size("shap_values").alias("n_signals"), "model_used"
    )


@query
def linear_attribution(spark, sf_dir):
    built, rows = _training_rows(spark, sf_dir)
    classifier = training.fit(training.logistic_regression(), rows)
    return attribution.global_attribution(rows, classifier, training.vector_names(built))


@query
def feature_importance(spark, sf_dir):
    built, rows = _training_rows(spark, sf_dir)
    forest = training.fit(training.random_forest(), rows)
    return attribution.feature_importance(spark, forest, training.vector_names(built))


class _FixedLinear:
    """A linear model with given coefficients, for results that SQL can follow."""

    def __init__(self, classes: int, width: int):
        values = [((c + 1) * (j + 3)) % 7 - 3.0 for j in range(width) for c in range(classes)]
        self.coefficientMatrix = DenseMatrix(classes, width, values)  # column by column


@query
def attribution_fixed(spark, sf_dir):
    """Global attribution of all mail under fixed coefficients."""
    columns = list(features.NARROW)
    wide = features.mail_features(_labelled(spark, sf_dir))
    # Three passes follow: the columns are computed for the first one only.
    rows = materialise(VectorAssembler(inputCols=columns, outputCol="features").transform(wide).select("id", "features"))
    found = attribution.global_attribution(rows, _FixedLinear(4, len(columns)), columns)
    # The order of addition moves the sixth digit; the shift keeps values off the border between two roundings.
    return found.withColumn("weight", _r(F.col("weight") + F.lit(3.3e-6), 4))


@query
def train_choose_score(spark, sf_dir):
    """The published models trained, the best one stored, and all mail scored by what is stored: facts of the result."""
    folder = staging_path(spark, "lifecycle")
    lifecycle.train_all(_labelled(spark, sf_dir), folder)
    scored = lifecycle.score_by_report(fx.mail(spark, sf_dir), folder)
    share = F.get(F.map_values("confidence_scores"), F.col("priority_index"))
    return scored.agg(
        F.count("*").alias("n_mails"),
        F.count_if(F.col("confidence").between(0, 1)).alias("n_confident"),
        F.count_if(F.abs(F.aggregate(F.map_values("confidence_scores"), F.lit(0.0), lambda t, x: t + x) - 1) < 1e-6).alias("n_sum_one"),
        F.count_if(F.abs(share - F.col("confidence")) < 1e-9).alias("n_own_share"),
        F.count_distinct("model_used").alias("n_models"),
    )
