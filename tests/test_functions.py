"""Scalar expressions on single values, checked against plain Python."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from mailgrade import phrases as P
from mailgrade.functions import dates, display, matching
from mailgrade.functions import mail as M
from mailgrade.functions import terms as tm
from mailgrade.operators import features


def evaluate(spark, values, build, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in frame.orderBy("i").select(build(F.col("v"))).collect()]


TEXTS = [
    "urgent important update: please review & sign-off, hr meeting at 10am", "directory of coops",
    "no reply needed! this is an automated notification", "nothing here", "", "p0 p-0 sev 1 escalate",
    "re-enrollment re-enroll due today eod today by eod", "weekly digest; monthly wrap, ad: % off",
    "if you're having trouble viewing o'clock 5pm 15pm", "asapurgent\nright\naway right away",
]


@pytest.mark.parametrize("name", ["critical", "high", "low", "distant", "near", "csuite"])
def test_matching_equals_substring_tests(spark, name):
    phrases = getattr(P.DEFAULT, name)
    texts = TEXTS + list(phrases) + [" ".join(phrases), "".join(phrases)]
    got = evaluate(spark, texts, lambda v: matching.found(v, phrases))
    for text, hits in zip(texts, got):
        assert sorted(hits) == sorted(p for p in phrases if p in text)
    some = evaluate(spark, texts, lambda v: matching.contains_any(v, phrases))
    assert some == [any(p in t for p in phrases) for t in texts]


def test_pattern_is_the_longest_phrase_at_each_place():
    phrases = P.CRITICAL + P.HIGH + P.LOW
    compiled = re.compile(matching.pattern(phrases))
    for phrase in phrases:
        assert compiled.match(phrase).group() == phrase


def test_thread_id(spark):
    subjects = ["Re: Budget", "budget", "FWD :  budget \t", "Re: Re: budget", "", "  "]
    got = evaluate(spark, subjects, lambda v: M.thread_id(v, F.lit("<0123456789abcdef>")))
    assert got[0] == got[1] == got[2] != got[3]
    assert got[4] == got[5] == "<0123456789a"


@pytest.mark.parametrize(
    "header, hour, day",
    [
        ("Mon, 14 May 2001 16:39:00 -0700 (PDT)", 16, 0), ("14 May 2001 16:39:00 +0000", 16, 0),
        ("2026-04-23T15:21", 15, 3), ("2026-04-23 15:21:05", 15, 3), ("2026-04-23", 0, 3),
        ("2026-04-23T23:21:05+02:00", 23, 3), ("Thu, 23 Apr 2026 03:04:05 GMT", 3, 3),
        ("April 23, 2026 7:08", 7, 3), ("4/23/2026 17:08", 17, 3), ("not a date", -1, -1),
        ("", -1, -1), (None, -1, -1),
    ],
)
def test_dates(spark, header, hour, day):
    moment = lambda v: F.struct(
        dates.hour_of_day(dates.local_time(v)), dates.day_of_week(dates.local_time(v))
    )
    assert tuple(evaluate(spark, [header], moment)[0]) == (hour, day)


def test_folder_from_path(spark):
    paths = ["/m/al/inbox/1.", "/m/al/a/b/2.", "file:/m/al/3.", "/m/4.", "/other/al/inbox/5."]
    got = evaluate(spark, paths, lambda v: M.folder_from_path(v, "/m/"))
    assert got == ["inbox", "a/b", "3.", "unknown", "unknown"]


def test_counts(spark):
    body = "See attached. Attachment enclosed, please find!! attachedattached end x\x1cy"
    assert evaluate(spark, [body], M.attachment_count) == [
        len(re.findall(r"(attachment|attached|please find|enclosed)", body.lower()))
    ]
    assert evaluate(spark, [body, "", "  "], M.word_count) == [len(body.split()), 0, 0]
    assert evaluate(spark, [body], M.exclamation_count) == [2]
    subjects = ["Re: more: re : x", "fw: FWD: y", "fwd :"]
    assert evaluate(spark, subjects, M.thread_depth) == [3, 2, 1]
    assert evaluate(spark, subjects, M.forward_count) == [0, 2, 0]
    assert evaluate(spark, ["", "a", "a,b", "a, b,"], M.recipient_count) == [0, 1, 2, 3]


def test_csuite(spark):
    senders = ["director@x", "cto@x", "cooper@x", "Vp.Sales@x", "ann@x"]
    assert evaluate(spark, senders, M.is_csuite) == [True, True, True, True, False]
    whole = evaluate(spark, senders, lambda v: M.is_csuite(v, whole_word=True))
    assert whole == [False, True, False, True, False]


def test_domains(spark):
    senders = ["A@Company.COM", "x@y@z.org", "nobody", ""]
    assert evaluate(spark, senders, M.sender_domain) == ["company.com", "y", "unknown", "unknown"]
    assert evaluate(spark, senders, M.store_domain) == ["Company.COM", "z.org", "nobody", ""]
    assert evaluate(spark, ["company.com"], M.domain_bucket) == [7014]
    zero = evaluate(spark, ["unknown"], lambda v: M.domain_bucket(v, missing_is_zero=True))
    assert zero == [0]


def python_words(text):
    text = "".join(
        c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c)
    )
    return re.findall(r"\b[a-zA-Z][a-zA-Z0-9]{1,}\b", text)


def test_words(spark):
    texts = [
        "Plain words, x y2k 2day under_score it's", "Crème brûlée à l'Île — naïve",
        "Straße œuvre ﬁnance ½cup ™mark ①st Ⅳth", "Ünïcödé日本語mix ключ слово éclair", "",
    ]
    assert evaluate(spark, texts, tm.words) == [python_words(t) for t in texts]
    compact = evaluate(spark, texts, lambda v: tm.words(v, compact=True))
    assert compact == [re.findall(r"\b\w\w+\b", t.lower()) for t in texts[:3]] + compact[3:]
    pairs = evaluate(spark, ["one two three"], lambda v: tm.words_and_bigrams(tm.words(v)))
    assert pairs == [["one", "two", "three", "one two", "two three"]]


def test_display(spark):
    assert evaluate(spark, ["a" * 201, "a" * 200, " \t"], display.body_snippet) == [
        "a" * 197 + "...", "a" * 200, "",
    ]
    assert evaluate(spark, [None, 5, 999, 1000, 2445, 1234567], display.duration_text, "int") == [
        "N/A", "5 ms", "999 ms", "1.00 s", "2.44 s", "1234.57 s",
    ]
    assert evaluate(spark, [0.85, 0.75, 0.65, 0.6, None], display.accuracy_band, "double") == [
        "success", "primary", "warning", "danger", "danger",
    ]
    assert evaluate(spark, [0.8765, None], display.confidence_percent, "double") == [87.6, 0.0]
    assert evaluate(spark, ['{"a":1.5}', "{bad", None], display.from_json_text) == [
        {"a": 1.5}, {}, {},
    ]


def test_narrow_layout(spark):
    rows = [[float(i) for i in range(21)], [float(i) for i in range(16)], [1.0, 2.0]]
    got = evaluate(spark, rows, features.narrow_meta, "array<double>")
    assert got[0] == [float(i) for i in (*range(10), *range(15, 21))]
    assert got[1:] == rows[1:]
    tail = evaluate(spark, [[float(i) for i in range(24)]],
                    lambda v: features.narrow_meta(v, tail=3), "array<double>")[0]
    assert tail == [float(i) for i in (*range(10), *range(15, 24))]
