from pyspark.sql import functions as F

from mailgrade.llm import langid
from tests.llm.helpers import awkward, docs

WORDS = {"aa": "the and of thing with", "bb": "der und ist keit ung", "cc": "le la des eau ment"}


def made(n=40):
    return [(f"{w} " * (3 + i % 5), lang) for i in range(n) for lang, w in WORDS.items()]


def test_held_out_accuracy_and_awkward_texts(spark):
    labelled = made()
    texts, langs = [t for t, _ in labelled] + awkward(), [x for _, x in labelled] + [None] * len(awkward())
    got = {r["doc_id"]: r for r in langid.identify(docs(spark, texts, langs=langs), ["doc_id"]).collect()}
    assert len(got) == len(texts)
    assert all(got[i]["lang_pred"] == lang and not got[i]["rejected"] for i, (_, lang) in enumerate(labelled))
    for i, t in enumerate(texts):
        letterless = not any(c.isalpha() for c in t or "")
        assert (got[i]["lang_pred"] == "und") == letterless and 0 <= got[i]["score"] <= 1
        assert not letterless or got[i]["rejected"]


def test_empty_table_and_no_labels(spark):
    assert langid.identify(docs(spark, []), ["doc_id"]).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs(spark, ["some words", None]), ["doc_id"]).collect()} == {"und"}


def test_clashing_columns_are_replaced(spark):
    got = langid.identify(docs(spark, [t for t, _ in made(5)], langs=[x for _, x in made(5)]), ["doc_id", "score", "key"])
    assert got.columns == ["doc_id", "key", "lang_pred", "score", "rejected"]


def test_shuffled_rows_give_the_same_model(spark):
    rows = docs(spark, [t for t, _ in made()], langs=[x for _, x in made()])
    a, b = langid.train(rows.repartition(3)), langid.train(rows.repartition(7))
    assert (a.scores == b.scores).all() and a.temperature == b.temperature


def test_held_out_languages_of_the_given_documents(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = langid.remainder(F.col("doc_id"), 3) == 1
    got = langid.identify(rows, ["doc_id", "lang"]).filter(held)
    right = got.filter("lang = lang_pred").count()
    assert right >= 0.95 * got.count()


def test_marks_ties_repeated_rows_and_null_ids(spark):
    labelled = made()
    texts = [t for t, _ in labelled] + ["\u0301\u0301", "\u0301 12", "the and of", "the and of", "the and of"]
    ids = [*range(len(labelled)), 900, 901, 7, 7, None]
    langs = [x for _, x in labelled] + [None] * 5
    got = langid.identify(docs(spark, texts, ids, langs), ["doc_id", "text"]).collect()
    marks = [r for r in got if r["doc_id"] in (900, 901)]
    assert [(r["lang_pred"], r["score"], r["rejected"]) for r in marks] == [("und", 0.0, True)] * 2
    same = [r for r in got if r["text"] == "the and of"]
    assert len(same) == 3 and len({(r["lang_pred"], r["score"]) for r in same}) == 1 and same[0]["lang_pred"] == "aa"
