"""Small tables for the operators' tests, with every awkward case in one place."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("score", T.StringType()), T.StructField("key", T.StringType()), T.StructField("n_hit", T.StringType()),
])


def docs(spark, texts, ids=None, langs=None):
    """Documents with extra columns whose names clash with operators' own."""
    ids = list(range(len(texts))) if ids is None else ids
    langs = [None] * len(texts) if langs is None else langs
    rows = [(i, t, lang, "s", "k", "h") for i, t, lang in zip(ids, texts, langs)]
    return spark.createDataFrame(rows, DOCS)


def prose(seed, words, vocabulary=400):
    r = random.Random(seed)
    pool = ["".join(r.choice("abcdefghéñü") for _ in range(r.randint(1, 7))) for _ in range(vocabulary)]
    return " ".join(r.choice(pool) + r.choice(["", "", "", ",", ".\n"]) for _ in range(words))


def awkward():
    """Null, empty, blank, one word, ties, repeats, a very long text, marks beyond ASCII."""
    base = prose(1, 300)
    return [
        None, "", " ", "\n\n", "word", "Word", base, base, base[: len(base) // 2], base + " tail", prose(2, 60), prose(1, 20000, 3000),
        "日本語のテキスト", "a\u0000b", "x" * 5000, "ﬁ é é ▁a  b", "<|endoftext|> <s>", "it's THE end 123.4", "\t tab\r\nline ", "1234 5678",
    ]
