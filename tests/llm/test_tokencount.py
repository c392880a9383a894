import sentencepiece

from mailgrade.llm import tokencount
from mailgrade.llm.vocabulary import resolve
from tests.llm.helpers import awkward, docs, prose


def test_same_as_the_library_on_whole_texts(spark, sf_dir):
    library = sentencepiece.SentencePieceProcessor(model_file=resolve(tokencount.VOCABULARY))
    texts = awkward() + ["  lead", "trail  ", "a  b   c", "▁▁ x", "é" * 300, prose(3, 6000)]
    texts += [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r["doc_id"]: r for r in tokencount.token_counts(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or ""))
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 4096), repr(t)[:80]


def test_empty_table(spark):
    assert tokencount.token_counts(docs(spark, [])).count() == 0


def test_cuts_are_checked_in_the_vocabulary():
    class Library:
        def get_piece_size(self):
            return 2

        def id_to_piece(self, i):
            return ["▁a", "a▁b"][i]

    assert not tokencount.cuts_are_safe(Library())
