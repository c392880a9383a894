import re

import pytest
from pyspark.sql import functions as F

from mailgrade.llm import winnow
from tests.llm.helpers import awkward, docs, prose

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(texts, items):
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for k, (item_id, item) in enumerate(items):
            i = words(item)
            if not i:
                continue
            span = min(10, len(i))
            windows = {tuple(i[a : a + span]) for a in range(len(i) - span + 1)}
            for a in range(len(w) - span + 1):
                if tuple(w[a : a + span]) in windows:
                    hit.update(range(a, a + span))
                    found.add(item_id)
        out.append((len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return out


def table(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


@pytest.fixture(scope="module")
def case():
    items = [(k, prose(50 + k, n)) for k, n in enumerate([40, 12, 10, 9, 3, 1, 25])]
    items += [(7, None), (8, ""), (9, "..."), (2, items[0][1]), (None, prose(70, 15)), (11, "THE END of é " * 5)]
    get = lambda k, a, b: " ".join((items[k][1] or "").split()[a:b])
    texts = awkward() + [
        "so " + get(0, 5, 15) + " on", get(0, 5, 14), get(0, 0, 40) + " x " + get(0, 10, 30), get(1, 0, 12).upper(), get(2, 0, 10), get(3, 0, 9),
        get(4, 0, 3) + " " + get(5, 0, 1), get(6, 3, 20) + "!" + get(6, 3, 20), "the end, of é the end of é the end of é the", get(11, 0, 12),
        prose(8, 3000) + " " + get(0, 2, 25) + " " + prose(9, 200),
    ]
    return texts, items


def test_same_as_brute_force(spark, case):
    texts, items = case
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["item_ids"]) for r in winnow.contamination(docs(spark, texts), table(spark, items)).collect()}
    want = brute(texts, items)
    assert [got[i] for i in range(len(texts))] == want
    assert sum(n > 0 for _, n, _ in want) >= 8


def test_repeated_rows_null_ids_and_empty_tables(spark, case):
    texts, items = case
    found = winnow.contamination(docs(spark, [texts[-1]] * 3, ids=[None, 5, 5]), table(spark, items)).collect()
    assert len(found) == 3 and len({(r["n_words"], r["n_hit"]) for r in found}) == 1 and found[0]["n_hit"] > 20
    assert winnow.contamination(docs(spark, []), table(spark, items)).count() == 0
    assert winnow.contamination(docs(spark, texts), table(spark, [])).agg(F.sum("n_hit")).first()[0] == 0


def test_without_broadcast(spark, case, monkeypatch):
    texts, items = case
    monkeypatch.setattr(winnow, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(winnow, "BROADCAST_WORDS", 0)
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["item_ids"]) for r in winnow.contamination(docs(spark, texts), table(spark, items)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, items)
