import hashlib

import pytest
from pyspark.sql import functions as F

from mailgrade.llm import multiset
from tests.llm.helpers import awkward, docs, prose


def prints(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    return {r["id"]: r["lanes"] for r in multiset.fingerprints(frame, ["id"]).collect()}


def test_edited_pairs_follow_the_contract(spark):
    texts = awkward()
    ids = [(11 * k) % len(texts) for k in range(len(texts))]
    got = {r["doc_id"]: r for r in multiset.edited_pairs(docs(spark, texts, ids)).collect()}
    order = sorted(zip(ids, ((t or "") for t in texts)))
    lanes = prints(spark, [t for _, t in order])
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r["lanes"] == lanes[k]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert t != after or r["near_next"] == 1
        assert t != edited or (r["near_edited"] == 1 and r["lanes"] == r["edited_lanes"])
    assert len(got) == len(texts)


def test_one_row_empty_table_repeats(spark):
    one = multiset.edited_pairs(docs(spark, ["ab cd"])).first()
    assert one["near_next"] == 1 and one["n_chars"] == 5
    assert multiset.edited_pairs(docs(spark, [])).count() == 0
    same = multiset.edited_pairs(docs(spark, ["ab cd", "ab cd", "other words here"], ids=[1, 1, None])).collect()
    assert len(same) == 3 and len({tuple(r["lanes"]) for r in same if r["doc_id"] == 1}) == 1


def test_order_insertion_and_deletion(spark):
    p = [prose(k, 30).replace("\n", " ") for k in range(4)]
    got = prints(spark, ["\n".join(p), "\n".join(p[::-1]), "\n".join(p[:3]), p[3], "", "\n".join(p[:3] + p[:1])])
    assert got[0] == got[1] != got[2] and got[0] != got[5]
    frame = spark.createDataFrame([(got[0], got[2], got[3])], "whole array<long>, three array<long>, one array<long>")
    r = frame.select(multiset.combine(F.col("three"), F.col("one")).alias("added"), multiset.combine(F.col("whole"), F.col("one"), -1).alias("less")).first()
    assert r["added"] == got[0] and r["less"] == got[2] and set(got[4]) == {0}


@pytest.mark.parametrize("share", [0.0, 0.25, 0.5, 0.75, 1.0])
def test_likeness_estimates_the_shared_part(spark, share):
    lines = [prose(100 + k, 40).replace("\n", " ") for k in range(40)]
    other = [prose(900 + k, 40).replace("\n", " ") for k in range(40)]
    n = int(40 * share)
    got = prints(spark, ["\n".join(lines), "\n".join(lines[:n] + other[n:])])
    frame = spark.createDataFrame([(got[0], got[1])], "a array<long>, b array<long>")
    assert abs(frame.select(multiset.likeness(F.col("a"), F.col("b"))).first()[0] - share) < 0.25
