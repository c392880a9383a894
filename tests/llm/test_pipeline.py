import json

import corpus_pipeline
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from mailgrade.llm import langid, stages
from tests.llm.helpers import prose
from tests.llm.test_simhash import brute, plain
from tests.llm.test_winnow import brute as hit_by


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("sf")
    texts = [prose(k, 90) for k in range(30)]
    items = [prose(77, 30), prose(78, 30)]
    texts += [texts[3], texts[4] + " more", None, "", "123 456", prose(31, 30) + " " + " ".join(items[0].split()[4:20]), prose(32, 40) + " mail ann@host.org"]
    table = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts, "lang": ["xx"] * len(texts), "source": ["s"] * len(texts), "n_chars": [len(t or "") for t in texts]})
    pq.write_table(table, top / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([0, 1], pa.int64()), "text": items}), top / "benchmark.parquet")
    (top / "texts.json").write_text(json.dumps([texts, items]))
    return top


def test_stages_decide_as_brute_force(spark, folder):
    texts, items = json.loads((folder / "texts.json").read_text())
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = [i for i, t in enumerate(texts) if any(c.isalpha() for c in t or "")]
    steps = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(folder))
        steps.append(docs)
    assert all(s.columns == columns for s in steps[:-1])
    ids = lambda s: sorted(r["doc_id"] for r in s.select("doc_id").collect())
    assert ids(steps[0]) == kept
    roots = brute([plain(texts[i]) for i in kept], kept, 2)
    kept = [i for i, root in zip(kept, roots) if i == root]
    assert ids(steps[1]) == kept and 30 not in kept
    hits = hit_by([texts[i] for i in kept], list(enumerate(items)))
    kept = [i for i, (_, n, _) in zip(kept, hits) if not n]
    assert ids(steps[2]) == kept and len(texts) - 2 not in kept
    clean = {r["doc_id"]: r for r in steps[3].collect()}
    assert sorted(clean) == kept and "ann@host.org" not in clean[len(texts) - 1]["text"]
    assert all(clean[i]["text"] == texts[i] and clean[i]["n_chars"] == len(texts[i]) for i in kept[:-1])
    assert sorted({r["doc_id"] for r in steps[4].collect()}) == kept


def test_unlike_texts_with_null_or_equal_ids_stay(spark):
    a, b, c, d, e = (prose(k, 90) for k in range(50, 55))
    # e has id 7 like d, and a copy with a lower id; b is twice without an id; a is with and without one.
    rows = [(None, a), (3, a), (None, b), (None, b), (None, c), (7, d), (7, d), (7, e), (5, e)]
    docs = spark.createDataFrame([(i, t, "xx", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = stages.one_of_each(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert got == sorted([(3, a), (None, b), (None, c), (7, d), (5, e)], key=str)


def test_run_over_the_given_documents(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir)
    assert rows.count() > 0 and langid.UNKNOWN == "und"


def test_empty_documents(spark, folder, tmp_path):
    pq.write_table(pq.read_table(folder / "documents.parquet").slice(0, 0), tmp_path / "documents.parquet")
    pq.write_table(pq.read_table(folder / "benchmark.parquet"), tmp_path / "benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
