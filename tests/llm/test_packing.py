import zlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from mailgrade.llm import packing
from mailgrade.llm.vocabulary import resolve
from tests.llm.helpers import awkward, docs, prose


def test_pieces_and_places(spark):
    library = Tokenizer.from_file(resolve(packing.VOCABULARY))
    texts = awkward() + [prose(k, 30 + 40 * k) for k in range(20)]
    got = packing.packed(docs(spark, texts), group=16).collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        rows = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [(r["piece"], r["start"]) for r in rows] == [(k, s) for k, s in enumerate(range(0, len(ids), 2048))]
        for r in rows:
            own = ids[r["start"] : r["start"] + 2048]
            assert (r["length"], r["ids_crc32"]) == (len(own), zlib.crc32(own.tobytes()))
    gapless(got)


def test_remembered_words_give_the_librarys_ids(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 200)
    library = Tokenizer.from_file(resolve(packing.VOCABULARY))
    encoder = packing.Encoder(packing.VOCABULARY)
    texts = [t or "" for t in awkward()[:11]] + ["İ, ı. ß! Éa; it's, e\u0301, x\u0301. <|endoftext|>, a<|startoftext|>. ,. a,. ...", "b\u00a0c. d"]
    for _ in range(3):
        for k in range(0, len(texts), 4):
            ids, sizes = encoder.encode(pa.array(texts[k : k + 4]), packing.END)
            want = [library.encode(t, add_special_tokens=False).ids + [0] for t in texts[k : k + 4]]
            assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def gapless(rows):
    order = sorted(rows, key=lambda r: (r["sequence_id"], r["offset"]))
    for _, own in groupby(order, key=lambda r: r["sequence_id"]):
        at = 0
        for r in own:
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048


def test_repeated_rows_and_empty_table(spark):
    got = packing.packed(docs(spark, ["a b", "a b", None], ids=[1, 1, None])).collect()
    assert len(got) == 3 and len({r["sequence_id"] for r in got}) == 1
    gapless(got)
    assert packing.packed(docs(spark, [])).count() == 0


def test_local_search_beats_its_start():
    # Best fit, longest first, needs three bins here; an exchange of two for one empties the last.
    lengths = np.array([6, 5, 5, 4, 3, 3, 2, 2])
    start = packing.best_fit(lengths, 10)
    better = packing.local_search(lengths, start, 10)
    loads = np.bincount(better, weights=lengths)
    assert (loads <= 10).all() and (loads > 0).sum() == 3 == -(-lengths.sum() // 10)
    poor = np.arange(len(lengths))
    found = packing.local_search(lengths, poor, 10)
    loads = np.bincount(found, weights=lengths)
    assert (loads <= 10).all() and (loads > 0).sum() <= 4


def test_close_to_the_lower_bound():
    lengths = np.random.default_rng(1).integers(1, 2049, 4000)
    bins, offsets = packing.pack(lengths)
    loads = np.bincount(bins, weights=lengths)
    assert loads.max() <= 2048 and len(loads) <= 1.02 * lengths.sum() / 2048
    squares = lambda b: (np.bincount(b, weights=lengths) ** 2).sum()
    assert squares(bins) >= squares(packing.best_fit(lengths, 2048))
