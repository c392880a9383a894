import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from mailgrade.llm import langid, lm, mixing
from tests.llm.helpers import awkward, docs, prose


def score(spark, texts, ids=None):
    return lm.score(docs(spark, texts, ids), langid.remainder(F.col("doc_id"), 7) == 2).collect()


def test_base_line_and_counts(spark):
    texts = awkward() + [prose(k, 80, 60) for k in range(40)]
    got = {r["doc_id"]: r for r in score(spark, texts)}
    tokens = {i: [w for w in re.split(rb"[\x20\x09-\x0d]+", (t or "").encode().lower()) if w] + [None] for i, t in enumerate(texts)}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    count = Counter(w for i, x in tokens.items() if not held[i] for w in x)
    n, v = sum(count.values()), len(count)
    for i, x in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(x), sum(count[w] > 0 for w in x), n)
        assert math.isclose(r["base_score"], sum(math.log10((count[w] + 1) / (n + v + 1)) for w in x), rel_tol=1e-9)
        assert r["score"] < 0


def test_learned_language_beats_noise_and_the_uniform_code(spark):
    texts = [prose(k, 300, 60) for k in range(60)]
    rows = score(spark, texts)
    held = [r for r in rows if r["held_out"]]
    bits = -sum(r["score"] for r in held) / math.log10(2) / sum(len(texts[r["doc_id"]].encode()) for r in held)
    assert bits < 5.5
    for r in rows:
        size = len(texts[r["doc_id"]].encode()) + 1
        assert math.isclose(r["bits_per_byte"], -r["score"] / math.log10(2) / size, rel_tol=1e-9)


def test_weights_and_refinement_learn_from_little_text():
    learner = mixing.Learner()
    for data, starts, leads, _ in mixing.steps([prose(k, 400, 60).encode() for k in range(150)], learner.limit):
        learner.learn(mixing.pairs(data, starts, leads)[0])
    assert learner.taken > 2 and len(np.unique(learner.mixer.weights)) > 100
    hit = learner.mixer.hits.sum(axis=1).reshape(256, mixing.CELLS)
    assert (hit > 0).sum(axis=1).max() > 10


def plain_cost(model, context, word, value):
    """log10 probability of one byte, bit by bit, from the model's tables."""
    total = 0.0
    keys = [int(mixing._contexts(np.array([(word << 32) | (context << 8)], np.uint64))[k][0]) for k in range(mixing.CONTEXTS)]
    for t in range(8):
        node = (1 << t) | (value >> (8 - t))
        slots = [int(x[0]) for x in mixing._slots([np.array([k], np.uint64) for k in keys], np.array([node], np.uint64))]
        stretch = [float(model.slots[k][s] >> 8) / mixing.SCALE for k, s in enumerate(slots)]
        gate = (int(model.slots[2][slots[2]] & 0xFF) * mixing.STATES + int(model.slots[1][slots[1]] & 0xFF)) * 8 + t
        z = sum(x * float(w) for x, w in zip(stretch, model.weights[:, gate]))
        cell = node * mixing.CELLS + min(max(round(z * 2), -(mixing.CELLS // 2)), mixing.CELLS // 2) + mixing.CELLS // 2
        centre = 1 / (1 + math.exp(-((cell % mixing.CELLS) - mixing.CELLS // 2) / 2))
        refined = (model.hits[cell][1] + 20 * centre) / (model.hits[cell].sum() + 20)
        p = 0.5 / (1 + math.exp(-z)) + 0.5 * refined
        total += math.log10(p if value >> (7 - t) & 1 else 1 - p)
    return total


def test_scores_are_those_of_plain_code():
    learner = mixing.Learner()
    for data, starts, leads, _ in mixing.steps([prose(k, 200, 50).encode() for k in range(20)], lambda: 3000):
        learner.learn(mixing.pairs(data, starts, leads)[0])
    model = mixing.Mixer(
        learner.mixer.weights, learner.mixer.hits, [mixing.packed(*c) for c in learner.counts]
    )
    text = prose(3, 30, 50).encode()
    (data, starts, leads, _), = mixing.steps([text])
    key = mixing.pairs(data, starts, leads)[0]
    found = model.cost(key)
    for i, (k, byte) in enumerate(zip(key.tolist(), text + b"\0")):
        last = (b"\0\0\0" + text)[i : i + 3]
        assert k & 0xFF == byte and (k >> 8) & 0xFFFFFF == int.from_bytes(last, "big")
        assert math.isclose(found[i], plain_cost(model, (k >> 8) & 0xFFFFFF, k >> 32, byte), rel_tol=1e-4)


def test_probabilities_of_a_context_add_up():
    learner = mixing.Learner()
    for data, starts, leads, _ in mixing.steps([prose(k, 200, 50).encode() for k in range(5)], lambda: 3000):
        learner.learn(mixing.pairs(data, starts, leads)[0])
    model = mixing.Mixer(
        learner.mixer.weights, learner.mixer.hits, [mixing.packed(*c) for c in learner.counts]
    )
    key = (np.uint64(12345) << np.uint64(32)) | (np.uint64(0x20414243 & 0xFFFFFF) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
    assert abs((10 ** model.cost(key)).sum() - 1) < 1e-6


def test_cut_long_texts_predict_every_byte_once():
    text = prose(3, 4000).encode()
    whole = [mixing.pairs(d, s, x)[0] for d, s, x, _ in mixing.steps([text], lambda: 1 << 30)][0]
    cut = np.concatenate([mixing.pairs(d, s, x)[0] for d, s, x, _ in mixing.steps([text], lambda: 1000)])
    assert len(cut) == len(whole) == len(text) + 1 and ((cut ^ whole) & np.uint64(0xFFFFFFFF) == 0).all()
    assert (cut != whole).mean() < 0.01


def test_repeated_rows_null_ids_empty_table(spark):
    rows = score(spark, ["a b", "a b", None], ids=[5, 5, None])
    assert len(rows) == 3 and rows[0]["score"] is not None
    assert score(spark, []) == []
