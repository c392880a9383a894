"""Language identification: averaged hashed subword embeddings under a linear softmax.

Training is plain stochastic gradient descent in numpy over a bounded sample of labelled
snippets (``sample`` of them, ``snippet`` characters each, shared evenly among the languages;
every part of every labelled text can be drawn). Prediction reads whole texts: embedding and
softmax are linear, so their product is one row of scores per hash bucket and a document's
score is the mean over all its subwords.

The score is a probability: the temperature is fitted on held-back snippets. A document is
rejected where even its best language has a probability below ``REJECT_BELOW``, little more than
an even share among a few languages; a text that mixes two of them is kept. Null, empty and letterless texts give ``und``, score 0, and are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailgrade.llm.common import pieces

BUCKETS = 1 << 15
DIM = 16
GRAMS = (1, 2, 3, 4)
#: Labelled snippets used for training, over all languages, and their length in characters.
SAMPLE, SNIPPET = 6000, 400
EPOCHS, RATE, BATCH = 6, 0.5, 32
#: A small sample is gone through more often, until there have been so many steps.
LEAST_STEPS = 400
REJECT_BELOW = 0.35
UNKNOWN = "und"

_NO_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)
_STEP_CHARS = 400_000


def normal(text: str | None) -> str:
    """Letters in lower case, everything else as single spaces; empty if there is no letter."""
    if not _LETTER.search(text or ""):  # marks alone are no letters
        return ""
    words = _NO_LETTERS.sub(" ", text).strip().lower()
    return f" {words} "


def subwords(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Per gram length the bucket of the gram at each character (-1 if it leaves its text), plus starts and lengths."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    starts = np.cumsum(lengths) - lengths
    left = np.repeat(starts + lengths, lengths) - np.arange(len(codes))
    found, mixed = [], np.zeros(len(codes), np.uint32)
    for n in GRAMS:
        shifted = np.zeros(len(codes), np.uint32)
        shifted[: len(codes) - n + 1] = codes[n - 1 :]
        mixed = (mixed ^ shifted) * _MULTIPLIERS[n - 1]
        mixed ^= mixed >> np.uint32(15)
        bucket = ((mixed * np.uint32(0x2C1B3C6D)) >> np.uint32(17)).astype(np.int32)
        found.append(np.where(left >= n, bucket, -1))
    return found, starts, lengths


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # bucket x language, embedding times softmax weights; the last row is zero
    bias: np.ndarray
    temperature: float

    def probabilities(self, texts: list[str]) -> np.ndarray:
        """Softmax of the mean scores; a row of zeros for a text without letters."""
        out = np.zeros((len(texts), len(self.languages)))
        rows = [i for i, t in enumerate(texts) if t]
        if rows and self.languages:
            logits = _mean(self.scores, *subwords([texts[i] for i in rows])) + self.bias
            out[rows] = _softmax(logits / self.temperature)
        return out


def _mean(table: np.ndarray, found: list[np.ndarray], starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    total = table[found[0]]
    for grams in found[1:]:
        total += table[grams]
    sums = np.add.reduceat(total, starts, axis=0, dtype=np.float64)
    return sums / sum(np.maximum(lengths - n + 1, 0) for n in GRAMS)[:, None]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(texts: list[str], labels: list[str], held_back: list[bool], seed: int = 7) -> Model:
    """Train on the snippets that aren't held back; set the temperature on the others."""
    rng = np.random.default_rng(seed)
    names = sorted(set(labels))
    clean = [normal(t) for t in texts]
    usable = [i for i, t in enumerate(clean) if t]
    target = np.array([names.index(x) for x in labels])
    train = np.array([i for i in usable if not held_back[i]], dtype=np.int64)
    check = [i for i in usable if held_back[i]]
    if not names:
        return Model([], np.zeros((BUCKETS + 1, 0), np.float32), np.zeros(0), 1.0)
    embedding = rng.uniform(-1, 1, (BUCKETS + 1, DIM)).astype(np.float32) / DIM
    embedding[-1] = 0
    weights = np.zeros((DIM, len(names)), np.float32)
    bias = np.zeros(len(names))
    per_epoch = max(1, -(-len(train) // BATCH))
    epochs = max(EPOCHS, -(-LEAST_STEPS // per_epoch)) if len(train) else 0
    steps, done = max(1, epochs * per_epoch), 0
    for epoch in range(epochs):
        for chosen in np.split(rng.permutation(train), range(BATCH, len(train), BATCH)):
            if not len(chosen):
                continue
            # Short cuts of the snippets as well: short documents must be told apart too.
            cut = [clean[i] if (k + epoch) % 2 else clean[i][: int(rng.integers(8, 80))] for k, i in enumerate(chosen)]
            found, starts, lengths = subwords(cut)
            mean = _mean(embedding, found, starts, lengths).astype(np.float32)
            rate = RATE * (1 - done / steps)
            slope = _softmax(mean @ weights + bias)
            slope[np.arange(len(chosen)), target[chosen]] -= 1
            slope /= len(chosen)
            grams = np.maximum(sum(np.maximum(lengths - n + 1, 0) for n in GRAMS), 1)
            back = ((slope @ weights.T) / grams[:, None]).astype(np.float32) * np.float32(rate * len(chosen))
            row = np.repeat(np.arange(len(chosen)), lengths)
            weights -= (rate * 8) * (mean.T @ slope).astype(np.float32)
            bias -= rate * slope.sum(axis=0)
            for hits in found:
                np.subtract.at(embedding, hits, back[row])
            embedding[-1] = 0
            done += 1
    model = Model(names, (embedding @ weights).astype(np.float32), bias, 1.0)
    if check:
        truth = target[check]
        logits = _mean(model.scores, *subwords([clean[i] for i in check])) + bias
        loss = lambda t: -np.log(_softmax(logits / t)[np.arange(len(check)), truth] + 1e-12).mean()
        model.temperature = float(min(np.geomspace(0.1, 10, 41), key=loss))
    return model


def snippets(docs: DataFrame, label: str, wanted: int = SAMPLE, length: int = SNIPPET) -> DataFrame:
    """About ``wanted`` snippets in all, as many from each language, drawn by a hash of id and place.

    Returns text, label, held_back and the hash. One count per language goes to the driver.
    """
    cuts = F.ceil(F.char_length("text") / F.lit(length)).cast("int")
    rows = docs.filter(F.col(label).isNotNull() & (F.char_length("text") > 0)).select(
        F.col("doc_id"), F.col("text"), F.col(label).alias("label"), cuts.alias("cuts")
    )
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.sum("cuts").alias("n")).collect()}
    if not counts:
        return rows.select("text", "label", F.lit(True).alias("held_back"), F.lit(0).cast("long").alias("at")).limit(0)
    share = F.element_at(
        F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, wanted / len(counts) / n))]), F.col("label")
    )
    mark = lambda k: F.xxhash64(F.col("doc_id"), k)
    low = F.lit(float(-(2**63)))
    drawn = F.filter(F.sequence(F.lit(0), F.col("cuts") - 1), lambda k: (mark(k).cast("double") - low) < share * F.lit(2.0**64))
    return (
        rows.withColumn("drawn", drawn)
        .filter(F.size("drawn") > 0)
        .select(
            "label",
            (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5)) == 0).alias("held_back"),
            F.explode(F.transform("drawn", lambda k: F.struct(
                F.substring("text", k * length + 1, F.lit(length)).alias("text"), mark(k).alias("at")))).alias("s"),
        )
        .select("s.text", "label", "held_back", "s.at")
    )


def train(docs: DataFrame, label: str = "lang", wanted: int = SAMPLE) -> Model:
    """Fit on a bounded sample of ``docs``; its order, and so the model, does not depend on the partitions."""
    rows = snippets(docs, label, wanted).collect()
    rows.sort(key=lambda r: (r["at"], r["label"], r["text"]))
    return fit([r["text"] for r in rows], [r["label"] for r in rows], [r["held_back"] for r in rows])


RESULT = (
    T.StructField("lang_pred", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("rejected", T.BooleanType()),
)


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` and lang_pred, score, rejected for every row; the model's size is fixed by its parameters."""
    names = [f.name for f in RESULT]
    kept = [c for c in keep if c.lower() not in names]
    given = docs.select(*kept, *([] if "text" in kept else ["text"]))
    schema = T.StructType([given.schema[c] for c in kept] + list(RESULT))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in pieces(batch, limit=_STEP_CHARS):
                p = m.probabilities([normal(t) for t in part.column("text").to_pylist()])
                told = p.sum(axis=1) > 0
                best = p.argmax(axis=1) if p.shape[1] else np.zeros(len(p), int)
                score = p.max(axis=1, initial=0.0)
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in kept]
                    + [
                        pa.array([m.languages[b] if ok else UNKNOWN for b, ok in zip(best, told)], pa.string()),
                        pa.array(score),
                        pa.array(score < REJECT_BELOW),
                    ],
                    names=kept + names,
                )

    return given.mapInArrow(run, schema)


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of an id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


def identify(docs: DataFrame, keep: list[str], wanted: int = SAMPLE) -> DataFrame:
    """Train on rows outside the held-out third, then predict all rows."""
    held = remainder(F.col("doc_id"), 3) == 1
    learn = docs.select("doc_id", "text", "lang").filter(~held)
    return predict(docs, train(learn, wanted=wanted), keep)
