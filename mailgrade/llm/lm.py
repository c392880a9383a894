"""Language-model scores of documents: context mixing, beside a word-unigram base line.

Learning: each task learns online from its own training texts (``mixing``). Slot counts and
refinement tables of all tasks are added up, weights are averaged by the bits they have seen.
The model has a fixed size, whatever the input; it goes through the driver as one broadcast.

Scoring: a task reads its texts once, scores them with the model, and hands the words on to
word buckets. A bucket counts its words over all training texts and returns, for each document,
the sum over its words; sums meet again by the step a document was read in. Words travel as
hashes (64 bits) packed per step and bucket, so neither the vocabulary nor the texts are in one
place. All steps of one scan belong to one job, and a task that runs again makes the same steps.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailgrade.llm import mixing
from mailgrade.llm.common import as_bytes, parts, pieces, stored

#: Slots whose counts travel together.
RANGE = 1 << 16
#: Partial sums per block of counts, before the last sum.
SALTS = 16
#: Word buckets for each shuffle partition.
FINER = 4
_STEP = 3 << 19
_TRAINING = np.uint32(1 << 31)


# ---------------------------------------------------------------- learning

_MODEL_ROW = "kind int, block int, salt int, data binary"


def _model_rows(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    kind, block, salt, data = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(kind, pa.int32()), pa.array(block, pa.int32()), pa.array(salt, pa.int32()), pa.array(data, pa.binary())],
        names=["kind", "block", "salt", "data"],
    )


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind below CONTEXTS: counts of a context's slots; the last kind: weights times bits, bits, refinement table."""
    learner = mixing.Learner()
    for batch in batches:
        for part in pieces(batch, limit=mixing.STEP):
            for data, starts, leads, _ in mixing.steps(as_bytes(part), learner.limit):
                learner.learn(mixing.pairs(data, starts, leads)[0])
    if not learner.bits:
        return
    salt = TaskContext.get().partitionId() % SALTS
    for k in range(mixing.CONTEXTS):
        rows = []
        for block in range((1 << mixing.BITS[k]) // RANGE):
            counts = np.stack(mixing.halves(learner.slots[k][block * RANGE : (block + 1) * RANGE]))
            if counts.any():
                rows.append((k, block, salt, zlib.compress(counts.astype("<i8").tobytes(), 1)))
        if rows:
            yield _model_rows(rows)
    own = np.concatenate([learner.mixer.weights.ravel().astype(np.float64) * learner.bits, [learner.bits], learner.mixer.hits.ravel()])
    yield _model_rows([(mixing.CONTEXTS, 0, salt, zlib.compress(own.astype("<f8").tobytes(), 1))])


def _added(keep_salt: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            for kind, block, salt, data in zip(*(batch.column(c).to_pylist() for c in ("kind", "block", "salt", "data"))):
                key = (kind, block, salt if keep_salt else 0)
                own = np.frombuffer(zlib.decompress(data), "<i8" if kind < mixing.CONTEXTS else "<f8")
                if key != now:
                    if now is not None:
                        yield _model_rows([(*now, zlib.compress(total.tobytes(), 1))])
                    now, total = key, own.copy()
                else:
                    total += own
        if now is not None:
            yield _model_rows([(*now, zlib.compress(total.tobytes(), 1))])

    return run


def _summed(rows: DataFrame, n: int, salted: bool) -> DataFrame:
    keys = ["kind", "block", *(["salt"] if salted else [])]
    return rows.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(_added(salted), _MODEL_ROW)


def learn(training: DataFrame) -> mixing.Mixer:
    """The model of all ``training`` texts."""
    n = parts(training.sparkSession)
    rows = training.select("text").mapInArrow(_learn, _MODEL_ROW)
    model = mixing.Mixer()
    final = _summed(_summed(rows, n, True), n, False).mapInArrow(_rounded, _MODEL_ROW)
    for r in final.collect():  # as many bytes as the model has
        data = zlib.decompress(r["data"])
        if r["kind"] < mixing.CONTEXTS:
            at = slice(r["block"] * RANGE, (r["block"] + 1) * RANGE)
            model.slots[r["kind"]][at] = np.frombuffer(data, "<i4")
        else:
            own, size = np.frombuffer(data, "<f8"), model.weights.size
            model.weights = (own[:size] / own[size]).reshape(model.weights.shape).astype(np.float32)
            model.hits = own[size + 1 :].reshape(model.hits.shape).copy()
    return model


def _rounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Final counts as the logit and level of each slot."""
    for batch in batches:
        for kind, block, data in zip(*(batch.column(c).to_pylist() for c in ("kind", "block", "data"))):
            if kind < mixing.CONTEXTS:
                zeros, ones = np.frombuffer(zlib.decompress(data), "<i8").reshape(2, RANGE)
                data = zlib.compress(mixing.packed(zeros, ones).astype("<i4").tobytes(), 1)
            yield _model_rows([(kind, block, 0, data)])


# ---------------------------------------------------------------- scoring and words

def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts one after another, A-Z in lower case, and how many each text has."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    flat, owner = pc.list_flatten(split), pc.list_parent_indices(split)
    filled = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(filled), np.bincount(owner.filter(filled).to_numpy(), minlength=len(texts))


_SCAN_ROW = "bucket int, step long, kind int, data binary"
_LISTING, _WORDS, _SUMS, _TOTALS = 0, 1, 2, 3


def _scan_rows(rows: list[tuple]) -> pa.RecordBatch:
    bucket, step, kind, data = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket, pa.int32()), pa.array(step, pa.int64()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())],
        names=["bucket", "step", "kind", "data"],
    )


def _scan(shared, buckets: int):
    """Per step one listing (documents, token counts, scores) and for each word bucket its words."""

    def scores(model: mixing.Mixer, texts: list[bytes]) -> np.ndarray:
        out = np.zeros(len(texts))
        for data, starts, leads, owners in mixing.steps(texts):
            key, segment = mixing.pairs(data, starts, leads)
            codes, unique = pd.factorize(key)
            out += np.bincount(owners[segment], model.cost(unique)[codes], len(texts))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in pieces(batch, limit=_STEP):
                texts, training = as_bytes(part), np.array(part.column("training").to_pylist(), bool)
                ids = part.column("doc_id").to_pylist()
                told = scores(shared.value, texts)
                words, sizes = words_of(part.column("text"))
                coded = words.dictionary_encode()
                codes, unique = pd.factorize(np.repeat(np.arange(len(texts)), sizes) << 32 | coded.indices.to_numpy())
                times = np.bincount(codes, minlength=len(unique)).astype(np.uint32)
                doc = unique >> 32
                # Once for each different word; the hash depends on nothing but its bytes.
                named = hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False)
                hashes = named[unique & 0xFFFFFFFF]
                bucket = (hashes >> np.uint64(32)).astype(np.int64) % buckets
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                times = np.where(training[doc], times | _TRAINING, times).astype("<u4")
                hashes, doc, times = hashes[order].astype("<u8"), doc[order].astype("<u4"), times[order]
                has_id = np.array([i is not None for i in ids])
                listing = b"".join([
                    struct.pack("<q", len(ids)), np.array([i or 0 for i in ids], "<i8").tobytes(), has_id.tobytes(),
                    (sizes + 1).astype("<i8").tobytes(), np.array([*map(len, texts)], "<i8").tobytes(), training.tobytes(), told.astype("<f8").tobytes(),
                ])
                yield _scan_rows([(step % buckets, step, _LISTING, listing)] + [
                    (b, step, _WORDS, hashes[x:y].tobytes() + doc[x:y].tobytes() + times[x:y].tobytes())
                    for b, (x, y) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if y > x
                ])
                step += 1

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket by bucket (rows come sorted) training counts of the words, then sums for each document of each step."""
    now, steps, blobs = None, [], []
    for batch in batches:
        kinds = batch.column("kind").to_numpy()
        if (kinds == _LISTING).any():
            yield batch.filter(pa.array(kinds == _LISTING))
        rest = batch.filter(pa.array(kinds == _WORDS))
        for bucket, step, data in zip(*(rest.column(c).to_pylist() for c in ("bucket", "step", "data"))):
            if bucket != now and blobs:
                yield from _count_bucket(steps, blobs)
                steps, blobs = [], []
            now = bucket
            steps.append(step)
            blobs.append(data)
    if blobs:
        yield from _count_bucket(steps, blobs)


def _count_bucket(steps: list[int], blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
    sizes = np.array([len(b) // 16 for b in blobs])
    hashes = np.concatenate([np.frombuffer(b, "<u8", n) for b, n in zip(blobs, sizes)])
    doc = np.concatenate([np.frombuffer(b, "<u4", n, 8 * n) for b, n in zip(blobs, sizes)]).astype(np.int64)
    times = np.concatenate([np.frombuffer(b, "<u4", n, 12 * n) for b, n in zip(blobs, sizes)])
    training, times = times >= _TRAINING, (times & ~_TRAINING).astype(np.int64)
    codes, unique = pd.factorize(hashes)
    count = np.bincount(codes, times * training, len(unique))
    seen = count[codes]
    names, place = np.unique(np.array(steps, np.int64), return_inverse=True)
    rows, where = pd.factorize(np.repeat(place, sizes) << 32 | doc)
    sums = np.bincount(rows, times * np.log10(seen + 1), len(where))
    known = np.bincount(rows, times * (seen > 0), len(where)).astype(np.int64)
    order = np.argsort(where, kind="stable")
    where, sums, known = where[order], sums[order], known[order]
    cuts = np.r_[np.searchsorted(where >> 32, np.arange(len(names))), len(where)]
    yield _scan_rows([
        (0, int(s), _SUMS, (where[x:y] & 0xFFFFFFFF).astype("<u4").tobytes() + sums[x:y].astype("<f8").tobytes() + known[x:y].astype("<u4").tobytes())
        for s, x, y in zip(names, cuts[:-1].tolist(), cuts[1:].tolist())
    ])
    yield _scan_rows([(0, -1, _TOTALS, struct.pack("<qq", int((count > 0).sum()), int(count.sum())))])


_DOC_ROW = "doc_id long, training boolean, n_tokens long, n_bytes long, n_known long, logs double, score double, vocabulary long, total long"


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document (rows arrive sorted by step, the listing first); totals pass through."""
    state: list = []

    def table(ids, training, tokens, size, known, logs, scores, vocabulary=None, total=None) -> pa.RecordBatch:
        n = len(ids)
        arrays = [ids, training, tokens, size, known, logs, scores, pa.array([vocabulary] * n, pa.int64()), pa.array([total] * n, pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in _DOC_ROW.split(", ")])

    def flush() -> pa.RecordBatch:
        raw, logs, known = state
        n = struct.unpack_from("<q", raw)[0]
        ids, at = np.frombuffer(raw, "<i8", n, 8), 8 + 8 * n
        has_id, at = np.frombuffer(raw, np.bool_, n, at), at + n
        tokens, at = np.frombuffer(raw, "<i8", n, at), at + 8 * n
        size, at = np.frombuffer(raw, "<i8", n, at), at + 8 * n
        training, at = np.frombuffer(raw, np.bool_, n, at), at + n
        return table(pa.array(ids, mask=~has_id), pa.array(training), pa.array(tokens), pa.array(size), pa.array(known), pa.array(logs), pa.array(np.frombuffer(raw, "<f8", n, at)))

    for batch in batches:
        for kind, data in zip(batch.column("kind").to_pylist(), batch.column("data").to_pylist()):
            if kind == _TOTALS:
                v, n = struct.unpack("<qq", data)
                yield table(*(pa.nulls(1, t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())), v, n)
            elif kind == _LISTING:
                if state:
                    yield flush()
                n = struct.unpack_from("<q", data)[0]
                state[:] = [data, np.zeros(n), np.zeros(n, np.int64)]
            else:
                n = len(data) // 16
                doc = np.frombuffer(data, "<u4", n)
                state[1][doc] += np.frombuffer(data, "<f8", n, 4 * n)
                state[2][doc] += np.frombuffer(data, "<u4", n, 12 * n)
    if state:
        yield flush()


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for every row of ``docs``.

    ``bits_per_byte`` is the score in bits over the text's bytes and its end. A null text is empty: its one token is the end. ``held_out`` must not be null. Without any
    training text the base line knows no word and the model is undecided on every bit.
    """
    spark = docs.sparkSession
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (~held_out).alias("training"))
    shared = spark.sparkContext.broadcast(learn(marked.filter("training")))
    n = parts(spark)
    scanned = marked.mapInArrow(_scan(shared, FINER * n), _SCAN_ROW)
    counted = scanned.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_count, _SCAN_ROW)
    gathered = counted.repartition(n, "step").sortWithinPartitions("step", "kind").mapInArrow(_gather, _DOC_ROW)
    rows = stored(gathered, "scores")
    t = rows.agg(F.sum("vocabulary").alias("v"), F.sum("total").alias("n"), F.count_if("training").alias("ends")).first()
    ends = t["ends"]
    total, vocabulary = (t["n"] or 0) + ends, (t["v"] or 0) + (ends > 0)
    base = F.col("logs") + F.lit(math.log10(ends + 1)) - F.col("n_tokens") * F.lit(math.log10(total + vocabulary + 1))
    return rows.filter(F.col("training").isNotNull()).select(
        "doc_id", (~F.col("training")).alias("held_out"), "n_tokens", (F.col("n_known") + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score",
        (F.col("score") * F.lit(-math.log2(10)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
