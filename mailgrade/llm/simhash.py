"""SimHash near-duplicates by one-wildcard variants of a few wide segments.

A fingerprint is cut into ``k // 2 + 1`` segments for a distance of ``k`` bits, so that of two
linked fingerprints some segment differs in at most one bit. Each segment is indexed once per
bit with that bit cleared; fingerprints meet on equal variants and are verified by their whole
distance. Only distinct fingerprints are indexed, so copies cost nothing.

A variant that more than ``GROUP`` fingerprints share is not compared in one go: its members
are indexed again by the one-wildcard variants of the bits that are left, which bounds a group
by the number of values those bits can take. Within a group no pairs are written, only the
links of each member to the least one it is connected with there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailgrade.llm.common import as_bytes, parts, pieces, stored, text_key
from mailgrade.llm.components import components

SHINGLE = 3
DISTANCE = 2
#: Members of a variant that are compared without a second index.
GROUP = 8192
_BLOCK = 1 << 15


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bit i is set if it is in over half of the hashes of the word shingles, repeats included; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    hasher, joined = xxhash.xxh64_intdigest, b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(words) - shingle + 1)
    first, last = starts[:n].tolist(), (ends[shingle - 1 :] if len(words) > shingle else ends[-1:]).tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        hashes = [hasher(joined[a:b], 42) for a, b in zip(first[at : at + _BLOCK], last[at : at + _BLOCK])]
        raw = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, fp) for every row; a null text counts as empty."""
    given = docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                values = [fingerprint(t, shingle) for t in as_bytes(part)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_key"), pa.array(np.array(values, np.uint64).view(np.int64))],
                    names=["doc_id", "text_key", "fp"],
                )

    return given.mapInArrow(run, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, text_key long, fp long")


def _cut(bits: list[int], n: int) -> list[list[int]]:
    return [[int(b) for b in x] for x in np.array_split(bits, n)]


def _held(segments: list[list[int]]) -> list[tuple[int, int]]:
    """(segment, mask of its bits but one) for every segment and every bit of it."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [(k, signed(sum(1 << b for b in s if b != wild))) for k, s in enumerate(segments) for wild in s]


def _keys(segments: list[list[int]]) -> Column:
    """A key for each one-wildcard variant; its lowest three bits name the segment."""
    return F.array(*[
        F.xxhash64("key", F.lit(i), F.col("fp").bitwiseAND(F.lit(m))).bitwiseAND(F.lit(-8)).bitwiseOR(F.lit(k))
        for i, (k, m) in enumerate(_held(segments))
    ])


def variants(rows: DataFrame, segments: list[list[int]]) -> DataFrame:
    """(key, fp): the fingerprint under each of its one-wildcard variants."""
    return rows.select(F.explode(_keys(segments)).alias("key"), "fp")


def inner_variants(rows: DataFrame, segments: list[list[int]]) -> DataFrame:
    """(key, fp) anew for members that share a segment but for one bit: variants of all the other bits."""
    n = len(segments)
    others = [_keys(_cut([b for j, s in enumerate(segments) if j != k for b in s], n)) for k in range(n)]
    shared = F.col("key").bitwiseAND(F.lit(7)).cast("int")
    return rows.select(F.explode(F.element_at(F.array(*others), shared + 1)).alias("key"), "fp")


def _linked(members: np.ndarray, distance: int) -> np.ndarray:
    """For each of the sorted distinct fingerprints, the place of the first one it is connected with."""
    root = np.full(len(members), -1)
    rest = np.arange(len(members))
    while len(rest):
        seed, rest = rest[0], rest[1:]
        root[seed], front = seed, [seed]
        while front and len(rest):
            near = np.bitwise_count(members[rest] ^ members[front.pop()]) <= distance
            if near.any():
                root[rest[near]] = seed
                front.extend(rest[near].tolist())
                rest = rest[~near]
    return root


def _compare(distance: int, limit: int | None):
    """Links (kind 0: a, b) from rows sorted by key; members of too large groups come back (kind 1: key, fp)."""

    def group(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        members = np.unique(fps)
        root = _linked(members, distance)
        away = root != np.arange(len(members))
        return members[away], members[root[away]]

    def table(a, b, kind: int) -> pa.RecordBatch:
        a, b = np.asarray(a, np.uint64).view(np.int64), np.asarray(b, np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), kind, np.int32))], names=["a", "b", "kind"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.empty(0, np.uint64), np.empty(0, np.uint64)
        over = None  # the key whose members are being handed on

        def closed(keys, fps):
            cuts = np.flatnonzero(np.diff(keys)) + 1
            starts, ends = np.r_[0, cuts], np.r_[cuts, len(keys)]
            sizes = ends - starts
            two = starts[sizes == 2]
            near = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= distance]
            near = near[fps[near] != fps[near + 1]]
            found = [(np.maximum(fps[near], fps[near + 1]), np.minimum(fps[near], fps[near + 1]))]
            found += [group(fps[s:e]) for s, e in zip(starts[sizes > 2], ends[sizes > 2])]
            return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])

        for batch in batches:
            k = batch.column("key").to_numpy().view(np.uint64)
            f = batch.column("fp").to_numpy().view(np.uint64)
            if over is not None:
                same = int(np.searchsorted(k != over, True)) if (k != over).any() else len(k)
                if same:
                    yield table(k[:same], f[:same], 1)
                k, f = k[same:], f[same:]
                if not len(k):
                    continue
                over = None
            keys, fps = np.r_[keys, k], np.r_[fps, f]
            cuts = np.flatnonzero(np.diff(keys))
            last = int(cuts[-1]) + 1 if len(cuts) else 0
            if last:
                yield table(*closed(keys[:last], fps[:last]), 0)
            keys, fps = keys[last:], fps[last:]
            if limit is not None and len(keys) > limit:
                over = keys[0]
                yield table(keys, fps, 1)
                keys, fps = keys[:0], fps[:0]
        if len(keys):
            yield table(*closed(keys, fps), 0)

    return run


def _meet(rows: DataFrame, distance: int, limit: int | None) -> DataFrame:
    n = parts(rows.sparkSession)
    dealt = rows.repartition(n, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(_compare(distance, limit), "a long, b long, kind int")


def links(fps: DataFrame, distance: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """(a, b), a above b as signed numbers: enough links between distinct fingerprints to connect all within ``distance``."""
    if not 2 <= distance <= 15:
        raise ValueError("a distance of 2 to 15 bits is supported")
    segments = _cut(list(range(64)), distance // 2 + 1)
    distinct = fps.select(F.lit(0).cast("long").alias("key"), "fp").distinct()
    first = stored(_meet(variants(distinct, segments), distance, group), "near")
    again = first.filter("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    second = _meet(inner_variants(again, segments), distance, None)
    found = first.filter("kind = 0").union(second).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return found.distinct()


def _rooted(prints: DataFrame, distance: int, group: int) -> DataFrame:
    """fp, least (its least doc_id), root (the fingerprint that names its component) for every different fingerprint."""
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    near = components(links(prints, distance, group))
    return least.join(near, least.fp == near.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def survivors(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """doc_id and text_key of one row of each component: the least doc_id, and of its texts the least text_key.

    A null doc_id comes last, so it survives only where no other row of the component has an id.
    """
    prints = stored(fingerprints(docs, shingle), "prints")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")
    # The least of a fingerprint first, then of a component, so that copies are no hot key.
    each = prints.groupBy("fp").agg(F.min(order).alias("first"))
    rooted = _rooted(prints, distance, group).select(F.col("fp").alias("print"), "root")
    kept = each.join(rooted, F.col("fp") == F.col("print")).groupBy("root").agg(F.min("first").alias("first"))
    return kept.select("first.doc_id", "first.text_key")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """doc_id, fp and component_id (the least doc_id reachable) for every row of ``docs``.

    Null and empty texts have fingerprint 0 and are linked like any other. Repeated rows stay
    repeated. A null doc_id is never a component's id unless nothing else is in the component.
    """
    prints = stored(fingerprints(docs, shingle), "prints")
    rooted = _rooted(prints, distance, group)
    classes = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(classes, "root").select(F.col("fp").alias("print"), "component_id")
    return prints.join(named, F.col("fp") == F.col("print")).select("doc_id", "fp", "component_id")
