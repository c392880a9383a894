"""Periodic runs of words by internal pattern matching.

A run with period q holds at least four periods, so the dyadic block of ``2**k`` words (the
largest power of two up to ``(3q + 1) / 2``) that begins first in it occurs again q words on,
still inside the run. For each block length, one window of distances belongs to it: q from
``(2 ** (k+1) - 1) / 3`` to below ``(2 ** (k+2) - 1) / 3``. A block asks for its occurrences in
that window by range successor over its interval of the suffix array. The window is shorter than
the block, so three or more occurrences form one progression, whose difference d is the block's
own period: the block and its occurrences lie in stretches of period d, and the distance of these
stretches' ends is the only candidate besides d's multiples. One or two occurrences are
candidates themselves. A block has at most three candidates, all blocks together have fewer than
three times the words. Each candidate is extended to both sides by longest common extensions and
kept if it has the length; equal stretches keep their smallest period.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from mailgrade.llm.common import pieces
from mailgrade.llm.intervals import Suffixes, Wavelet

LEAST_WORDS, LEAST_PERIODS = 6, 4


def runs(codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, period) of every run in every sequence, by begin and period."""
    empty = np.zeros(0, np.int64)
    if not len(codes):
        return empty, empty, empty
    names = Suffixes(codes, lengths)
    if len(names.shared) < 2 or not len(names.shared[1]):
        return empty, empty, empty
    wavelet = Wavelet(names.array, int(len(codes)).bit_length())
    begin, period = [], []
    for k in range(1, len(names.shared)):
        for b, q in _candidates(names, wavelet, k):
            begin.append(b)
            period.append(q)
    return _verified(names, np.concatenate(begin), np.concatenate(period))


def _candidates(names: Suffixes, wavelet: Wavelet, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    least, most = -(-((2 << k) - 1) // 3), -(-((4 << k) - 1) // 3) - 1
    block, size = names.shared[k], names.sizes[k]
    fits = ((block - names.start[block]) & ((1 << k) - 1) == 0) & (block + least + (1 << k) <= names.end[block])
    block, size = block[fits], size[fits]
    low = names.names[k][block].astype(np.int64)
    high, last = low + size, block + most
    before = wavelet.below(low, high, block + least)

    def occurrence(nth: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that have an ``nth`` occurrence in their window, and its place."""
        rows = rows[before[rows] + nth < size[rows]]
        at = wavelet.nth(low[rows], high[rows], before[rows] + nth)
        near = at <= last[rows]
        return rows[near], at[near]

    one, first = occurrence(0, np.arange(len(block)))
    yield block[one], first - block[one]
    two, second = occurrence(1, one)
    yield block[two], second - block[two]
    many, _ = occurrence(2, two)
    if len(many):
        b, f, s = block[many], first[np.searchsorted(one, many)], second[np.searchsorted(two, many)]
        d = s - f
        shift = f + names.ahead(f, f + d) - b - names.ahead(b, b + d)
        own = shift > 0
        yield b[own], shift[own]


def _verified(names: Suffixes, b: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    # A shift may lead beyond the sequence; a candidate from a window never does.
    inside = b + q < names.end[b]
    b, q = b[inside], q[inside]
    end = b + q + names.ahead(b, b + q)
    long = end - names.start[b] >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)
    b, q, end = b[long], q[long], end[long]
    begin = b - names.behind(b, b + q)
    long = end - begin >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)
    begin, end, q = begin[long], end[long], q[long]
    order = np.lexsort((q, end, begin))
    begin, end, q = begin[order], end[order], q[order]
    new = np.r_[True, (begin[1:] != begin[:-1]) | (end[1:] != end[:-1])][: len(begin)]
    begin, end, q = begin[new], end[new], q[new]
    order = np.lexsort((q, begin))
    return begin[order], end[order], q[order]


def repeated(n: int, key: str) -> np.ndarray:
    """Which original word stands at each place, once the ids that the rule names repeat their tail."""
    place = np.arange(n)
    h = crc32(key.encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        place[a:] = a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))
    return place


RESULT = T.StructType([
    T.StructField("n_runs", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("period", T.LongType()), T.StructField("exponent_milli", T.LongType()), T.StructField("runs_sha256", T.StringType()),
    T.StructField("collapsed_sha256", T.StringType()),
])


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts in a row, and how many each text has."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
    flat, owner = pc.list_flatten(split), pc.list_parent_indices(split)
    filled = pc.greater(pc.binary_length(flat), 0)
    counts = np.bincount(owner.filter(filled).to_numpy(), minlength=len(texts))
    return flat.filter(filled), counts


def _part(keys: list[str], texts: pa.Array, tails: bool) -> list[pa.Array]:
    words, counts = _words(texts)
    ends = np.cumsum(counts)
    begins = ends - counts
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    if tails:
        places = [a + repeated(int(n), key) for a, n, key in zip(begins, counts, keys)]
        codes = codes[np.concatenate(places)] if len(codes) else codes
    start, end, period = runs(codes, counts)
    kept = np.ones(len(codes) + 1, np.int64)
    kept[0] = 0
    if len(start):
        change = np.zeros(len(codes) + 1, np.int64)
        np.add.at(change, start + period, 1)
        np.add.at(change, end, -1)
        kept[1:] = np.cumsum(change[:-1]) == 0
    left = codes[kept[1:].astype(bool)]
    offsets = np.r_[0, np.cumsum(kept)[ends]] if len(ends) else np.zeros(1, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), coded.dictionary.take(pa.array(left)))
    collapsed = [hashlib.sha256(t.as_buffer()).hexdigest() for t in pc.binary_join(lists, " ")]
    owner = np.searchsorted(ends, start, side="right")
    cuts = np.searchsorted(owner, np.arange(len(counts) + 1))
    best: list[tuple | None] = []
    listed = []
    for d, (x, y) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
        own = list(zip((start[x:y] - begins[d]).tolist(), (end[x:y] - start[x:y]).tolist(), period[x:y].tolist()))
        listed.append(hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in own).encode()).hexdigest())
        top = None
        for run in own:  # in order of start and period, so that the first one wins a tie
            if top is None or run[1] * top[2] > top[1] * run[2]:
                top = run
        best.append(top)
    told = [pa.array([None if t is None else t[i] for t in best], pa.int64()) for i in range(3)]
    milli = pa.array([None if t is None else 1000 * t[1] // t[2] for t in best], pa.int64())
    return [pa.array(np.diff(cuts), pa.int64()), *told, milli, pa.array(listed, pa.string()), pa.array(collapsed, pa.string())]


def periodic_runs(docs: DataFrame, tails: bool = False) -> DataFrame:
    """``doc_id``, ``n_runs``, the run of greatest exponent, and digests of all runs and of the collapsed text.

    ``tails`` first makes the texts that a hash of the id names repeat their tail (:func:`repeated`).
    One result row for each row. A null text is empty; a text without words has no run, nulls for
    the greatest one and the digests of the empty text. A null id counts as the empty text in the
    hash. Repeated rows give equal results, and ties of exponent go to the smallest start, then
    period. A task holds about 2 MB of text at once, or one longer text whole. Columns other than
    ``doc_id`` and ``text`` are not read.
    """
    given = docs.select("doc_id", "text")
    schema = T.StructType([given.schema["doc_id"], *RESULT.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                ids = part.column("doc_id")
                keys = ["" if i is None else str(i) for i in ids.to_pylist()]
                yield pa.RecordBatch.from_arrays([ids, *_part(keys, part.column("text"), tails)], names=schema.names)

    return given.mapInArrow(run, schema)
