"""Words and bigrams of many texts counted at once, as arrays inside a task.

A text comes as :func:`.terms.word_text` leaves it. Words become numbers once per piece of a few
megabytes; a bigram is a pair of numbers, and only the distinct ones become text again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are counted together.
STEP_BYTES = 8 << 20
#: Words of such a text.
NARROW = r"\b[a-zA-Z][a-zA-Z0-9]+\b"
COMPACT = r"[a-z0-9_\x80-\U0010ffff]{2,}"

COUNTS = "term string, df long, cf long"
_NAMES = ["term", "df", "cf"]


@lru_cache(maxsize=2)
def _finder(compact: bool):
    return re.compile(COMPACT).findall if compact else re.compile(NARROW, re.ASCII).findall


def _pieces(texts: pa.Array) -> Iterator[pa.Array]:
    """Slices of about ``STEP_BYTES``; a text is never cut."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + STEP_BYTES, side="right")))
        yield texts.slice(at, stop - at)
        at = stop


def _found(texts: pa.Array, compact: bool) -> tuple[list[list[str]], np.ndarray]:
    """The words of each text, and the text of each word."""
    find = _finder(compact)
    words = [find(t) if t else [] for t in texts.to_pylist()]
    return words, np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))


def _counts(codes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, texts that hold it, occurrences) of each distinct code; ``owner`` never falls."""
    order = np.argsort(codes, kind="stable")
    codes, owner = codes[order], owner[order]
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else order
    new = np.r_[True, (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])] if len(codes) else order
    texts = np.add.reduceat(new.astype(np.int64), first) if len(codes) else order
    return codes[first], texts, np.diff(np.r_[first, len(codes)])


def counted(compact: bool):
    """Texts in, ``COUNTS`` of each piece out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in _pieces(batch.column(0)):
                words, owner = _found(texts, compact)
                if not len(owner):
                    continue
                coded = pa.array(chain.from_iterable(words), pa.string(), size=len(owner)).dictionary_encode()
                names, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
                inside = owner[1:] == owner[:-1]
                pairs = (codes[:-1] * len(names) + codes[1:])[inside]
                take = lambda at: names.take(pa.array(at))
                found, df, cf = _counts(codes, owner)
                yield pa.RecordBatch.from_arrays([take(found), pa.array(df), pa.array(cf)], names=_NAMES)
                found, df, cf = _counts(pairs, owner[1:][inside])
                both = pc.binary_join_element_wise(take(found // len(names)), take(found % len(names)), " ")
                yield pa.RecordBatch.from_arrays([both, pa.array(df), pa.array(cf)], names=_NAMES)

    return run


def counter(terms: list[str], compact: bool):
    """A function from texts to ``struct<indices, counts>``: which ``terms`` a text holds, and how often."""
    parts = {w: i for i, w in enumerate(dict.fromkeys(w for t in terms for w in t.split(" ")))}
    alone = np.full(len(parts) + 1, -1, np.int64)  # the last is for words of no term
    pairs = {}
    for place, term in enumerate(terms):
        first, *second = (parts[w] for w in term.split(" "))
        if second:
            pairs[first * len(parts) + second[0]] = place
        else:
            alone[first] = place
    keys = np.array(sorted(pairs), np.int64)
    places = np.array([pairs[k] for k in keys.tolist()], np.int64)

    def count(texts: pa.Array) -> pa.Array:
        indices, counts, sizes = [], [], []
        for piece in _pieces(texts):
            words, owner = _found(piece, compact)
            codes = np.fromiter((parts.get(w, -1) for w in chain.from_iterable(words)), np.int64, len(owner))
            found, of = [alone[codes]], [owner]
            if len(keys) and len(codes):
                known = np.flatnonzero((owner[1:] == owner[:-1]) & (codes[1:] >= 0) & (codes[:-1] >= 0))
                pair = codes[known] * len(parts) + codes[known + 1]
                at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
                found.append(np.where(keys[at] == pair, places[at], -1))
                of.append(owner[known])
            place, of = np.concatenate(found), np.concatenate(of)
            width = max(1, len(terms))
            cell, times = np.unique((of * width + place)[place >= 0], return_counts=True)
            indices.append(cell % width)
            counts.append(times)
            sizes.append(np.bincount(cell // width, minlength=len(piece)))
        joined = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        offsets = pa.array(np.r_[0, np.cumsum(joined(sizes))], pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(joined(x), kind)) for x, kind in ((indices, pa.int32()), (counts, pa.float64()))]
        return pa.StructArray.from_arrays(lists, names=["indices", "counts"])

    return count
