"""Best-fit packing of token sequences, improved by swap-based local search.

Tokenising runs where the texts are; only (doc, piece, start, length, checksum) is shuffled.
Pieces are dealt by a hash to groups of about ``GROUP`` each, whatever the size of the table,
and each group is packed by itself: best fit, longest first, then exchanges that move length
from the emptiest bin to fuller ones. Every exchange raises the sum of squared fills, so the
search ends; a bin that has lost all its pieces is gone. It stops early at the lower bound.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailgrade.llm.common import pieces, stored
from mailgrade.llm.vocabulary import tokenizer

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 2048
END = 0
GROUP = 16384
#: Words that a worker keeps at most; then it keeps the most used quarter.
REMEMBERED = 800_000


#: How the vocabulary marks a token that ends a word, and how many words of letters make a line.
WORD_END, LINE = "</w>", 2048
#: A mark that ends a word after a lower-case letter is always a token of its own.
_ENDING = r"(\p{Ll})([,.;:!?])([ \n]|$)"


def _words(texts: pa.Array) -> pa.ListArray:
    """Each text's words between blanks, marks that end one apart; no token spans two of them."""
    apart = pc.replace_substring_regex(texts, _ENDING, r"\1 \2\3")
    # Special tokens are looked for before anything else, so their texts stay as they are.
    apart = pc.if_else(pc.match_substring(texts, "<|"), texts, apart)
    return pc.split_pattern(pc.replace_substring(apart, "\n", " "), " ")


class Encoder:
    """Ids of texts; words between blanks are encoded once per worker, since no token spans a blank."""

    def __init__(self, vocabulary: str):
        self.library = tokenizer(vocabulary)
        self._batch = getattr(self.library, "encode_batch_fast", self.library.encode_batch)
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.last = np.array([(self.library.id_to_token(i) or "").endswith(WORD_END) for i in range(size)])
        self.number: dict[str, int] = {}
        self.starts, self.lengths, self.used = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)

    def _forget(self) -> None:
        """Keep the words used most."""
        kept = np.sort(np.argsort(-self.used, kind="stable")[: REMEMBERED // 4])
        words = list(self.number)
        lengths = self.lengths[kept]
        ends = np.cumsum(lengths)
        self.ids = self.ids[np.repeat(self.starts[kept] - (ends - lengths), lengths) + np.arange(int(lengths.sum()))]
        self.number = {words[k]: n for n, k in enumerate(kept.tolist())}
        self.starts, self.lengths, self.used = ends - lengths, lengths, self.used[kept] // 2

    def _add(self, words: list[str], lengths: np.ndarray, flat: np.ndarray) -> None:
        """Remember words with their ids one after another."""
        starts = len(self.ids) + np.cumsum(lengths) - lengths
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words))))
        self.starts, self.lengths = np.concatenate([self.starts, starts]), np.concatenate([self.lengths, lengths])
        self.used = np.concatenate([self.used, np.zeros(len(words), np.int64)])
        self.ids = np.concatenate([self.ids, flat.astype(np.uint32)])

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self._batch(words, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return lengths, np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum()))

    def _line(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters alone, encoded as one text: each ends with its only token that ends a word."""
        ids = np.array(self._batch([" ".join(words)], add_special_tokens=False)[0].ids, np.int64)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words) or not len(ids) or ends[-1] != len(ids):
            return self._each(words)
        return np.diff(np.r_[0, ends]), ids

    def _places(self, words: np.ndarray) -> np.ndarray:
        """Where the ids of known words, one after another, are."""
        lengths = self.lengths[words]
        return np.repeat(self.starts[words] - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))

    def _learn(self, new: list[str]) -> None:
        letters = [w for w in new if w.isalpha() and w.islower()]
        for at in range(0, len(letters), LINE):
            line = letters[at : at + LINE]
            self._add(line, *self._line(line))
        rest = [w for w in new if w not in self.number]
        self._add(rest, *self._each(rest))

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, each text's followed by ``end``, and how many each text has with it."""
        if len(self.number) > REMEMBERED:
            self._forget()
        cut = _words(texts)
        coded = pc.list_flatten(cut).dictionary_encode()
        # Python sees each different word of a step once.
        words = coded.dictionary.to_pylist()
        self._learn([w for w in words if w not in self.number])
        index = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))[coded.indices.to_numpy()]
        sizes = pc.list_value_length(cut).to_numpy()
        self.used += np.bincount(index, minlength=len(self.used))
        of_text = np.diff(np.r_[0, np.cumsum(self.lengths[index])][np.r_[0, np.cumsum(sizes)]])
        flat = self.ids[self._places(index)]
        out = np.full(len(flat) + len(texts), end, np.uint32)
        out[np.arange(len(flat)) + np.repeat(np.arange(len(texts)), of_text)] = flat
        return out, of_text + 1


_ENCODERS: dict[str, Encoder] = {}


def cut_pieces(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and the end id, cut at ``capacity``.

    A null or empty text is the end id alone.
    """
    given = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(vocabulary) or _ENCODERS.setdefault(vocabulary, Encoder(vocabulary))
        for batch in batches:
            for part in pieces(batch):
                ids, sizes = encoder.encode(pc.fill_null(part.column("text"), ""), END)
                ids, rows, at = memoryview(ids.astype("<u4")), [], 0
                for row, n in enumerate(sizes.tolist()):
                    for k, start in enumerate(range(0, n, capacity)):
                        piece = ids[at + start : at + min(start + capacity, n)]
                        rows.append((row, k, start, len(piece), zlib.crc32(piece)))
                    at += n
                row, k, start, length, crc = (np.array(x, np.int64) for x in zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(row)), pa.array(k.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    kind = given.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each piece: longest first, each into the fullest bin that takes it."""
    bins = np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = n = 0  # bit r is set if a bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            bins[i] = target = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, target, n = capacity, n, n + 1
            bins[i] = target
        if room > size:
            by_room[room - size].append(target)
            rooms |= 1 << (room - size)
    return bins


def local_search(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    """Exchange pieces between the emptiest bins and fuller ones while the sum of squared fills rises.

    Bins are gone through from the emptiest on, again and again, until none of them has an
    exchange left or there are as few as can be. Every exchange raises a whole number that is
    bounded, so this ends.
    """
    bins = bins.copy()
    loads = np.bincount(bins, weights=lengths).astype(np.int64)
    least = -(-int(lengths.sum()) // capacity)
    members = [set() for _ in loads]
    for i, b in enumerate(bins.tolist()):
        members[b].add(i)
    improved = True
    while improved and np.count_nonzero(loads) > least:
        improved = False
        for donor in np.argsort(loads, kind="stable").tolist():
            while 0 < loads[donor] < capacity:
                step = _exchange(lengths, bins, loads, capacity, donor, sorted(members[donor]))
                if step is None:
                    break
                given, back, target = step
                moved = int(lengths[given].sum() - lengths[back].sum())
                bins[given], bins[back] = target, donor
                members[donor] = members[donor] - set(given) | set(back)
                members[target] = members[target] - set(back) | set(given)
                loads[donor] -= moved
                loads[target] += moved
                improved = True
    return bins


def _exchange(lengths, bins, loads, capacity, donor, own):
    """(pieces given, pieces taken back, bin): the exchange that fills a bin best, or None."""
    # Only with bins at least as full as the donor: else the sum of squares would fall.
    room = np.where(loads >= loads[donor], capacity - loads, -1)
    room[donor] = -1
    if room.max(initial=-1) < 1:
        return None
    by_size: dict[int, list[int]] = {}
    for i in own:
        by_size.setdefault(int(lengths[i]), []).append(i)
    for size in sorted(by_size, reverse=True):  # a move
        fits = np.flatnonzero(room >= size)
        if len(fits):
            return [by_size[size][0]], [], int(fits[np.argmin(room[fits])])
    # What a bin could hold without one of its pieces; of equal ones the shortest piece counts.
    others = np.flatnonzero(room[bins] > 0)
    holds = room[bins[others]] + lengths[others]
    order = np.lexsort((lengths[others], holds))
    holds, others = holds[order], others[order]
    first = np.flatnonzero(np.r_[True, holds[1:] != holds[:-1]])
    holds, others = holds[first], others[first]
    # A bin has few different lengths, since they add up to its load: one for one, two for one.
    sizes = sorted(by_size)
    amounts = {x: [by_size[x][0]] for x in sizes}
    for k, x in enumerate(sizes):
        for y in sizes[k:]:
            if x != y or len(by_size[x]) > 1:
                amounts.setdefault(x + y, [by_size[x][0], by_size[y][-1]])
    best, best_left = None, None
    for amount, given in amounts.items():
        at = int(np.searchsorted(holds, amount))
        good = np.flatnonzero(lengths[others[at:]] < amount)
        if len(good):
            k = at + int(good[0])
            if best_left is None or holds[k] - amount < best_left:
                best_left, best = int(holds[k]) - amount, (given, [int(others[k])], int(bins[others[k]]))
    return best


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; bins are numbered from 0 without gaps."""
    if not len(lengths):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    bins = np.unique(local_search(lengths, best_fit(lengths, capacity), capacity), return_inverse=True)[1]
    order = np.argsort(bins, kind="stable")
    ends = np.cumsum(lengths[order])
    before = ends - lengths[order]
    first = np.r_[0, np.flatnonzero(np.diff(bins[order])) + 1]
    offsets = np.empty(len(lengths), np.int64)
    offsets[order] = before - np.repeat(before[first], np.diff(np.r_[first, len(bins)]))
    return bins, offsets


def packed(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Every piece with its sequence_id and offset.

    Rows with the same id and text are pieces of their own. Sequence numbers are unique; they
    have gaps between groups.
    """
    cut = stored(cut_pieces(docs, vocabulary, capacity), "pieces")
    groups = max(1, -(-cut.count() // group))

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece", "start", "ids_crc32"], kind="stable", ignore_index=True)
        bins, offsets = pack(rows["length"].to_numpy(), capacity)
        return rows.assign(sequence_id=rows["group"] * (1 << 32) + bins, offset=offsets).drop(columns="group")

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    dealt = cut.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("group").applyInPandas(one, schema)
