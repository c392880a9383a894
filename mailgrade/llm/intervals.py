"""Suffix array with names of all power-of-two substrings, and range successor on a wavelet matrix.

Both work on a batch of sequences at once; substrings of different sequences never get the same
name, so nothing matches across a border.
"""

from __future__ import annotations

import numpy as np


class Suffixes:
    """Prefix doubling that goes on only with what is still ambiguous.

    ``names[k][i]`` names the ``2**k`` codes from ``i`` on: it is the first place of their class
    in the suffix array, so the class is the interval of ``sizes[k]`` places from there. A substring
    that its sequence cuts short is a class of its own. ``shared[k]`` lists the positions of classes
    with at least two members, and ``sizes[k]`` the size of each one's class.
    """

    def __init__(self, codes: np.ndarray, lengths: np.ndarray):
        n = len(codes)
        self.ends = np.cumsum(lengths, dtype=np.int64)
        self.owner = np.repeat(np.arange(len(lengths)), lengths)
        self.start = np.repeat(self.ends - lengths, lengths)
        self.end = np.repeat(self.ends, lengths)
        key = self.owner * (int(codes.max(initial=0)) + 1) + codes
        self.array = np.argsort(key, kind="stable")
        name = np.full(n + 1, -1, np.int32)
        shared, sizes = self._classes(key[self.array], np.arange(n), self.array, name)
        self.names, self.shared, self.sizes = [name], [shared], [sizes]
        while len(shared):
            step = 1 << (len(self.names) - 1)
            old = name[shared].astype(np.int64)
            after = shared + step
            inside = after < self.end[shared]
            second = np.where(inside, name[np.minimum(after, n)].astype(np.int64) + 1, 0)
            key = old * (n + 1) + second
            order = np.argsort(key, kind="stable")
            key, place, old = key[order], shared[order], old[order]
            # The members of a class keep its places, in their new order.
            first = np.flatnonzero(np.r_[True, old[1:] != old[:-1]])
            slot = old + np.arange(len(old)) - np.repeat(first, np.diff(np.r_[first, len(old)]))
            self.array[slot] = place
            name = name.copy()
            shared, sizes = self._classes(key, slot, place, name)
            self.names.append(name)
            self.shared.append(shared)
            self.sizes.append(sizes)

    @staticmethod
    def _classes(key: np.ndarray, slot: np.ndarray, place: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Name sorted members by the first place of their class; returns those not alone, and their class sizes."""
        if not len(key):
            return place, place
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[first, len(key)])
        name[place] = np.repeat(slot[first], size)
        each = np.repeat(size, size)
        return place[each > 1], each[each > 1]

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many codes from ``i`` and from ``j`` on (``i < j``) are the same."""
        i, j, begin = i.copy(), j.copy(), i
        for k in range(len(self.names) - 1, -1, -1):
            go = np.where(self.names[k][i] == self.names[k][j], 1 << k, 0)
            i += go
            j += go
        return i - begin

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many codes before ``i`` and before ``j`` (``i < j``, same sequence) are the same."""
        low, begin = self.start[i], i
        i, j = i.copy(), j.copy()
        for k in range(len(self.names) - 1, -1, -1):
            back = 1 << k
            go = i - back >= low
            go &= self.names[k][np.maximum(i - back, 0)] == self.names[k][np.maximum(j - back, 0)]
            i -= np.where(go, back, 0)
            j -= np.where(go, back, 0)
        return begin - i


class Wavelet:
    """Wavelet matrix of whole numbers below ``2**bits``; all queries are vectors of ranges."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.zeros = bits, []
        values = values.astype(np.int32)
        for b in range(bits - 1, -1, -1):
            one = (values >> b & 1).astype(bool)
            zeros = np.zeros(len(values) + 1, np.int32)
            np.cumsum(~one, out=zeros[1:])
            self.zeros.append(zeros)
            values = np.concatenate([values[~one], values[one]])

    def below(self, low: np.ndarray, high: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many values in each range are less than ``limit``."""
        count = np.zeros(len(low), np.int64)
        for b, zeros in zip(range(self.bits - 1, -1, -1), self.zeros):
            one = (limit >> b & 1).astype(bool)
            left, right = zeros[low], zeros[high]
            count += np.where(one, right - left, 0)
            low = np.where(one, zeros[-1] + low - left, left)
            high = np.where(one, zeros[-1] + high - right, right)
        return count

    def nth(self, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The value with ``n`` smaller ones in each range."""
        value, n = np.zeros(len(low), np.int64), n.copy()
        for b, zeros in zip(range(self.bits - 1, -1, -1), self.zeros):
            left, right = zeros[low], zeros[high]
            inside = right - left
            one = n >= inside
            n -= np.where(one, inside, 0)
            value |= one.astype(np.int64) << b
            low = np.where(one, zeros[-1] + low - left, left)
            high = np.where(one, zeros[-1] + high - right, right)
        return value
