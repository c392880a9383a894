"""Online logistic context mixing over the bits of bytes, in numpy.

Each byte is predicted bit by bit. For every context (the last one, two and three bytes, and the
letters of the word so far) a hashed slot counts the zeros and ones that followed. The logits of
these predictions are mixed with weights chosen by a gate (how often the word and the three-byte
context were seen, and the bit's place), and the result is refined by a table of what came true
at that logit and partial byte.

Steps begin small and double, so that a task with little text learns weights as well. Learning goes online through a task's texts: a step's bits are predicted from the counts of the
steps before, the weights follow the error block by block, the refinement table takes what came
true, and only then are the step's counts added. Equal (context, byte) pairs of a step are
handled once, weighted by how often they occur.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd

CONTEXTS = 3
#: Slots of each context's table, as powers of two: two bytes, three, the word.
BITS = (20, 21, 22)
#: States of a slot: unseen, or how often seen (four steps) and whether always with one outcome.
STATES = 9
GATES = STATES * STATES * 8
CELLS = 33
#: Steps of a logit of one.
SCALE = 1024
#: Bytes handled in one step, in a task's first step, and (context, byte) pairs between two updates of the weights.
STEP, FIRST = 3 << 19, 3 << 15
BLOCK = 1 << 14
RATE = 2.0
END = 0  # follows each text

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
_BASE = np.uint64(0x100000001B3)


def steps(texts: list[bytes], limit: Callable[[], int] = lambda: STEP) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, segment starts, lead, text number of each segment) for about ``limit`` bytes at a time.

    A long text is cut after a blank where there is one; the next segment begins with the last
    three bytes before the cut as context (its lead), which are not predicted again.
    """
    parts, owners, leads, size = [], [], [], 0
    most = limit()
    for number, text in enumerate(texts):
        whole = text + bytes([END])
        at, lead = 0, 0
        while True:
            stop = len(whole)
            if stop - at > most:
                blank = max(whole.rfind(b" ", at + 4, at + most), whole.rfind(b"\n", at + 4, at + most))
                stop = blank + 1 if blank > 0 else at + most
            parts.append(whole[at - lead : stop])
            owners.append(number)
            leads.append(lead)
            size += stop - at
            if size >= most:
                yield _step(parts, owners, leads)
                parts, owners, leads, size, most = [], [], [], 0, limit()
            if stop == len(whole):
                break
            at, lead = stop, 3
    if parts:
        yield _step(parts, owners, leads)


def _step(parts, owners, leads):
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(lengths) - lengths, np.array(leads), np.array(owners)


def pairs(data: np.ndarray, starts: np.ndarray, leads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each predicted byte its context and value in 64 bits (word so far, three bytes, byte), and its segment."""
    n = len(data)
    narrow = data.astype(np.uint32)
    last = np.zeros(n, np.uint32)
    lengths = np.diff(np.r_[starts, n])
    for back in (3, 2, 1):
        moved = np.zeros(n, np.uint32)
        moved[back:] = narrow[:-back]
        for near in range(back):  # nothing comes before a segment's first byte
            moved[starts[lengths > near] + near] = 0
        last <<= np.uint32(8)
        last |= moved
    place = np.arange(n, dtype=np.int32)
    begin = np.zeros(n, np.int32)
    begin[1:] = np.where(data[:-1] <= 32, place[1:], 0)
    begin[starts] = starts
    np.maximum.accumulate(begin, out=begin)
    # The word so far as a sum of its bytes times powers by their place in it, modulo 2**64.
    place -= begin
    powers = np.cumprod(np.r_[np.uint64(1), np.full(int(place.max(initial=0)), _BASE)])
    terms = powers[place]
    terms *= narrow + np.uint32(1)
    total = np.zeros(n, np.uint64)
    np.cumsum(terms[:-1], out=total[1:])
    key = total - total[begin]
    key *= _ODD[0]
    key &= np.uint64(0xFFFFFFFF00000000)
    key |= (last.astype(np.uint64) << np.uint64(8)) | narrow
    segment = np.repeat(np.arange(len(starts)), lengths)
    if not leads.any():
        return key, segment
    told = np.arange(n) - starts[segment] >= leads[segment]
    return key[told], segment[told]


def _contexts(key: np.ndarray) -> list[np.ndarray]:
    three = (key >> np.uint64(8)) & np.uint64(0xFFFFFF)
    word = key >> np.uint64(32)
    hashed = [(c + np.uint64(1)) * _ODD[k] for k, c in enumerate((three & np.uint64(0xFFFF), three, word))]
    return [c ^ (c >> np.uint64(29)) for c in hashed]


def _slots(contexts: list[np.ndarray], node: np.ndarray) -> list[np.ndarray]:
    """Per context the slots of a partial byte."""
    step = node * _ODD[1]
    return [((c + step) * _ODD[2] >> np.uint64(64 - b)).view(np.int64) for c, b in zip(contexts, BITS)]


#: The state of a slot by how often it was seen (up to 128 times), with both outcomes and with one.
_LEVELS = np.array([(n > 0) + (n > 2) + (n > 15) + (n > 127) for n in range(129)], np.int8)
_STATE_OF = np.concatenate([_LEVELS, np.where(_LEVELS > 0, _LEVELS + 4, 0).astype(np.int8)])


def states(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """How sure a slot can be: 0 unseen, 1 to 4 by count with both outcomes, 5 to 8 with one."""
    return _STATE_OF[np.minimum(zeros + ones, 128) + 129 * (np.minimum(zeros, ones) == 0)]


#: Logarithms of small counts and a third.
_LOGS = np.log(np.arange(4096, dtype=np.float32) + np.float32(0.3))


def stretched(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    if max(zeros.max(initial=0), ones.max(initial=0)) < len(_LOGS):
        return _LOGS[ones] - _LOGS[zeros]
    third = np.float32(0.3)
    return np.log(ones.astype(np.float32) + third) - np.log(zeros.astype(np.float32) + third)


@dataclass
class Mixer:
    """Weights and refinement table; the slots' logits and levels once counts are final.

    ``slots`` holds a logit in steps of ``1 / SCALE`` above eight bits of level, so that one fetch
    gives both.
    """

    weights: np.ndarray = field(default_factory=lambda: np.full((CONTEXTS, GATES), 0.45, np.float32))
    hits: np.ndarray = field(default_factory=lambda: np.zeros((256 * CELLS, 2)))
    slots: list[np.ndarray] = field(default_factory=lambda: [np.zeros(1 << b, np.int32) for b in BITS])

    def refined(self) -> np.ndarray:
        centre = 1 / (1 + np.exp(-(np.arange(CELLS) - CELLS // 2) / 2.0))
        prior = np.tile(centre, 256)
        return ((self.hits[:, 1] + 20 * prior) / (self.hits.sum(axis=1) + 20)).astype(np.float32)

    def _mix(self, inputs, gate):
        z = inputs[0] * self.weights[0][gate]
        for x, w in zip(inputs[1:], self.weights[1:]):
            z += x * w[gate]
        return z

    @staticmethod
    def _cell(z, node):
        return node.astype(np.int64) * CELLS + np.clip(np.rint(z * 2), -(CELLS // 2), CELLS // 2).astype(np.int64) + CELLS // 2

    def cost(self, key: np.ndarray) -> np.ndarray:
        """log10 probability of each pair's byte in its context."""
        product, byte, contexts, refined = np.ones(len(key)), key & np.uint64(0xFF), _contexts(key), self.refined()
        step = np.float32(1 / SCALE)
        for t in range(8):
            node = (np.uint64(1) << np.uint64(t)) | (byte >> np.uint64(8 - t))
            bit = ((byte >> np.uint64(7 - t)) & np.uint64(1)).astype(bool)
            found = [self.slots[k][s] for k, s in enumerate(_slots(contexts, node))]
            inputs = [(x >> 8).astype(np.float32) * step for x in found]
            gate = ((found[2] & 0xFF) * STATES + (found[1] & 0xFF)) * 8 + t
            z = self._mix(inputs, gate)
            p = 0.5 / (1 + np.exp(-np.clip(z, -30, 30))) + 0.5 * refined[self._cell(z, node)]
            product *= np.clip(np.where(bit, p, 1 - p), 1e-9, 1.0)
        return np.log10(product)


def packed(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logit and level of each slot in one number."""
    return np.rint(stretched(zeros, ones) * SCALE).astype(np.int32) << 8 | states(zeros, ones)


def halves(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (packed & 0xFFFFFFFF).astype(np.int32), (packed >> 32).astype(np.int32)


class Learner:
    """A task's counts, weights and refinement table, learned online."""

    def __init__(self):
        #: Zeros of a slot in the low half, ones in the high half, so that both are fetched at once.
        self.slots = [np.zeros(1 << b, np.int64) for b in BITS]
        self.mixer = Mixer()
        self.bits = self.taken = 0

    @property
    def counts(self) -> list[np.ndarray]:
        """Zeros and ones of all slots, by context."""
        return [np.stack(halves(x)) for x in self.slots]

    def limit(self) -> int:
        """Bytes of the next step."""
        self.taken += 1
        return min(STEP, FIRST << (self.taken - 1))

    def learn(self, key: np.ndarray) -> None:
        codes, unique = pd.factorize(key)
        times = np.bincount(codes).astype(np.float32)
        # Mixed up, so that each block is like the whole step: rare pairs come last in the text.
        mixed = np.random.default_rng(len(unique)).permutation(len(unique))
        for at in range(0, len(unique), BLOCK):
            own = mixed[at : at + BLOCK]
            self._block(unique[own], times[own])
        byte, contexts, whole = unique & np.uint64(0xFF), _contexts(unique), times.astype(np.int64)
        for t in range(8):
            node = (np.uint64(1) << np.uint64(t)) | (byte >> np.uint64(8 - t))
            bit = ((byte >> np.uint64(7 - t)) & np.uint64(1)).astype(bool)
            amount = np.where(bit, whole << 32, whole)
            for k, slot in enumerate(_slots(contexts, node)):
                np.add.at(self.slots[k], slot, amount)
        self.bits += 8 * len(key)

    def _block(self, key: np.ndarray, times: np.ndarray) -> None:
        m, byte, contexts = self.mixer, key & np.uint64(0xFF), _contexts(key)
        for t in range(8):
            node = (np.uint64(1) << np.uint64(t)) | (byte >> np.uint64(8 - t))
            bit = ((byte >> np.uint64(7 - t)) & np.uint64(1)).astype(np.float32)
            inputs, seen = [], []
            for k, slot in enumerate(_slots(contexts, node)):
                zeros, ones = halves(self.slots[k][slot])
                inputs.append(stretched(zeros, ones))
                seen.append((zeros, ones))
            gate = (states(*seen[2]).astype(np.int64) * STATES + states(*seen[1])) * 8 + t
            z = m._mix(inputs, gate)
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            cells = m._cell(z, node)
            m.hits += np.bincount(2 * cells + (bit > 0), times, 2 * len(m.hits)).reshape(-1, 2)
            wrong = times * (bit - p)
            for k in range(CONTEXTS):
                slope = np.bincount(gate, wrong * inputs[k], GATES)
                size = np.bincount(gate, times * inputs[k] ** 2, GATES)
                m.weights[k] += RATE * slope / (size + 10.0)
