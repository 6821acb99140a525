"""Context-mixing range coder for blocks of token ids.

A block is coded as parallel lanes (contiguous runs of its ids) that share
one adaptive model and advance together, one id per lane and step, so every
step is a handful of numpy operations over all lanes. The model predicts an
id at three orders: adaptive counts of all ids (order 0), the last id seen
after the previous one (order 1) and after the previous two (order 2, a
hashed table), each candidate with a confidence. Order-1 and order-2
confidences select a set of adaptive weights, learned from how often each
order was right there; the mixture of the three predictions is the
distribution that the coder uses. Every block starts from the same reset
state and can be read alone. All arithmetic is on integers.

The coder is the range form of asymmetric numeral systems: one 64-bit state
per lane and one stream of 32-bit words for all lanes. The model runs over a
block in order, the states are then built from its last step to its first,
and reading needs no division. A slot of the mixture is a place in the
order-0 distribution and a number below the weights' total; the number names
the order that the slot belongs to, so an id's slots are its order-0 places
with the numbers of order 0 and, if it is a candidate, all places with that
candidate's numbers.
"""

from __future__ import annotations

import numpy as np

#: Order-0 mass and mixing weights; the coder's total is their product.
BASE_BITS, WEIGHT_BITS = 20, 10
TOTAL_BITS = BASE_BITS + WEIGHT_BITS
TABLE_BITS = 18
CONF_BITS = 3
LANES, LANE_IDS = 4096, 64  # at most so many lanes, at least so many ids in one
REFRESH, REWEIGH = 32, 4  # steps between renewals of the order-0 distribution and of the weights

_WEIGHTS, _SLOTS = (1 << WEIGHT_BITS) - 1, (1 << TOTAL_BITS) - 1
_CONF, _BUCKETS = (1 << CONF_BITS) - 1, 2 << 2 * CONF_BITS
_LEAST, _WORD = 1 << 31, 32  # a state is at least so much between steps; bits of a word


def _learning(conf: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mask of an entry that stays, change of its confidence): up on a hit, else halved; a weak candidate goes."""
    weak = ~hit & (conf <= 1)
    step = np.where(hit, conf < _CONF, np.where(weak, 0, -((conf + 1) >> 1)))
    return np.where(weak, 0, -1).astype(np.int32), step.astype(np.int32)


#: A step's kind: same candidates (1 bit), their confidences, whether order 2 and order 1 were right.
_KINDS = np.arange(_BUCKETS << 2)
_KEEP1, _STEP1 = _learning(_KINDS >> (2 + CONF_BITS) & _CONF, _KINDS & 1 > 0)
_KEEP2, _STEP2 = _learning(_KINDS >> 2 & _CONF, _KINDS & 2 > 0)


class _Model:
    """A table entry is a candidate and, in its low bits, its confidence (0: none seen, the candidate is id 0)."""

    def __init__(self, vocab: int, lanes: int):
        if vocab >= 1 << BASE_BITS:
            raise ValueError(f"{vocab} ids do not fit the order-0 mass")
        self.vocab = vocab
        self.counts = np.zeros(vocab, np.int64)
        self.seen = 0
        self.steps = 0
        self.order1 = np.zeros(vocab, np.int32)
        self.order2 = np.zeros(1 << TABLE_BITS, np.int32)
        self.hits = np.tile(np.array([1, 1, 2], np.int64), (_BUCKETS, 1))
        self.kinds = np.zeros(_BUCKETS << 2, np.int64)
        self.p1 = np.zeros(lanes, np.int64)
        self.hash1 = np.zeros(lanes, np.uint32)  # of the last id, and what the id before it adds
        self.hash2 = np.zeros(lanes, np.uint32)
        self.recent: list[np.ndarray] = []

    def _refresh(self) -> None:
        if self.recent:
            ids = np.concatenate(self.recent)
            self.counts += np.bincount(ids, minlength=self.vocab)
            self.seen += len(ids)
            self.recent = []
        room = (1 << BASE_BITS) - self.vocab
        share = self.counts * room // self.seen if self.seen else room // self.vocab
        self.f0 = np.full(self.vocab, 1, np.int32) + np.asarray(share, np.int32)
        self.c0 = np.cumsum(self.f0, dtype=np.int32) - self.f0
        self._id_at = None

    def _reweigh(self) -> None:
        right = self.kinds.reshape(-1, 4)
        self.hits += np.stack((right[:, 1] + right[:, 3], right[:, 2], right[:, 0]), axis=1)
        self.kinds[:] = 0
        if self.steps % 64 == 0 and self.steps:
            self.hits = np.maximum(1, self.hits - (self.hits >> 3))
        share = 1 + self.hits[:, :2] * (_WEIGHTS - 3) // self.hits.sum(axis=1)[:, None]
        share[_BUCKETS >> 1:, 1] = 0  # both candidates are the same id: its weight is the first one
        self.ends = ((share[:, 0] << WEIGHT_BITS) | (share[:, 0] + share[:, 1])).astype(np.int32)

    def id_at(self, place: np.ndarray) -> np.ndarray:
        """The ids at places of the order-0 distribution."""
        if self._id_at is None:
            names = np.arange(self.vocab, dtype=np.uint16 if self.vocab <= 1 << 16 else np.int32)
            self._id_at = np.zeros(1 << BASE_BITS, names.dtype)
            self._id_at[:int(self.f0.sum())] = np.repeat(names, self.f0)
        return self._id_at.take(place, mode="clip")

    def predict(self, n: int) -> None:
        """Set the mixture of the first ``n`` lanes: candidates and ends of their weights; renews what is due."""
        if self.steps % REWEIGH == 0 or self.steps < REWEIGH:
            self._reweigh()
        if self.steps % REFRESH == 0 or self.steps & (self.steps - 1) == 0:
            self._refresh()
        self.steps += 1
        p1 = self.p1[:n]
        self.at2 = ((self.hash1[:n] + self.hash2[:n]) >> (32 - TABLE_BITS)).astype(np.int64)
        self.e1 = self.order1.take(p1, mode="clip")
        self.e2 = self.order2.take(self.at2, mode="clip")
        self.c1, self.c2 = self.e1 >> CONF_BITS, self.e2 >> CONF_BITS
        same = (self.c1 == self.c2).astype(np.int32)
        bucket = (((same << CONF_BITS) | (self.e1 & _CONF)) << CONF_BITS) | (self.e2 & _CONF)
        self.bucket = bucket.astype(np.int64)
        ends = self.ends.take(self.bucket, mode="clip")
        self.end1, self.end2 = ends >> WEIGHT_BITS, ends & _WEIGHTS

    def update(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Learn the ids ``x``; (weight of the candidate that each id is, or 0, and where its numbers start)."""
        n = len(x)
        hit1, hit2 = self.c1 == x, self.c2 == x
        kind = (self.bucket << 2) + hit1
        kind += hit2.astype(np.int64) << 1
        self.kinds += np.bincount(kind, minlength=len(self.kinds))
        fresh = (x << CONF_BITS) | 1
        for table, at, entry, keep, step in ((self.order1, self.p1[:n], self.e1, _KEEP1, _STEP1),
                                             (self.order2, self.at2, self.e2, _KEEP2, _STEP2)):
            entry ^= fresh
            entry &= keep.take(kind, mode="clip")
            entry ^= fresh
            entry += step.take(kind, mode="clip")
            table[at] = entry
        first = self.end1 * hit1
        weight = first + (self.end2 - self.end1) * hit2
        at = x.astype(np.int64)
        self.recent.append(at)
        self.p1[:n] = at
        np.multiply(self.hash1[:n], 0x9E3779B1, out=self.hash2[:n])
        np.multiply(x.view(np.uint32), 0x85EBCA77, out=self.hash1[:n])
        return weight, self.end1 - first


def _layout(n: int) -> tuple[int, int, int]:
    """(lanes, steps, lanes of the last step): the first lanes hold one id more than the others."""
    lanes = int(min(LANES, max(1, n // LANE_IDS)))
    steps = -(-n // lanes)
    return lanes, steps, n - lanes * (steps - 1)


def encode_block(ids: np.ndarray, vocab: int) -> bytes:
    """Code ids below ``vocab``: states per lane, then the words in reading order."""
    n = len(ids)
    if not n:
        return b""
    lanes, steps, full = _layout(n)
    rows = np.zeros((steps, lanes), np.int32)
    rows[:, :full] = ids[:full * steps].reshape(full, steps).T
    rows[:-1, full:] = ids[full * steps:].reshape(lanes - full, steps - 1).T
    model = _Model(vocab, lanes)
    coded = []
    for t in range(steps):
        m = lanes if t < steps - 1 else full
        model.predict(m)
        weight, start = model.update(rows[t, :m])
        at = model.p1[:m]
        coded.append((model.f0.take(at, mode="clip"), model.c0.take(at, mode="clip"), weight, start, model.end2))
    state = np.full(lanes, _LEAST, np.int64)
    words = []
    for f0, c0, weight, start, end2 in reversed(coded):
        s = state[:len(f0)]
        w0 = (1 << WEIGHT_BITS) - end2
        plain = f0 * w0  # slots of order 0
        size = (plain + (weight << BASE_BITS)).astype(np.int64)
        out = np.flatnonzero(s >= size << (2 * _WORD - 1 - TOTAL_BITS))
        words.append(s[out].astype(np.uint32))
        s[out] >>= _WORD
        q = (s.view(np.uint64) // size.view(np.uint64)).view(np.int64)
        rank = (s - q * size).astype(np.int32)
        apart = rank >= plain
        rank -= plain * apart
        width = np.where(apart, weight, w0)
        place = (rank / width).astype(np.int32)  # exact: both are far below 2 ** 53
        number = rank - place * width + np.where(apart, start, end2)
        place += c0 * ~apart
        s[:] = (q << TOTAL_BITS) | ((place << WEIGHT_BITS) | number)
    return state.astype("<i8").tobytes() + np.concatenate(words[::-1]).astype("<u4").tobytes()


def decode_block(data: bytes, n: int, vocab: int) -> np.ndarray:
    """The ``n`` ids of a block."""
    if not n:
        return np.zeros(0, np.uint32)
    lanes, steps, full = _layout(n)
    state = np.frombuffer(data, "<i8", lanes).astype(np.int64)
    words = np.frombuffer(data, "<u4", offset=8 * lanes).astype(np.int64)
    model = _Model(vocab, lanes)
    rows = np.zeros((steps, lanes), np.int32)
    used = 0
    for t in range(steps):
        m = lanes if t < steps - 1 else full
        s = state[:m]
        model.predict(m)
        slot = s & _SLOTS
        place, number = slot >> WEIGHT_BITS, (slot & _WEIGHTS).astype(np.int32)
        apart = number < model.end2
        x = np.where(apart, np.where(number < model.end1, model.c1, model.c2), model.id_at(place))
        weight, start = model.update(x)
        at = model.p1[:m]
        w0 = (1 << WEIGHT_BITS) - model.end2
        plain = model.f0.take(at, mode="clip") * w0
        place = place.astype(np.int32)
        rank = np.where(apart, place * weight + plain - start,
                        (place - model.c0.take(at, mode="clip")) * w0 - model.end2)
        rank += number
        s >>= TOTAL_BITS
        s *= plain + (weight << BASE_BITS)
        s += rank
        rows[t, :m] = x
        low = np.flatnonzero(s < _LEAST)
        s[low] = (s[low] << _WORD) | words[used:used + len(low)]
        used += len(low)
    return np.concatenate((rows[:, :full].T.ravel(), rows[:-1, full:].T.ravel())).astype(np.uint32)
