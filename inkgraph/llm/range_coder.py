"""An adaptive context-mixing range coder for token ids.

A block is coded by itself: models start afresh, and a checksum covers all its bytes. Its ids are
laid out in lanes of consecutive ids that advance in step, so one pass of array operations codes an
id of every lane. The lanes have a range coder each and share the models, which they update together
after every step:

  order 2   the id last seen after the two ids before, with a count of its recent successes
  order 1   the same after one id
  order 0   adaptive frequencies of all ids

The order-2 and order-1 predictions are mixed by adaptive success rates looked up by both counts
and by whether both say the same; the rest of the probability goes to the order-0 frequencies. An
id is one arithmetic-coding step: the interval of the prediction that is right, or that of order 0
divided again by the frequencies.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 1 << 21
MAGIC = b"IKR1"
U = np.uint64
TOP, BOT = U(1 << 48), U(1 << 32)
LANES = 8192
MIN_STEPS = 64
REFRESH = 4  # steps between two refreshes of the order-0 frequencies
STEP = 32  # added to an id's frequency each time it is seen
MOST = 1 << 22  # of all frequencies together; then they are halved
HASH_BITS = 18
ONE = 1 << 16
LEAST_REST = 1 << 11  # of ONE, kept for order 0


def _layout(n: int) -> tuple[int, int]:
    """(lanes, steps) for a block of n ids."""
    lanes = max(1, min(LANES, n // MIN_STEPS))
    steps = -(-n // lanes)
    return -(-n // steps) if n else 0, steps if n else 0


class _Models:
    """A prediction is one 32-bit value, the id times 16 plus its successes (1 to 15); 0 is none."""

    def __init__(self, vocabulary: int, lanes: int):
        self.v = vocabulary
        self.counts, self.steps = np.ones(vocabulary, np.int64), 0
        self.after1, self.after2 = np.zeros(vocabulary, np.int32), np.zeros(1 << HASH_BITS, np.int32)
        self.hits2, self.seen2 = np.full(16 * 17, 0.4), np.ones(16 * 17)
        self.hits1, self.seen1 = np.full(256, 0.2), np.ones(256)
        self.a, self.b = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self._total()

    def _total(self) -> None:
        if int(self.counts.sum()) > MOST:
            self.counts = (self.counts >> 1) | 1
        self.cum = np.zeros(self.v + 1, np.int32)
        np.cumsum(self.counts, out=self.cum[1:])
        self.total = U(int(self.cum[-1]))

    def interval(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the order-0 frequencies of the ids begin, and the frequencies."""
        begin = self.cum[x]
        return begin.astype(U), (self.cum[x + 1] - begin).astype(U)

    def find(self, v: np.ndarray) -> np.ndarray:
        """The ids in whose order-0 intervals the values fall."""
        order = np.argsort(v)
        out = np.empty(len(v), np.int64)
        out[order] = np.searchsorted(self.cum, v[order], "right") - 1
        return out

    def predict(self, n: int) -> tuple[np.ndarray, ...]:
        """For the first n lanes: both predictions and their shares of ONE."""
        a, b = self.a[:n], self.b[:n]
        self.h = ((a * 0x9E3779B1 + b * 0x85EBCA6B) >> 7) & ((1 << HASH_BITS) - 1)
        self.e2, self.e1 = self.after2[self.h], self.after1[b]
        p2, p1, c2, c1 = self.e2 >> 4, self.e1 >> 4, self.e2 & 15, self.e1 & 15
        same = p1 == p2
        self.k2 = c2 * 17 + (c1 + 1) * same
        self.k1 = c1 * 16 + c2
        t2 = np.minimum(self.hits2 / self.seen2 * ONE, ONE - LEAST_REST).astype(np.int64)
        t2[:17] = 0  # no prediction
        t1 = (self.hits1 / self.seen1 * ONE).astype(np.int64)
        t1[:16] = 0
        f2 = t2[self.k2]
        f1 = (t1[self.k1] * (ONE - LEAST_REST - f2)) >> 16
        f1 *= ~same
        self.p2, self.p1, self.same = p2, p1, same
        return p2, p1, f2, f1

    def learn(self, x: np.ndarray) -> None:
        n = len(x)
        right2, right1 = x == self.p2, x == self.p1
        n2 = np.bincount(self.k2 * 2 + right2, minlength=2 * 16 * 17).reshape(-1, 2)
        self.seen2 += n2.sum(1)
        self.hits2 += n2[:, 1]
        open_ = np.flatnonzero(~(self.same | right2))
        n1 = np.bincount(self.k1[open_] * 2 + right1[open_], minlength=2 * 256).reshape(-1, 2)
        self.seen1 += n1.sum(1)
        self.hits1 += n1[:, 1]
        new = (x.astype(np.int32) << 4) | 1
        # Of lanes that meet in one context, the last in order is the one remembered.
        self.after2[self.h] = self._updated(self.e2, right2, new)
        self.after1[self.b[:n]] = self._updated(self.e1, right1, new)
        np.add.at(self.counts, x, STEP)
        self.steps += 1
        if self.steps % REFRESH == 0 or self.steps < REFRESH:
            self._total()
        self.a[:n] = self.b[:n]
        self.b[:n] = x

    @staticmethod
    def _updated(e: np.ndarray, right: np.ndarray, new: np.ndarray) -> np.ndarray:
        """One success more; or half of them, and the new id where none is left."""
        c = e & 15
        right = right & (c > 0)
        return np.where(right, e + (c < 15), np.where(c > 1, e - c + (c >> 1), new))


def _compress(ids: np.ndarray, vocabulary: int) -> bytes:
    lanes, steps = _layout(len(ids))
    model = _Models(vocabulary, lanes)
    low, rng = np.zeros(lanes, U), np.full(lanes, np.iinfo(U).max, U)
    room = 4 * steps + 4
    out, pos = np.zeros(lanes * room, np.uint16), np.arange(lanes) * room
    by_step = np.zeros(lanes * steps, np.int32)
    by_step[: len(ids)] = ids
    by_step = np.ascontiguousarray(by_step.reshape(lanes, steps).T)
    for s in range(steps):
        n = -(-(len(ids) - s) // steps)
        x = by_step[s, :n]
        p2, p1, f2, f1 = model.predict(n)
        two = (x == p2) & (f2 > 0)
        one = (x == p1) & (f1 > 0) & ~two
        j = np.flatnonzero(~(two | one))
        base, part = np.where(two, 0, f2), np.where(two, f2, f1)
        both = f2[j] + f1[j]
        base[j], part[j] = both, ONE - both
        r = rng[:n] >> U(16)
        lo, g = low[:n] + r * base.view(U), r * part.view(U)
        r = g[j] // model.total
        begin, wide = model.interval(x[j])
        lo[j] += r * begin
        g[j] = r * wide
        k = np.flatnonzero(((lo ^ (lo + g)) < TOP) | (g < BOT))
        while len(k):
            lk, gk = lo[k], g[k]
            gk = np.where((lk ^ (lk + gk)) >= TOP, (U(0) - lk) & (BOT - U(1)), gk)
            out[pos[k]] = lk >> U(48)
            pos[k] += 1
            lk, gk = lk << U(16), gk << U(16)
            lo[k], g[k] = lk, gk
            k = k[((lk ^ (lk + gk)) < TOP) | (gk < BOT)]
        low[:n], rng[:n] = lo, g
        model.learn(x)
    end = (low + (BOT - U(1))) >> U(32)  # two words decide: the range is at least BOT
    for shift in (16, 0):
        out[pos] = (end >> U(shift)) & U(0xFFFF)
        pos += 1
    size = pos - np.arange(lanes) * room
    used = np.arange(room) < size[:, None]
    return size.astype("<u2").tobytes() + out.reshape(lanes, room)[used].astype("<u2").tobytes()


def _expand(data: bytes, n_ids: int, vocabulary: int) -> np.ndarray:
    lanes, steps = _layout(n_ids)
    size = np.frombuffer(data, "<u2", lanes).astype(np.int64)
    words = np.concatenate([np.frombuffer(data, "<u2", offset=2 * lanes), np.zeros(4, "<u2")]).astype(U)
    begin = np.concatenate([[0], np.cumsum(size)])
    end, pos = begin[1:], begin[:-1].copy()
    if begin[-1] + 4 != len(words):
        raise ValueError("the lanes' lengths don't add up")

    def take(k: np.ndarray) -> np.ndarray:
        at = pos[k]
        pos[k] += 1
        return np.where(at < end[k], words[np.minimum(at, len(words) - 1)], U(0))

    every = np.arange(lanes)
    code = np.zeros(lanes, U)
    for _ in range(4):
        code = (code << U(16)) | take(every)
    model = _Models(vocabulary, lanes)
    low, rng = np.zeros(lanes, U), np.full(lanes, np.iinfo(U).max, U)
    by_step = np.empty((steps, lanes), np.uint32)
    for s in range(steps):
        n = -(-(n_ids - s) // steps)
        p2, p1, f2, f1 = model.predict(n)
        lo, c = low[:n], code[:n].copy()
        r = rng[:n] >> U(16)
        v = np.minimum((c - lo) // r, U(ONE - 1)).astype(np.int64)
        two, rest = v < f2, v >= f2 + f1
        j = np.flatnonzero(rest)
        base, part = np.where(two, 0, f2), np.where(two, f2, f1)
        both = f2[j] + f1[j]
        base[j], part[j] = both, ONE - both
        x = np.where(two, p2, p1).astype(np.int64)
        lo, g = lo + r * base.view(U), r * part.view(U)
        r = g[j] // model.total
        v = np.minimum((c[j] - lo[j]) // r, model.total - U(1)).astype(np.int32)
        xj = model.find(v)
        x[j] = xj
        begin, wide = model.interval(xj)
        lo[j] += r * begin
        g[j] = r * wide
        k = np.flatnonzero(((lo ^ (lo + g)) < TOP) | (g < BOT))
        while len(k):
            lk, gk = lo[k], g[k]
            gk = np.where((lk ^ (lk + gk)) >= TOP, (U(0) - lk) & (BOT - U(1)), gk)
            c[k] = (c[k] << U(16)) | take(k)
            lk, gk = lk << U(16), gk << U(16)
            lo[k], g[k] = lk, gk
            k = k[((lk ^ (lk + gk)) < TOP) | (gk < BOT)]
        low[:n], rng[:n], code[:n] = lo, g, c
        by_step[s, :n] = x
        model.learn(x)
    return by_step.T.reshape(-1)[:n_ids]


_HEAD = struct.Struct("<4sIIII")


def encode_block(ids: np.ndarray, vocabulary: int, index: bytes = b"") -> bytes:
    """A block of ids below ``vocabulary``; ``index`` is carried along under the same checksum."""
    body = index + (_compress(ids, vocabulary) if len(ids) else b"")
    head = _HEAD.pack(MAGIC, vocabulary, len(ids), len(index), zlib.crc32(body))
    return head + struct.pack("<I", zlib.crc32(head)) + body


def decode_block(block: bytes) -> tuple[np.ndarray, bytes]:
    """(ids, index) of a block; ValueError if any byte of it has changed."""
    if len(block) < _HEAD.size + 4:
        raise ValueError("a block ends within its head")
    head, (check,) = block[: _HEAD.size], struct.unpack_from("<I", block, _HEAD.size)
    magic, vocabulary, n, size, body_check = _HEAD.unpack(head)
    body = block[_HEAD.size + 4 :]
    if magic != MAGIC or check != zlib.crc32(head) or body_check != zlib.crc32(body):
        raise ValueError("a block's checksum is wrong")
    return (_expand(body[size:], n, vocabulary) if n else np.zeros(0, np.uint32)), body[:size]
