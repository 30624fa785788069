"""An exact similarity join on sets of hashed words, without a row for each pair that meets.

A set is an array of the 64-bit hashes of its words, ordered from the rarest on. Two sets of sizes a >= b with
a Jaccard similarity of t share t / (1 + t) * (a + b) words, and of those all but the words that come after
the beginnings that are compared lie in both beginnings. So the words shared there must reach a known number.
They are counted for all pairs of a block of sets with the larger ones, in arrays of one block's width; what
reaches it is compared whole, in the same place.

Words in one bucket of the look-up only raise a count, and the order decides only how much work there is: no
pair at the threshold is lost. The work still grows with the number of pairs of comparable sizes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Buckets by which words are counted for the order, and by which a block's words are looked up.
RARITY_BITS, LOOKUP_BITS = 16, 20
#: Most sets and words of a block, and cells counted at once.
BLOCK_SETS, BLOCK_WORDS, CELLS = 1 << 13, 1 << 22, 1 << 17
EPS = 1e-6


def _extra(n: np.ndarray) -> np.ndarray:
    """Words that unrelated sets hardly share, beyond the first."""
    return n // 16 + np.minimum(n // 8, 2)


def _length(n: np.ndarray, share: float) -> np.ndarray:
    return np.clip(n - np.ceil(n * share - EPS).astype(np.int64) + 1 + _extra(n), 0, n)


def probe_length(n: np.ndarray, t: float) -> np.ndarray:
    """The length of a larger set's beginning."""
    return _length(n, t)


def index_length(n: np.ndarray, t: float) -> np.ndarray:
    """The length of a smaller or equal set's beginning, no longer than the other."""
    return _length(n, 2 * t / (1 + t))


def levels(buckets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each bucket how common its words are, in eighths of a power of two."""
    out = np.zeros(1 << RARITY_BITS, np.uint8)
    out[buckets] = np.minimum(8 * np.log2(counts), 255)
    return out


def ordered(words: np.ndarray, sizes: np.ndarray, level: np.ndarray) -> list[bytes]:
    """Each set's words from the rarest on."""
    if len(sizes) >= 1 << 24:
        raise ValueError("too many sets at once")
    low = words.view(np.uint64) & np.uint64(0xFFFFFFFF)
    key = level[low & np.uint64((1 << RARITY_BITS) - 1)].astype(np.uint64) << np.uint64(32) | low
    key |= np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes) << np.uint64(40)
    out, ends = words[np.argsort(key)], np.cumsum(sizes)
    return [out[e - n : e].tobytes() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]


def _lookup(words: bytes) -> np.ndarray:
    return (np.frombuffer(words, np.uint64) & np.uint64((1 << LOOKUP_BITS) - 1)).astype(np.int32)


class Block:
    """Up to ``BLOCK_SETS`` sets by size, their beginnings to be looked up by word."""

    def __init__(self, sizes: np.ndarray, sets: list[bytes], t: float):
        self.t, self.sizes, self.sets = t, sizes, sets
        self.lengths = index_length(sizes, t)
        at = _lookup(b"".join([w[: 8 * k] for w, k in zip(sets, self.lengths.tolist(), strict=True)]))
        self.held = np.repeat(np.arange(len(sizes), dtype=np.uint16), self.lengths)[np.argsort(at, kind="stable")]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=1 << LOOKUP_BITS))]).astype(np.int32)
        # What each set and all larger ones have to share at least with any of no less than their size.
        least = sizes * (2 * t / (1 + t)) - (sizes - self.lengths)
        self.least = np.append(np.minimum.accumulate(least[::-1])[::-1], 2.0**40)

    def candidates(self, sizes: np.ndarray, sets: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(i, j): which of these sets may reach the threshold with which of the block's of at most their size."""
        width, t = len(self.sizes), self.t
        near = np.flatnonzero((sizes >= self.sizes[0]) & (sizes * t - EPS <= self.sizes[-1]))
        lengths = probe_length(sizes, t)
        step = max(1, CELLS // width)
        for a in range(0, len(near), step):
            own = near[a : a + step]
            n, k = sizes[own], lengths[own]
            least = np.minimum(n * t - (n - k), self.least[np.searchsorted(self.sizes, n * t - EPS)])
            at = _lookup(b"".join([sets[i][: 8 * m] for i, m in zip(own.tolist(), k.tolist(), strict=True)]))
            first = self.starts[at]
            many = self.starts[at + 1] - first
            where = np.repeat(first - np.cumsum(many, dtype=np.int64) + many, many)
            where += np.arange(len(where))
            cell = np.repeat(np.repeat(np.arange(len(n)) * width, k), many)
            cell += self.held[where]
            shared = np.bincount(cell, minlength=len(n) * width)
            enough = shared.reshape(len(n), width) >= np.maximum(1, np.ceil(least - EPS)).astype(np.int64)[:, None]
            i, j = np.divmod(np.flatnonzero(enough), width)
            nb = self.sizes[j]
            need = (n[i] + nb) * (t / (1 + t)) - EPS - np.maximum(n[i] - k[i], nb - self.lengths[j])
            ok = (nb <= n[i]) & (nb >= n[i] * t - EPS) & (shared[i * width + j] >= need)
            yield own[i[ok]], j[ok]

    def common(self, sets: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The number of words that the sets i have in common with the block's sets j; i ascends."""
        out = np.zeros(len(i), np.int64)
        ends = np.append(np.flatnonzero(i[1:] != i[:-1]) + 1, len(i)) if len(i) else []
        a = 0
        for e in ends:
            own = np.sort(np.frombuffer(sets[i[a]], np.uint64))
            for b in range(a, e, 4096):
                part = j[b : min(e, b + 4096)]
                met = np.frombuffer(b"".join([self.sets[x] for x in part.tolist()]), np.uint64)
                same = own[np.minimum(np.searchsorted(own, met), len(own) - 1)] == met
                out[b : b + len(part)] = np.add.reduceat(same, np.cumsum(self.sizes[part]) - self.sizes[part], dtype=np.int64)
            a = e
        return out


def blocks(sizes: np.ndarray, sets: list[bytes], t: float) -> Iterator[tuple[int, Block]]:
    """The sets, which ascend by size, in blocks, each with the number of its first one."""
    a, words = 0, np.cumsum(index_length(sizes, t))
    while a < len(sizes):
        e = int(np.searchsorted(words, BLOCK_WORDS + (words[a - 1] if a else 0), "right"))
        e = min(max(e, a + 1), a + BLOCK_SETS, len(sizes))
        yield a, Block(sizes[a:e], sets[a:e], t)
        a = e
