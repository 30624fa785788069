"""Whole Arrow string batches as flat byte arrays: word boundaries, word hashes, shingles.

Words are maximal runs of bytes other than space and 0x09-0x0D. No byte of a multi-byte UTF-8
character falls in that set, so byte runs and character runs are the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = bytes([0x20, *range(0x09, 0x0E)])
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SPACES)] = False
#: Letters and digits of ASCII and all bytes of other characters.
_IS_ALNUM = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])

#: Bytes whose word hashes are worked out at once.
CHUNK = 1 << 20
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and odd multipliers), element by element."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The low bytes of a lane that belong to a run of 0 to 8 bytes.
_TAKEN = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Seeds and multipliers of the two hashes.
_KINDS = ((0x243F6A8885A308D3, 0x9FB21C651E98DF25), (0x13198A2E03707344, 0xD1342543DE82EF95))
#: Runs longer than this are hashed one by one.
LONG = 256


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z as a-z."""
    return _LOWER[data]


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on, as one number; zeros follow the last byte."""
    return np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))


def lane_of(lane: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Up to eight bytes of the runs at ``at``, with zeros after their ends."""
    return lane[at] & _TAKEN[np.minimum(size, 8)]


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: bool = False) -> np.ndarray:
    """A 64-bit hash of the bytes of each run: its length, then eight bytes at a time, each step mixed.

    Runs of equal length up to eight bytes never collide, others by chance only. ``other`` gives a
    second hash with constants of its own.
    """
    import xxhash

    seed, odd = _KINDS[other]
    size, lane = ends - starts, lanes(data)
    h = mix(mix(size.astype(np.uint64) + U(seed)) ^ (lane_of(lane, starts, size) * U(odd)))
    i, k = np.flatnonzero(size > 8), 8
    while len(i) and k < LONG:
        h[i] = mix(h[i] ^ (lane_of(lane, starts[i] + k, size[i] - k) * U(odd)))
        k += 8
        i = i[size[i] > k]
    for j in i.tolist():
        h[j] = xxhash.xxh3_64_intdigest(data[starts[j] : ends[j]].tobytes(), seed)
    return h


class Texts:
    """The texts of one batch: ``data`` (bytes) and ``off`` (n + 1 offsets); null texts are empty."""

    def __init__(self, column: pa.Array):
        pa.default_memory_pool().release_unused()  # of the batches before
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = pc.fill_null(column.cast(pa.large_string()), "")
        _, offsets, data = column.buffers()
        self.n = len(column)
        off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + self.n + 1] if self.n else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.data, self.off = raw[off[0] : off[-1]], off - off[0]

    def slices(self, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
        """Ranges of documents of about ``most`` bytes; a longer document is a range of its own."""
        lo = 0
        while lo < self.n:
            hi = max(lo + 1, int(np.searchsorted(self.off, self.off[lo] + most, "right")) - 1)
            yield lo, hi
            lo = hi

    def words(self, lo: int, hi: int, alnum: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words of documents lo..hi (bytes of ``data``), and for each
        document the number of the first of its words, n + 1 numbers. With ``alnum``, words are
        runs of letters and digits: ASCII punctuation parts them too."""
        off = self.off[lo : hi + 1]
        inside = np.zeros(off[-1] - off[0] + 2, bool)
        inside[1:-1] = (_IS_ALNUM if alnum else _IS_WORD)[self.data[off[0] : off[-1]]]
        at = off - off[0]
        full = at[1:] > at[:-1]
        begins = inside[1:-1] & ~inside[:-2]
        first = at[:-1][full]
        begins[first] = inside[1:-1][first]
        stops = inside[1:-1] & ~inside[2:]
        last = at[1:][full] - 1
        stops[last] = inside[1:-1][last]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        return starts + off[0], ends + off[0], np.searchsorted(starts, at)

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
        """A 64-bit hash of each word; with ``lower``, A-Z count as a-z."""
        out = np.empty(len(starts), np.uint64)
        i = 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK, "right")))
            base = starts[i]
            part = self.data[base : ends[j - 1]]
            out[i:j] = run_hashes(lowered(part) if lower else part, starts[i:j] - base, ends[i:j] - base)
            i = j
        return out


def shingle_sets(texts: Texts, width: int) -> Iterator[np.ndarray]:
    """For each document its set of shingles of ``width`` words as sorted distinct hashes.

    A document with fewer words has one shingle, its whole word sequence; without words, none.
    """
    for lo, hi in texts.slices():
        starts, ends, first = texts.words(lo, hi)
        h = texts.hashes(starts, ends)
        run = h.copy()
        for k in range(1, width):
            run[: len(h) - k] = mix(run[: len(h) - k] * U(0x9FB21C651E98DF25) + h[k:])
        for d in range(hi - lo):
            a, b = int(first[d]), int(first[d + 1])
            if b - a >= width:
                yield np.unique(run[a : b - width + 1])
            elif b > a:
                one = h[a : a + 1]
                for k in range(a + 1, b):
                    one = mix(one * U(0x9FB21C651E98DF25) + h[k : k + 1])
                yield mix(one + U(width * 31 + b - a))
            else:
                yield h[:0]
