"""Token-id files: documents in ascending doc_id order, as blocks of range-coded ids.

Writing: rows are range-partitioned and sorted by doc_id; each partition encodes its texts and
packs the ids of whole documents into blocks of about ``BLOCK`` ids (a longer document is cut over
several). A block is independent of all others: its index of documents and its range-coded ids lie
under one checksum, so it can be read, checked and rewritten alone. The container is a Parquet
table (part, block, n_ids, payload) in the shared folder, written by Spark, so a lost executor's
files are written again by the same deterministic task and readers see committed files only.

Reading: each block is decoded by itself; where a document starts in the whole corpus follows from
prefix sums over n_ids; the pieces of a document that was cut are joined by combining checksums.

Encoding goes through distinct words: the vocabularies read here never let a token lie across
ASCII white space, so each distinct word is encoded once by the library and the ids of a text are
gathered from its words. A worker keeps words by two 64-bit keys and their bytes; a word whose keys
are found but not its bytes is kept apart, so equal keys never give wrong ids.

Defined cases: a null or empty text is a document with the end id only; null doc_ids come first, rows
of equal doc_id are ordered by text; a text of any length is encoded whole, its words some at a time,
and cut over blocks; an empty table writes no block; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkgraph.llm.range_coder import BLOCK, decode_block, encode_block
from inkgraph.llm.textbuf import Texts, U, lane_of, lanes, lowered, run_hashes
from inkgraph.llm.worker import kept, let_go
from inkgraph.plans.tables import Scratch

END = 1
#: Twice the distinct words a worker keeps; when they are full, those not met again are dropped.
SLOTS = 1 << 21
#: Bytes of words beyond which a worker starts afresh.
WORD_BYTES = 1 << 26
WORDS_AT_ONCE = 1 << 18
#: New words coded at once, which are Python objects for as long.
NEW_AT_ONCE = 1 << 14
SLICE_BYTES = 4 << 20
FILE = "part int, block int, n_ids long, payload binary"
DOCS = "part int, block int, place long, doc_id long, pieces int, n long, crc long"


@lru_cache(maxsize=1)
def _letter_of_byte() -> list[str]:
    """Byte-level vocabularies write printable bytes as themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


@lru_cache(maxsize=1)
def _letters() -> dict[int, str]:
    return dict(enumerate(_letter_of_byte()))


def _byte_letters(word: str) -> str:
    return word.encode().decode("latin-1").translate(_letters())


_IS_LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])
_IS_TAIL = np.array([chr(b) in ".," for b in range(256)])


def _longer(x: np.ndarray, need: int) -> np.ndarray:
    """``x``, with zeros after it if it is shorter than needed; they take no memory until written."""
    if need <= len(x):
        return x
    out = np.zeros(max(need, len(x) * 3 // 2), x.dtype)
    out[: len(x)] = x
    return out


class WordEncoder:
    """Ids of texts through the library's ids of their distinct words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.size = max(self.library.get_vocab_size(), END + 1)
        added = self.library.get_added_tokens_decoder().values()
        # A special string with white space in it, or one that takes in the space beside it, would
        # be found across words; then texts are encoded whole.
        self.by_word = not any(t.lstrip or t.rstrip or any(c.isspace() for c in t.content) for t in added) and self._drops_space()
        # Lower-case letters need no normalising: their bytes can go straight to the library's merges.
        self.model = self.library.model
        self.plain = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u00ff]+").fullmatch
        self.by_model = all([t.id for t in self.model.tokenize(_byte_letters(w))] == self._ids(w) for w in ("a", "the", "straße", "élève", "ñandúes", "zyxwvutsrq"))
        self.by_model = self.by_model and self._ids("Thé.,") == self._ids("thé") + self._ids(".,") and self._ids("AB'S 1X") == self._ids("ab's 1x")
        self.tails: dict[str, list[int]] = {"": []}
        self._forget()

    def _drops_space(self) -> bool:
        """Whether the encoding of probes is that of their words, one after the other."""
        probes = ["a b", "it's 12 x's", "a\t\n b", " a ", "Ab,c d.e é´ ́x", "a. .b ... 'S 's", "<| endoftext |>"]
        return all(self._ids(p) == [i for w in p.split() for i in self._ids(w)] for p in probes)

    def _ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _forget(self) -> None:
        # Slots hold numbers of words; keys and checks are by number, so those of frequent words lie together.
        self.value = np.full(SLOTS, -1, np.int32)
        self.keys, self.checks = np.zeros(1 << 14, np.uint64), np.zeros(1 << 14, np.uint64)
        self.flat, self.first, self.n = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int32), 0
        # The bytes of the words, one after the other, and where each begins.
        self.bytes, self.begin = np.zeros(1 << 18, np.uint8), np.zeros(1 << 14, np.int32)
        self.apart: dict[bytes, int] = {}
        self.met = np.zeros(1 << 14, bool)  # words found again since they were learned or kept

    def _shrink(self) -> None:
        """Keep the words that were met again: at most half of the room, those learned first."""
        old = np.flatnonzero(self.met[: self.n])[: SLOTS // 4]
        if self.begin[self.n] > WORD_BYTES:
            old = old[:0]
        h, check = self.keys[old], self.checks[old]
        flat, first, text, begin = self.flat, self.first, self.bytes, self.begin
        self._forget()
        sizes = {"flat": first[old + 1] - first[old], "bytes": begin[old + 1] - begin[old]}
        self._extend("flat", "first", flat[_ranges(first[old], sizes["flat"])], sizes["flat"])
        self._extend("bytes", "begin", text[_ranges(begin[old], sizes["bytes"])], sizes["bytes"])
        self._grow(len(old))
        self._put(h, check, np.arange(len(old), dtype=np.int32))
        self.n = len(old)

    def _grow(self, n: int) -> None:
        """Room for n more words in what is kept by number."""
        self.met, self.keys, self.checks = (_longer(x, self.n + n) for x in (self.met, self.keys, self.checks))

    def _extend(self, values: str, first: str, new: np.ndarray, sizes: np.ndarray) -> None:
        """Values of words that follow the last one."""
        at = _longer(getattr(self, first), self.n + len(sizes) + 1)
        setattr(self, first, at)
        at[self.n + 1 : self.n + 1 + len(sizes)] = at[self.n] + np.cumsum(sizes)
        used, need = int(at[self.n]), int(at[self.n + len(sizes)])
        setattr(self, values, _longer(getattr(self, values), need + 8))  # the last lane is read whole
        getattr(self, values)[used:need] = new

    def _code(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, one word after the other, and how many each has. Words of Latin letters, but
        for points and commas after them, go straight to the library's merges; case is lost in them
        anyway, as in all. Ids go into one list: a list for each word would keep the garbage collector busy."""
        ids: list[int] = []
        sizes, rest, tokenize = [0] * len(words), [], self.model.tokenize
        for i, w in enumerate(words):
            tail = ""
            if not (self.by_model and w.isascii() and w.isalpha()):
                stem = w.rstrip(".,")
                if not self.by_model or not self.plain(low := stem.lower()):
                    rest.append(i)
                    continue
                w, tail = low if low.isascii() else _byte_letters(low), w[len(stem) :]
            else:
                w = w.lower()
            found = tokenize(w)
            ids += [t.id for t in found]
            sizes[i] = len(found)
            if tail:
                ids += self._tail(tail)
                sizes[i] += len(self._tail(tail))
        count = np.array(sizes, np.int64)
        if not rest:
            return np.array(ids, np.int32), count
        for a in range(0, len(rest), 4096):
            for i, e in zip(rest[a : a + 4096], self.library.encode_batch_fast([words[i] for i in rest[a : a + 4096]], add_special_tokens=False), strict=True):
                ids += e.ids
                count[i] = len(e.ids)
        # The words that went to the library whole come last; put all in their order.
        late = np.zeros(len(words), bool)
        late[rest] = True
        order = np.argsort(late, kind="stable")
        begin = np.empty(len(words), np.int64)
        begin[order] = np.cumsum(count[order]) - count[order]
        return np.array(ids, np.int32)[_ranges(begin, count)], count

    def _tail(self, text: str) -> list[int]:
        if text not in self.tails:
            ids = self._ids(text)
            if len(text) > 8:
                return ids
            self.tails[text] = ids
        return self.tails[text]

    def _find(self, h: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The numbers of words by two hashes, -1 for new ones."""
        out, i = np.full(len(h), -1, np.int32), np.arange(len(h))
        slot = (h & U(SLOTS - 1)).astype(np.int64)
        while len(i):
            v = self.value[slot]
            here = (v >= 0) & (self.keys[v] == h[i]) & (self.checks[v] == check[i])
            out[i[here]] = v[here]
            go = ~here & (v >= 0)
            i, slot = i[go], (slot[go] + 1) & (SLOTS - 1)
        return out

    def _put(self, h: np.ndarray, check: np.ndarray, number: np.ndarray) -> None:
        self.keys[number], self.checks[number] = h, check
        slot = (h & U(SLOTS - 1)).astype(np.int64)
        i = np.arange(len(h))
        while len(i):
            free = np.flatnonzero(self.value[slot] < 0)
            at, one = np.unique(slot[free], return_index=True)  # one of those that want a slot gets it
            got = free[one]
            self.value[at] = number[i[got]]
            left = np.ones(len(i), bool)
            left[got] = False
            i, slot = i[left], (slot[left] + 1) & (SLOTS - 1)

    def _learn(self, part: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
        """The numbers of new words, the runs of ``part``; without keys they are not entered in the table."""
        size = ends - starts
        # The words between line feeds, which are in none of them, so that they are decoded at once.
        lines = np.full(int(size.sum()) + len(size), 0x0A, np.uint8)
        text = part[_ranges(starts, size)]
        lines[np.arange(len(text)) + np.repeat(np.arange(len(size)), size)] = text
        ids, count = self._code(lines.tobytes().decode().split("\n")[:-1])
        number = np.arange(self.n, self.n + len(size), dtype=np.int32)
        self._extend("flat", "first", ids, count)
        self._extend("bytes", "begin", text, size)
        self._grow(len(size))
        if keys:
            self._put(*keys, number)
        self.n += len(size)
        return number

    def _other(self, part: np.ndarray, starts: np.ndarray, ends: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Places of the words that are not those of their numbers, by their bytes."""
        size, at = ends - starts, self.begin[number]
        wrong = (number < 0) | (self.begin[number + 1] - at != size)
        # Up to eight bytes are the check itself.
        i = np.flatnonzero(~wrong & (size > 8))
        if len(i):
            here, known, k = lanes(part), np.ndarray((len(self.bytes) - 7,), "<u8", self.bytes, strides=(1,)), 0
            while len(i):
                left = size[i] - k
                differ = lane_of(here, starts[i] + k, left) != lane_of(known, at[i] + k, left)
                wrong[i[differ]] = True
                k += 8
                i = i[~differ & (left > 8)]
        return np.flatnonzero(wrong)

    def _parted(self, texts: Texts, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words with points and commas after a Latin letter as words of their own."""
        if not self.by_model or not len(starts):
            return starts, ends, first
        cut = np.flatnonzero(_IS_TAIL[texts.data[ends - 1]] & (ends - starts > 1))
        tail = np.ones(len(cut), np.int64)
        for k in range(2, 5):
            at = ends[cut] - k
            tail[(at > starts[cut]) & (tail == k - 1) & _IS_TAIL[texts.data[at]]] = k
        after = _IS_LETTER[texts.data[ends[cut] - tail - 1]]
        cut, tail = cut[after], tail[after]
        stop = ends.copy()
        stop[cut] -= tail
        return np.insert(starts, cut + 1, stop[cut]), np.insert(stop, cut + 1, ends[cut]), first + np.searchsorted(cut, first)

    def _folded(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The bytes in lower case if case is lost, but for special strings, which hold ``<|``."""
        if not self.by_model:
            return data
        out = lowered(data)
        special = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))
        for w in np.unique(np.searchsorted(starts, special, "right") - 1).tolist():
            out[starts[w] : ends[w]] = data[starts[w] : ends[w]]
        return out

    def encode(self, texts: Texts, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, n + 1 offsets) of the documents lo..hi, the end id after each."""
        if not self.by_word:
            whole = [texts.data[texts.off[d] : texts.off[d + 1]].tobytes().decode() for d in range(lo, hi)]
            coded = [e.ids + [END] for e in self.library.encode_batch(whole, add_special_tokens=False)]
            return np.array([i for c in coded for i in c], np.int32), np.concatenate([[0], np.cumsum([len(c) for c in coded])]).astype(np.int64)
        starts, ends, first = self._parted(texts, *texts.words(lo, hi))
        ids, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for a in range(0, len(starts), WORDS_AT_ONCE):
            base = starts[a]
            s, e = starts[a : a + WORDS_AT_ONCE] - base, ends[a : a + WORDS_AT_ONCE] - base
            part = self._folded(texts.data[base : base + e[-1]], s, e)
            h, check = run_hashes(part, s, e), lane_of(lanes(part), s, e - s)
            long = np.flatnonzero(e - s > 8)
            check[long] = run_hashes(part, s[long], e[long], other=True)
            n = self._find(h, check)
            self.met[n[n >= 0]] = True
            new = np.flatnonzero(n < 0)
            if self.n + len(new) > SLOTS // 2 or self.begin[self.n] > WORD_BYTES:
                self._shrink()
                n = self._find(h, check)
                new = np.flatnonzero(n < 0)
            if len(new):
                _, one = np.unique(h[new] ^ (check[new] * U(0x9E3779B97F4A7C15)), return_index=True)
                w = new[one]
                for k in range(0, len(w), NEW_AT_ONCE):
                    some = w[k : k + NEW_AT_ONCE]
                    self._learn(part, s[some], e[some], (h[some], check[some]))
                n[new] = self._find(h[new], check[new])
            for w in self._other(part, s, e, n).tolist():
                word = part[s[w] : e[w]].tobytes()
                if word not in self.apart:
                    self.apart[word] = int(self._learn(part, s[w : w + 1], e[w : w + 1], None)[0])
                n[w] = self.apart[word]
            at = self.first[n]
            sizes.append(self.first[n + 1] - at)
            ids.append(self.flat[_ranges(at, sizes[-1])])
        off = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])[first]
        # The end id goes in after the last id of each text.
        return np.insert(np.concatenate(ids), off[1:], END).astype(np.int32), off + np.arange(len(off))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


# A block's index: for each document its id, whether it is null, ids in this block, and whether it
# began in an earlier block or goes on in a later one.
_ENTRY = np.dtype([("doc_id", "<i8"), ("n", "<u4"), ("null", "u1"), ("began", "u1"), ("goes_on", "u1")])


class _Packer:
    def __init__(self, vocabulary: int, block: int):
        self.vocabulary, self.block = vocabulary, block
        self.entries: list[tuple] = []
        self.ids: list[np.ndarray] = []
        self.held = self.made = 0

    def flush(self) -> tuple[int, int, bytes]:
        ids = np.concatenate(self.ids) if self.ids else np.zeros(0, np.int32)
        index = zlib.compress(np.array(self.entries, _ENTRY).tobytes(), 1)
        row = (self.made, len(ids), encode_block(ids, self.vocabulary, index))
        self.entries, self.ids, self.held, self.made = [], [], 0, self.made + 1
        return row

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        if self.held and self.held + len(ids) > self.block:
            yield self.flush()
        for a in range(0, len(ids), self.block):
            piece = ids[a : a + self.block]
            goes_on = a + self.block < len(ids)
            self.entries.append((doc_id or 0, len(piece), doc_id is None, a > 0, goes_on))
            self.ids.append(piece)
            self.held += len(piece)
            if goes_on:
                yield self.flush()


def write_token_files(docs: DataFrame, path: str, at: str, block: int = BLOCK) -> None:
    """Write the ids of all of ``docs`` (doc_id, text) to the folder ``at``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = kept((WordEncoder, path), lambda: WordEncoder(path)), TaskContext.get().partitionId()
        packer = _Packer(enc.size, block)

        def batch_of(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
            b, n, p = (list(x) for x in zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array([part] * len(b), pa.int32()), pa.array(b, pa.int32()), pa.array(n, pa.int64()), pa.array(p, pa.binary())], names=["part", "block", "n_ids", "payload"])

        for batch in batches:
            texts = Texts(batch.column(1))
            doc_ids = batch.column(0).to_pylist()
            for lo, hi in texts.slices(SLICE_BYTES):
                ids, off = enc.encode(texts, lo, hi)
                for i in range(hi - lo):
                    for row in packer.add(doc_ids[lo + i], ids[off[i] : off[i + 1]]):
                        yield batch_of([row])
        if packer.entries:
            yield batch_of([packer.flush()])

    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    # Payloads don't compress further.
    dealt.mapInArrow(pack, FILE).write.option("compression", "none").parquet(at)


def read_token_files(spark: SparkSession, at: str) -> DataFrame:
    """(part, block, place, doc_id, ids, began, goes_on): each block's documents with their ids."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                ids, entries = _decoded(payload.as_py())
                off = np.concatenate([[0], np.cumsum(entries["n"], dtype=np.int64)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(entries), pa.int32()), pa.array([block] * len(entries), pa.int32()), pa.array(off[:-1]), _ids_of(entries), pa.ListArray.from_arrays(off.astype(np.int32), ids.astype(np.int32)), pa.array(entries["began"] > 0), pa.array(entries["goes_on"] > 0)],
                    names=["part", "block", "place", "doc_id", "ids", "began", "goes_on"],
                )

    files = spark.read.schema(FILE).parquet(at).select("part", "block", "payload")
    return files.mapInArrow(unpack, "part int, block int, place long, doc_id long, ids array<int>, began boolean, goes_on boolean")


def _decoded(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids, index = decode_block(payload)
    entries = np.frombuffer(zlib.decompress(index), _ENTRY)
    if int(entries["n"].sum()) != len(ids):
        raise ValueError("a block's index doesn't fit its ids")
    return ids, entries


def _ids_of(entries: np.ndarray) -> pa.Array:
    return pa.array(entries["doc_id"], pa.int64(), mask=entries["null"] > 0)


def _times(matrix: list[int], vector: int) -> int:
    total, i = 0, 0
    while vector:
        if vector & 1:
            total ^= matrix[i]
        vector >>= 1
        i += 1
    return total


def combine_crc32(first: int, second: int, size: int) -> int:
    """The CRC-32 of two byte strings joined, from their own and the length of the second.

    Appending a zero bit is a linear map over GF(2); it is raised to the power of the length.
    """
    step = [0xEDB88320] + [1 << i for i in range(31)]
    bits, power = 8 * size, step
    while bits:
        if bits & 1:
            first = _times(power, first)
        power = [_times(power, column) for column in power]
        bits >>= 1
    return first ^ second


def token_file_digests(spark: SparkSession, at: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files, read back from them."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for part, block, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                ids, entries = _decoded(payload.as_py())
                off = np.concatenate([[0], np.cumsum(entries["n"], dtype=np.int64)])
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(off[:-1], off[1:], strict=True)]
                kind = entries["began"].astype(np.int32) * 2 + entries["goes_on"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(crc), pa.int32()), pa.array([block] * len(crc), pa.int32()), pa.array(off[:-1]), _ids_of(entries), pa.array(kind, pa.int32()), pa.array(entries["n"].astype(np.int64)), pa.array(crc, pa.int64())],
                    names=["part", "block", "place", "doc_id", "pieces", "n", "crc"],
                )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = []
            for pieces in batch.column(2).to_pylist():
                crc = 0
                for p in pieces:
                    crc = combine_crc32(crc, p["crc"], 4 * p["n"])
                total.append(crc)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(total, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.read.schema(FILE).parquet(at)
    # Ids before each part, then before each block of it: one row a part, one row a block.
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("_t"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begins = files.select("part", "block", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("_in")).join(parts, "part")
    begins = begins.select("part", "block", (F.col("_base") + F.col("_in")).alias("_begin"))
    # Written, so that each block is decoded once though the two kinds of documents are read apart.
    decoded = Scratch(spark, "tokens").keep(files.select("part", "block", "payload").mapInArrow(digest, DOCS), "decoded")
    found = decoded.join(begins, ["part", "block"])
    found = found.withColumn("start", F.col("_begin") + F.col("place"))
    whole = found.where("pieces = 0").select("doc_id", "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    # The pieces of a cut document follow each other in a part: number the document by its first piece.
    nth = Window.partitionBy("part").orderBy("block", "place")
    cut = found.where("pieces > 0").withColumn("_d", F.sum((F.col("pieces") == 1).cast("int")).over(nth))
    cut = cut.groupBy("part", "_d").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sort_array(F.collect_list(F.struct("block", "crc", "n"))).alias("pieces"), F.sum("n").alias("n_tokens")
    )
    return whole.unionAll(cut.select("doc_id", "start", "pieces", "n_tokens").mapInArrow(join, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def written_and_read(docs: DataFrame, path: str, block: int = BLOCK) -> DataFrame:
    """The digests of ``docs`` from files written for the purpose to the shared folder."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    at = scratch.path("files")
    write_token_files(docs, path, at, block)
    result = scratch.keep(token_file_digests(spark, at), "digests")
    scratch.drop(at)
    return result
