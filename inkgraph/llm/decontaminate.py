"""Benchmark decontamination by latent semantic retrieval.

1. Words are runs of letters and digits, lower-cased, as 64-bit hashes. A pass over all documents
   counts those of the benchmark's vocabulary; a word weighs the logarithm of its rarity.
2. A randomised SVD of the TF-IDF matrix of the benchmark passages (two passes of B'(B X) with the
   passages spread over the cluster, orthonormalised between) gives each word a latent vector.
3. A second pass over all documents slides windows over each text, half their width at a time. A
   window whose weight cannot cover ``COVER`` of any passage is passed over (an upper bound, so
   nothing is lost by it); the others get a latent vector and their cosines with all passages, in
   blocks. Candidates have a cosine of at least ``COSINE`` and share words of at least ``COVER`` of the
   passage's weight. Whatever its cosine, a window is a candidate if it and half a window to each
   side, room for a whole passage, share words of ``COVER`` of the passage's weight; an inverted
   index of the passages' words gives these, all but the lightest words of a passage being in it. In
   it the heaviest words of a passage are clipped, so that what is left of a verbatim copy, ``VERBATIM``
   of its words or more, has ``COVER`` of the weight whichever words were changed.
4. Around a candidate window, the longest common subsequence of words with the passage decides, in
   stretches of ``STRETCH`` times its length: contaminated from ``VERBATIM`` of the passage on, and from
   ``PARAPHRASE`` on if the passage's answer (its last sentence) is there too, again by common
   subsequence, at ``ANSWER``.

Candidates are confirmed where they are found, so no text moves. What is broadcast are the
passages' word hashes and latent vectors: passages are taken in blocks of at most ``BLOCK_ITEMS``
items and ``BLOCK_WORDS`` words, each searched in a pass of its own; the SVD is fitted on all passages
of the block.

Defined cases: null and empty texts and passages match nothing; an empty benchmark contaminates
nothing, and no document gives no row; repeated rows repeat their result; equal passages are all
reported; texts of any length are searched whole, about a million bytes at a time with their windows;
other columns are ignored, or kept by ``clean_documents``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgraph.llm.textbuf import Texts, U
from inkgraph.llm.worker import kept

RANK, OVERSAMPLE, PASSES = 64, 16, 2
COVER, COSINE = 0.25, 0.4
VERBATIM, PARAPHRASE, ANSWER = 0.8, 0.5, 0.8
LEAST_WINDOW = 32
#: In how many times the length of a passage its words must lie.
STRETCH = 1.5
#: The share of a passage's weight that may be left out of the inverted index, in its lightest words.
LIGHT = 0.05
#: Words more frequent than this share of all words weigh next to nothing.
COMMON, FLOOR = 1e-3, 0.1
BLOCK_ITEMS, BLOCK_WORDS = 20_000, 500_000
#: Words whose products a task holds before it passes them on.
HELD_WORDS = 1 << 15


def word_hashes(text: str) -> np.ndarray:
    texts = Texts(pa.array([text]))
    starts, ends, _ = texts.words(0, 1, alnum=True)
    return texts.hashes(starts, ends)


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, one bit of an integer for each word of ``a``."""
    at: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        at[x] = at.get(x, 0) | 1 << i
    every = (1 << len(a)) - 1
    v = every
    for x in b.tolist():
        u = v & at.get(x, 0)
        if u:
            v = ((v + u) | (v - u)) & every
    return len(a) - v.bit_count()


def answer_of(text: str) -> str:
    """The last sentence of a passage, or its last quarter if it is one sentence."""
    body = text.rstrip().rstrip(".!?\"')").rstrip()
    cut = max(body.rfind(c) for c in ".!?\n")
    if cut >= 0:
        return body[cut + 1 :]
    words = body.split()
    return " ".join(words[-max(1, len(words) // 4) :])


class Lookup:
    """Numbers of known hashes, by the sixteen highest bits and a few steps."""

    def __init__(self, known: np.ndarray):
        self.known = known  # sorted, distinct
        self.first = np.searchsorted(known, np.arange(1 << 16, dtype=np.uint64) << U(48))
        self.steps = int(np.diff(np.append(self.first, len(known))).max()) if len(known) else 0

    def __call__(self, h: np.ndarray) -> np.ndarray:
        at, out = self.first[(h >> U(48)).astype(np.int64)], np.full(len(h), -1, np.int64)
        for k in range(self.steps):
            here = np.minimum(at + k, len(self.known) - 1)
            out = np.where(self.known[here] == h, here, out)
        return out


@dataclass
class Index:
    item_ids: list[int]
    items: list[np.ndarray]  # word hashes
    answers: list[np.ndarray]
    known: np.ndarray
    weight: np.ndarray
    energy: np.ndarray  # of each item
    latent: np.ndarray  # of each item, of length 1
    vectors: np.ndarray  # of each known word, times its weight

    def windows(self) -> list[tuple[int, np.ndarray]]:
        """(words, items): passages are searched by windows of about half to all of their length."""
        size = np.array([len(x) for x in self.items])
        level = np.maximum(0, np.floor(np.log2(np.maximum(size, 1) / LEAST_WINDOW)).astype(int))
        return [(LEAST_WINDOW << int(v), np.flatnonzero((level == v) & (self.energy > 0))) for v in np.unique(level)]


def _counts(docs: DataFrame, known: np.ndarray) -> tuple[np.ndarray, int]:
    """How often each known word is in all documents, and the number of all words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, total, n = Lookup(known), np.zeros(len(known), np.int64), 0
        for batch in batches:
            texts = Texts(batch.column(0))
            for lo, hi in texts.slices():
                starts, ends, _ = texts.words(lo, hi, alnum=True)
                at = number(texts.hashes(starts, ends))
                total += np.bincount(at[at >= 0], minlength=len(known))
                n += len(at)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], n))], names=["word", "n"])

    rows = docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    word, n = rows["word"].to_numpy(), rows["n"].to_numpy()
    out = np.zeros(len(known), np.int64)
    out[word[word >= 0]] = n[word >= 0]
    return out, int(n[word < 0].sum())


def _numbers(text: str, number: Lookup) -> np.ndarray:
    at = number(word_hashes(text))
    return at[at >= 0]


def _orthonormal(x: np.ndarray) -> np.ndarray:
    """Orthonormal columns of the same span, by the small matrix of their products; twice, for accuracy."""
    for _ in range(2):
        values, turn = np.linalg.eigh((x.T @ x).astype(np.float64))
        kept = values > 1e-10 * max(values[-1], 1e-30)
        scale = np.where(kept, 1 / np.sqrt(np.where(kept, values, 1.0)), 0.0)
        x = x @ (turn * scale).astype(x.dtype)
    return x


def _word_vectors(passages: DataFrame, known: np.ndarray, weight: np.ndarray, rank: int, seed: int = 3) -> np.ndarray:
    """The leading right singular vectors of the passages' TF-IDF rows, known words x rank.

    The passages stay where they are; each pass sends the words' current vectors out and sums the
    products B'(B X) by word.
    """
    width = max(1, min(rank + OVERSAMPLE, len(known)))
    spark = passages.sparkSession
    x = _orthonormal(np.random.default_rng(seed).standard_normal((len(known), width), np.float32))

    def product(x: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast((known, weight, x))

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, w, x = shared.value
            number = Lookup(words)

            def flush(total: dict[int, np.ndarray]) -> pa.RecordBatch:
                at = np.arange(len(total) + 1, dtype=np.int32) * x.shape[1]
                return pa.RecordBatch.from_arrays([pa.array(list(total)), pa.ListArray.from_arrays(at, np.concatenate(list(total.values())))], names=["word", "v"])

            for batch in batches:
                total: dict[int, np.ndarray] = {}
                for cell in batch.column(0):
                    if len(total) > HELD_WORDS:
                        yield flush(total)
                        total = {}
                    at, times = np.unique(_numbers(cell.as_py() or "", number), return_counts=True)
                    value = times * w[at]
                    y = value @ x[at]
                    for k, v in zip(at.tolist(), value.tolist(), strict=True):
                        total[k] = total.get(k, 0) + v * y
                if total:
                    yield flush(total)

        parts = passages.select("text").mapInArrow(part, "word long, v array<double>")
        rows = parts.groupBy("word").agg(*[F.sum(F.col("v")[j]).cast("float").alias(f"v{j}") for j in range(width)]).toArrow()
        shared.destroy()
        z = np.zeros_like(x)
        z[rows["word"].to_numpy()] = np.stack([rows[f"v{j}"].to_numpy() for j in range(width)], axis=1)
        return z

    for _ in range(PASSES):
        x = _orthonormal(product(x))
    values, turn = np.linalg.eigh(x.T @ product(x))
    return x @ turn[:, np.argsort(-values)[:rank]]


def build_index(docs: DataFrame, items: DataFrame, rank: int = RANK) -> Index:
    """The index of one block of passages (item_id, text), weighted by the words of all ``docs``."""
    items = items.where("item_id is not null and text is not null")
    rows = sorted((r["item_id"], r["text"]) for r in items.collect())
    hashes = [word_hashes(t) for _, t in rows]
    known = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
    counts, total = _counts(docs, known) if len(known) else (np.zeros(0, np.int64), 0)
    share = np.maximum(counts, 1) / max(total, 1)
    weight = np.maximum(np.log(COMMON / share), 0) + FLOOR
    number = Lookup(known)
    vectors = _word_vectors(items, known, weight, rank) if len(known) else np.zeros((0, rank))
    vectors = (vectors * weight[:, None]).astype(np.float32)
    at = [number(h) for h in hashes]
    latent = np.array([vectors[a].sum(0) for a in at], np.float32).reshape(len(at), vectors.shape[1])
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    energy = np.array([(weight[a] ** 2).sum() for a in at])
    return Index([i for i, _ in rows], hashes, [word_hashes(answer_of(t)) for _, t in rows], known, weight, energy, latent, vectors)


def clipped(square: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The weights of a passage's distinct words, the heaviest cut down until no ``1 - VERBATIM`` of its
    words have more than ``1 - COVER`` of the weight."""
    order = np.argsort(-square, kind="stable")
    value, n = square[order].astype(float), times[order]
    many = max(1.0, np.floor((1 - VERBATIM) * n.sum() + 1e-9))
    before = np.concatenate([[0], np.cumsum(n)[:-1]])
    top = np.clip(many - before, 0, n)  # of the occurrences of each word, those among the heaviest
    for _ in range(50):
        most = (1 - COVER) / COVER * float(((n - top) * value).sum()) / many
        if (top * value).sum() <= most * many * (1 + 1e-9):
            break
        value = np.minimum(value, most)
    out = np.empty(len(value))
    out[order] = value
    return out


class Postings:
    """Which of ``items`` (word numbers of each, ``square`` by word) hold a word, for all but their lightest words."""

    #: Most postings worked on at once; one block of words may have some more.
    HELD = 1 << 20

    def __init__(self, items: list[np.ndarray], square: np.ndarray, n_words: int):
        self.n = len(items)
        words, owners, values, self.need = [], [], [], np.zeros(len(items))
        for i, x in enumerate(items):
            own, times = np.unique(x, return_counts=True)
            value = clipped(square[own], times)
            part = times * value
            order = np.argsort(part, kind="stable")
            total = np.cumsum(part[order])
            light = int(np.searchsorted(total, LIGHT * total[-1], "right"))
            words.append(own[order[light:]])
            values.append(value[order[light:]])
            owners.append(np.full(len(own) - light, i))
            # What is left out can bring no more than its own weight.
            self.need[i] = COVER * total[-1] - (total[light - 1] if light else 0.0) - 1e-9
        word, owner = np.concatenate(words), np.concatenate(owners)
        order = np.argsort(word, kind="stable")
        self.owner, self.value = owner[order], np.concatenate(values)[order]
        self.first = np.searchsorted(word[order], np.arange(n_words + 1))

    def __call__(self, words: np.ndarray, block: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(blocks, items) such that a block, the one before and the two after it share enough with the
        item. ``block`` is the block of each word, ascending, ``doc`` the document of each block."""
        times = self.first[words + 1] - self.first[words]
        some = times > 0
        words, block, times = words[some], block[some], times[some]
        upto = np.concatenate([[0], np.cumsum(times)])
        at = np.searchsorted(block, np.arange(len(doc) + 1))  # the first word of each block
        a = 0
        while a < len(doc):
            b = max(a + 1, int(np.searchsorted(upto[at], upto[at[a]] + self.HELD, "right")) - 1)
            b = min(b, len(doc))
            lo, hi = max(0, a - 1), min(len(doc), b + 2)
            w = slice(at[lo], at[hi])
            n = times[w]
            if n.sum():
                place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[words[w]], n)
                key = np.repeat(block[w] - lo, n) * self.n + self.owner[place]
                found, item = self._stretches(key, self.value[place], doc[lo:hi])
                own = (found >= a - lo) & (found < b - lo)
                yield found[own] + lo, item[own]
            a = b

    def _stretches(self, key: np.ndarray, value: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = len(doc)
        if size * self.n <= 8 * len(key):
            sums = np.bincount(key, weights=value, minlength=size * self.n).reshape(size, self.n)
            whole = sums.copy()
            for d in (1, 2):
                whole[:-d] += sums[d:] * (doc[d:] == doc[:-d])[:, None]
            whole[1:] += sums[:-1] * (doc[1:] == doc[:-1])[:, None]
            return np.nonzero(whole >= self.need)
        key, at = np.unique(key, return_inverse=True)
        value, block = np.bincount(at, weights=value), key // self.n
        keys, values = [], []
        for d in (-1, 0, 1, 2):
            head = block - d
            ok = (head >= 0) & (head < size)
            ok &= doc[np.clip(head, 0, size - 1)] == doc[block]
            keys.append(key[ok] - d * self.n)
            values.append(value[ok])
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        enough = np.bincount(at, weights=np.concatenate(values)) >= self.need[key % self.n]
        return key[enough] // self.n, key[enough] % self.n


class Search:
    """Finds passages in batches of texts."""

    #: Most entries of the table of passages and words; beyond it, membership is looked up by search.
    TABLE = 1 << 27

    def __init__(self, index: Index):
        self.index = index
        self.number = Lookup(index.known)
        self.square = np.append(index.weight**2, 0.0)
        self.levels = index.windows() if len(index.items) else []
        owner = np.repeat(np.arange(len(index.items)), [len(x) for x in index.items]).astype(np.int64)
        words = self.number(np.concatenate(index.items)) if len(index.items) else np.zeros(0, np.int64)
        self.base = len(index.known) + 1
        self.postings = [Postings([self.number(index.items[i]) for i in items], self.square, len(index.known)) if len(items) else None for _, items in self.levels]
        self.has = None
        if len(index.items) * self.base <= self.TABLE:
            self.has = np.zeros((len(index.items), self.base), bool)
            self.has[owner, words] = True
        else:
            self.pairs = np.unique(owner * self.base + words)

    def _member(self, items: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Whether each passage has each of its row of words (-1: none)."""
        if self.has is not None:
            return self.has[items[:, None], words]
        key = items[:, None] * self.base + words
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return (self.pairs[at] == key) & (words >= 0)

    def __call__(self, texts: Texts) -> dict[int, dict[int, float]]:
        """For each document (number in the batch) found: passages (number) with their share of words."""
        out: dict[int, dict[int, float]] = {}
        if not len(self.index.known):
            return out
        for lo, hi in texts.slices(1 << 20):
            starts, ends, first = texts.words(lo, hi, alnum=True)
            if not len(starts):
                continue
            h = texts.hashes(starts, ends)
            at = self.number(h)
            known = np.flatnonzero(at >= 0)
            for (wide, items), postings in zip(self.levels, self.postings, strict=True):
                if len(items):
                    self._level(out, lo, h, at, known, first, wide, items, postings)
        return out

    def _level(self, out: dict, lo: int, h: np.ndarray, at: np.ndarray, known: np.ndarray, first: np.ndarray, wide: int, items: np.ndarray, postings: Postings) -> None:
        """Windows are two neighbouring blocks of half their width, so each word is summed once."""
        index, step = self.index, wide // 2
        size = np.diff(first)
        blocks = -(-size // step)
        doc = np.repeat(np.arange(len(size)), blocks)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = first[doc] + nth * step
        cut = np.searchsorted(known, np.append(begin, first[-1]))
        full = np.flatnonzero(cut[1:] > cut[:-1])
        if not len(full):
            return
        words = at[known]
        seen = set()
        for where, which in postings(words, np.repeat(np.arange(len(begin)), np.diff(cut)), doc):
            for a, item in zip(where.tolist(), items[which].tolist(), strict=True):
                d = int(doc[a])
                seen.add((a, item))
                self._confirm(out, lo + d, item, h, int(begin[a]), min(int(begin[a]) + wide, int(first[d + 1])), int(first[d]), int(first[d + 1]))
        latent = np.zeros((len(begin), index.vectors.shape[1]), np.float32)
        energy = np.zeros(len(begin))
        for a in range(0, len(full), 4096):  # blocks without known words lie between; they stay zero
            f = full[a : a + 4096]
            part = words[cut[f[0]] : cut[f[-1] + 1]]
            latent[f] = np.add.reduceat(index.vectors[part], cut[f] - cut[f[0]], axis=0)
            energy[f] = np.add.reduceat(self.square[part], cut[f] - cut[f[0]])
        more = np.append(doc[1:] == doc[:-1], False)  # whether a block has a next one
        head = np.flatnonzero(more | (nth == 0))
        joined = more[head].astype(np.float32)
        after = np.minimum(head + 1, len(begin) - 1)
        # The weight shared with a passage is at most that of the window's known words.
        some = energy[head] + joined * energy[after] >= COVER * index.energy[items].min() - 1e-9
        head, joined, after = head[some], joined[some], after[some]
        for a in range(0, len(head), 4096):
            w, j, z = head[a : a + 4096], joined[a : a + 4096], after[a : a + 4096]
            v = latent[w] + j[:, None] * latent[z]
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            place = begin[w, None] + np.arange(wide)
            ids = np.where(place < first[doc[w] + 1][:, None], at[np.minimum(place, len(at) - 1)], -1)
            for block in range(0, len(items), 4096):
                here = items[block : block + 4096]
                i, k = np.nonzero(v @ index.latent[here].T >= COSINE)
                for c in range(0, len(i), 1 << 16):
                    self._candidates(out, lo, h, first, doc[w], begin[w], ids, wide, i[c : c + (1 << 16)], here[k[c : c + (1 << 16)]], w, seen)

    def _candidates(self, out: dict, lo: int, h: np.ndarray, first: np.ndarray, doc: np.ndarray, begin: np.ndarray, ids: np.ndarray, wide: int, i: np.ndarray, item: np.ndarray, block: np.ndarray, seen: set[tuple[int, int]]) -> None:
        """Of windows near a passage, those that cover enough of its weight are held against it."""
        shared = (self._member(item, ids[i]) * self.square[ids[i]]).sum(1)
        for n in np.flatnonzero(shared >= COVER * self.index.energy[item] - 1e-9):
            if (int(block[i[n]]), int(item[n])) in seen:
                continue
            d, a = int(doc[i[n]]), int(begin[i[n]])
            self._confirm(out, lo + d, int(item[n]), h, a, min(a + wide, int(first[d + 1])), int(first[d]), int(first[d + 1]))

    def _confirm(self, out: dict, doc: int, item: int, h: np.ndarray, a: int, b: int, lo: int, hi: int) -> None:
        words = self.index.items[item]
        got = out.get(doc, {}).get(item, 0.0)
        if got >= 1.0:
            return
        near = h[max(lo, a - len(words)) : min(hi, b + len(words))]
        if common_subsequence(words, near) < max(PARAPHRASE, got) * len(words):
            return
        # Words strewn over a wider stretch are no copy.
        step, wide, answer = max(1, len(words) // 8), int(np.ceil(STRETCH * len(words))) + 1, self.index.answers[item]
        for at in range(0, max(1, len(near) - wide + step), step):
            part = near[at : at + wide]
            share = common_subsequence(words, part) / len(words)
            if share < PARAPHRASE or share <= got:
                continue
            if share < VERBATIM and (not len(answer) or common_subsequence(answer, part) < ANSWER * len(answer)):
                continue
            out.setdefault(doc, {})[item] = got = share


def _blocks(benchmark: DataFrame) -> list[DataFrame]:
    """The passages in parts that are small enough to broadcast, by a hash of item_id."""
    size = benchmark.agg(F.count("*").alias("n"), F.sum(F.char_length("text")).alias("c")).first()
    n = max(1, -(-size["n"] // BLOCK_ITEMS), -(-(size["c"] or 0) // (4 * BLOCK_WORDS)))
    if n == 1:
        return [benchmark]
    return [benchmark.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k) for k in range(n)]


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, item_ids (ascending), best_share for every row of ``docs`` (doc_id, text)."""
    whole = docs.select(F.col("doc_id").cast("long"), "text", F.array().cast("array<long>").alias("item_ids"), F.lit(0.0).alias("best_share"))
    blocks = _blocks(benchmark.select("item_id", "text"))
    for k, block in enumerate(blocks):
        shared, name = docs.sparkSession.sparkContext.broadcast(build_index(docs, block)), uuid.uuid4().hex
        # Each row carries what was found so far to the next block; the last one needs no texts.
        columns = ["doc_id", "text"] if k < len(blocks) - 1 else ["doc_id"]

        def find(batches: Iterator[pa.RecordBatch], shared=shared, name=name, columns=columns) -> Iterator[pa.RecordBatch]:
            search = kept(name, lambda: Search(shared.value))
            for batch in batches:
                found = search(Texts(batch.column(1)))
                ids = [sorted(old + [shared.value.item_ids[i] for i in found.get(d, ())]) for d, old in enumerate(batch.column(2).to_pylist())]
                best = [max(old, *found[d].values()) if d in found else old for d, old in enumerate(batch.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(ids, pa.list_(pa.int64())), pa.array(best, pa.float64())], names=[*columns, "item_ids", "best_share"])

        whole = whole.mapInArrow(find, "doc_id long, " + "text string, " * (len(columns) - 1) + "item_ids array<long>, best_share double")
    return whole.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), "item_ids", "best_share")


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, in which no passage of the benchmark is found."""
    left = docs
    for block in _blocks(benchmark.select("item_id", "text")):
        shared, name = docs.sparkSession.sparkContext.broadcast(build_index(docs, block)), uuid.uuid4().hex

        def keep(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            search = kept(name, lambda: Search(shared.value))
            for batch in batches:
                found = search(Texts(batch.column("text")))
                ok = np.ones(batch.num_rows, bool)
                ok[list(found)] = False
                yield batch.filter(pa.array(ok))

        left = left.mapInArrow(keep, docs.schema)
    return left
