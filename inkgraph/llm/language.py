"""Language identification by prediction by partial matching (PPM).

Each language has a byte context tree of orders 0 to 3 with method-C escapes: in a context seen
``t`` times with ``d`` different followers, a follower seen ``n`` times costs -log2(n / (t + d)) bits
and an escape to the next shorter context -log2(d / (t + d)). Below order 0 all symbols are alike.
The statistics are frozen after training, so the cost of a byte depends on four bytes only and the
trees are compiled into tables; the code length of a text is a sum of table entries, and the
language with the shortest code is predicted. ``score`` is its share of the posterior 2^-bits.

Symbols: ASCII letters count in lower case; the 63 most frequent bytes of the training rows of a group
of languages are symbols of their own, all others are one symbol followed by a plain choice among them.

Training takes about ``per_language`` labelled rows of each language, by a hash of doc_id (a
documented bound; every row is scored, by its whole text). All languages are learned: those of a script
(told by the bytes that begin its letters) share a symbol table, in groups of at most ``GROUP``, so the
tables sent to the workers at once are bounded. Each group is a pass over the documents, which carry
their shortest code so far; the four languages of the test tables are one group.

Defined cases: a text that is null, empty or without letters is ``und`` with score 0; so is every
text when nothing was learned; rows with a null doc_id are not held out and not learned from; repeated
rows repeat their result and count again in training; texts of any length are scored whole, half a
million bytes at a time; equal code lengths go to the first language by code point; an empty table
gives an empty result; other columns are ignored, or kept by ``identified``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkgraph.llm.textbuf import Texts
from inkgraph.llm.worker import kept
from inkgraph.plans.tables import Scratch

ORDER = 3
SYMBOLS = 64
PER_LANGUAGE = 5_000
#: Languages of one set of tables, about 3.5 MB each.
GROUP = 64
#: Share of bytes that are not ASCII from which on a language's script is told by them.
OTHER_SCRIPT = 0.3
UND = "und"
#: Bits a byte above which a text is in none of the languages; prose takes two to four.
MOST_BITS = 6.5

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Bytes scored or counted at once; a worker holds about 30 bytes for each.
CHUNK = 1 << 19
#: What stands before the first byte of a text.
PAD = 0x0A


@dataclass
class Model:
    languages: list[str]
    symbol: np.ndarray  # of each byte
    keys: np.ndarray  # four-symbol contexts seen, sorted
    seen: np.ndarray  # (keys, languages): bits
    short: np.ndarray  # (64^3, languages): bits of the last symbol by order 2 and below
    escape: np.ndarray  # (64^3, languages): bits of leaving an order-3 context
    place: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"place": None}

    def code_lengths(self, texts: Texts, lo: int, hi: int) -> np.ndarray:
        """(documents, languages): bits of each whole text."""
        if self.place is None:
            self.place = np.full(SYMBOLS ** (ORDER + 1), -1, np.int32)
            self.place[self.keys] = np.arange(len(self.keys), dtype=np.int32)
        off = texts.off[lo : hi + 1]
        total = np.zeros((hi - lo, len(self.languages)))
        for a in range(off[0], off[-1], CHUNK):  # also a huge text is never expanded at once
            b = min(off[-1], a + CHUNK)
            key = _keys(texts, self.symbol, off, a, b)
            at = self.place[key]
            bits = self.seen[np.maximum(at, 0)]
            new = np.flatnonzero(at < 0)
            if len(new):
                bits[new] = self.escape[key[new] >> 6] + self.short[key[new] & (SYMBOLS**3 - 1)]
            d0, d1 = np.searchsorted(off, a, "right") - 1, np.searchsorted(off, b, "left")
            begins = np.maximum(off[d0:d1], a)
            full = np.flatnonzero(np.minimum(off[d0 + 1 : d1 + 1], b) > begins)
            if len(full):
                total[d0 + full] += np.add.reduceat(bits, begins[full] - a, axis=0, dtype=np.float64)
        return total


def _keys(texts: Texts, symbol: np.ndarray, off: np.ndarray, a: int, b: int) -> np.ndarray:
    """The four-symbol key of each byte a..b; contexts don't reach over the start of a text."""
    from_ = max(off[0], a - ORDER)
    s = symbol[texts.data[from_:b]].astype(np.int32)
    s = np.concatenate([np.full(ORDER - (a - from_), symbol[PAD], np.int32), s])
    n = b - a
    key = (s[:n] << 18) | (s[1 : n + 1] << 12) | (s[2 : n + 2] << 6) | s[3 : n + 3]
    pad = int(symbol[PAD])
    starts = off[:-1][(off[:-1] > a - ORDER) & (off[:-1] < b)]
    for j in range(ORDER):  # the j-th byte of a text has 3 - j pads before it
        at = starts + j
        at = at[(at >= a) & (at < b)] - a
        kept = (1 << 6 * (j + 1)) - 1
        pads = sum(pad << 6 * k for k in range(j + 1, ORDER + 1))
        key[at] = (key[at] & kept) | pads
    return key


def fit(languages: list[str], number: np.ndarray, gram: np.ndarray, n: np.ndarray) -> Model:
    """The frozen model from counts: the language's number, a four-byte gram as an unsigned 32-bit
    number, and how often it was seen."""
    n = n.astype(np.float64)
    by_byte = np.bincount(gram & 255, weights=n, minlength=256)
    common = np.argsort(-by_byte, kind="stable")[: SYMBOLS - 1]
    common = common[by_byte[common] > 0]
    symbol = np.zeros(256, np.uint8)
    symbol[common] = np.arange(1, len(common) + 1)
    symbol = symbol[_FOLD]
    key = np.zeros(len(gram), np.int64)
    for k in range(ORDER + 1):
        key |= symbol[(gram >> (8 * k)) & 255].astype(np.int64) << (6 * k)
    keys = np.unique(key)
    size = SYMBOLS**3
    seen = np.zeros((len(keys), len(languages)), np.float32)
    short = np.zeros((size, len(languages)), np.float32)
    escape = np.zeros((size, len(languages)), np.float32)
    rare = np.zeros(SYMBOLS)
    rare[0] = np.log2(256 - len(common))
    for i in range(len(languages)):
        own = number == i
        full = np.bincount(np.searchsorted(keys, key[own]), weights=n[own], minlength=len(keys))
        lower = np.full(SYMBOLS, np.log2(SYMBOLS)) + rare  # order -1
        for order in range(ORDER + 1):
            ctx_sym = keys & (SYMBOLS ** (order + 1) - 1)
            if order < ORDER:
                cnt = np.bincount(ctx_sym, weights=full, minlength=SYMBOLS ** (order + 1)).reshape(-1, SYMBOLS)
                t, d = cnt.sum(1, keepdims=True), (cnt > 0).sum(1, keepdims=True)
                with np.errstate(divide="ignore", invalid="ignore"):
                    leave = np.where(t > 0, -np.log2(d / (t + d)), 0.0)
                    direct = -np.log2(cnt / (t + d)) + np.where(np.arange(SYMBOLS) == 0, rare, 0.0)
                below = np.tile(lower.reshape(-1, SYMBOLS), (len(cnt) // max(1, lower.size // SYMBOLS), 1))
                lower = np.where(cnt > 0, direct, leave + below)
            else:
                ctx = keys >> 6
                t = np.bincount(ctx, weights=full, minlength=size)
                d = np.bincount(ctx, weights=full > 0, minlength=size)
                with np.errstate(divide="ignore", invalid="ignore"):
                    leave = np.where(t > 0, -np.log2(d / (t + d)), 0.0)
                    direct = -np.log2(full / (t + d)[ctx]) + rare[keys & 63]
                short[:, i] = lower.reshape(-1)
                escape[:, i] = leave
                seen[:, i] = np.where(full > 0, direct, leave[ctx] + lower.reshape(-1)[ctx_sym & (size - 1)])
    return Model(languages, symbol, keys, seen, short, escape)


def remainder(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def _script(by_byte: np.ndarray) -> int:
    """A number for the script of a language: 0 for the Latin one, else its commonest leading byte but for
    the last bits, in which the leading bytes of one script differ."""
    lead = by_byte.copy()
    lead[:0xC2] = 0
    if by_byte[128:].sum() <= OTHER_SCRIPT * by_byte.sum():
        return 0
    top = int(lead.argmax())
    return top >> 1 if top < 0xE0 else top >> 3


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> list[Model]:
    """Models of the rows (doc_id, text, lang) with both known, sampled to the documented bound: one for
    each group of languages, none if there is nothing to learn."""
    rows = labelled.where("lang is not null and doc_id is not null")
    sizes = rows.groupBy("lang").count().collect()
    if not sizes:
        return []
    shares = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, per_language / r["count"]))])
    part = (F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1_000_000)) / 1_000_000) < shares[F.col("lang")]
    symbol = np.arange(256, dtype=np.uint8)[_FOLD]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                texts = Texts(batch.column(0).filter(pa.array([x == lang for x in langs])))
                for lo, hi in texts.slices(CHUNK):
                    off = texts.off[lo : hi + 1]
                    for a in range(off[0], off[-1], CHUNK):
                        gram, n = np.unique(_grams(texts, symbol, off, a, min(off[-1], a + CHUNK)), return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram, pa.int64()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    counted = rows.where(part).select("text", "lang").mapInArrow(count, "lang string, gram long, n long")
    scratch = Scratch(labelled.sparkSession, "language")
    counted, at = scratch.keep_at(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    # A language none of whose sampled rows has a text was not learned.
    histogram = counted.groupBy("lang", F.col("gram").bitwiseAND(F.lit(255)).alias("byte")).agg(F.sum("n").alias("n")).collect()
    by_byte: dict[str, np.ndarray] = {}
    for r in histogram:
        by_byte.setdefault(r["lang"], np.zeros(256))[r["byte"]] += r["n"]
    scripts: dict[int, list[str]] = {}
    for lang in sorted(by_byte):
        scripts.setdefault(_script(by_byte[lang]), []).append(lang)
    models = []
    for _, names in sorted(scripts.items()):
        for k in range(0, len(names), GROUP):
            languages = names[k : k + GROUP]
            named = F.array_position(F.array(*[F.lit(x) for x in languages]), F.col("lang")) - 1
            got = counted.where(F.col("lang").isin(languages)).select(named.cast("int").alias("k"), "gram", "n").toArrow()
            models.append(fit(languages, got["k"].to_numpy(), got["gram"].to_numpy(), got["n"].to_numpy()))
    scratch.drop(at)
    return models


def _grams(texts: Texts, symbol: np.ndarray, off: np.ndarray, a: int, b: int) -> np.ndarray:
    """As ``_keys``, with whole bytes."""
    from_ = max(off[0], a - ORDER)
    s = symbol[texts.data[from_:b]].astype(np.int64)
    s = np.concatenate([np.full(ORDER - (a - from_), PAD, np.int64), s])
    n = b - a
    gram = (s[:n] << 24) | (s[1 : n + 1] << 16) | (s[2 : n + 2] << 8) | s[3 : n + 3]
    starts = off[:-1][(off[:-1] > a - ORDER) & (off[:-1] < b)]
    for j in range(ORDER):
        at = starts + j
        at = at[(at >= a) & (at < b)] - a
        gram[at] = (gram[at] & ((1 << 8 * (j + 1)) - 1)) | sum(PAD << 8 * k for k in range(j + 1, ORDER + 1))
    return gram


def _shortest(docs: DataFrame, models: list[Model]) -> DataFrame:
    """``docs`` plus _lang, _least (bits of its shortest code) and _total (the sum of 2^(least - bits) over all
    languages). The text is a column, then left out, or that of a column ``_row``, which is kept."""
    out = docs.withColumns({"_lang": F.lit(None).cast("string"), "_least": F.lit(float("inf")), "_total": F.lit(0.0)})
    scratch = Scratch(docs.sparkSession, "language")
    for k, model in enumerate(models):
        columns = [c for c in out.columns if c != "text" or k < len(models) - 1]
        shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

        def score(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared, name: str = name, columns: list[str] = columns) -> Iterator[pa.RecordBatch]:
            frozen = kept(name, lambda: shared.value)
            names = np.array(frozen.languages, object)
            for batch in batches:
                texts = Texts(batch.column("text") if "text" in batch.schema.names else batch.column("_row").field("text"))
                lang = np.array(batch.column("_lang").to_pylist(), object)
                least, total = (batch.column(c).to_numpy(zero_copy_only=False).copy() for c in ("_least", "_total"))
                for lo, hi in texts.slices():
                    bits = frozen.code_lengths(texts, lo, hi)
                    best = bits.argmin(1)
                    own, before = bits[np.arange(hi - lo), best], least[lo:hi]
                    first = [b is None or o < e or (o == e and x < b) for b, o, e, x in zip(lang[lo:hi], own, before, names[best], strict=True)]
                    now = np.minimum(own, before)
                    lang[lo:hi] = np.where(first, names[best], lang[lo:hi])
                    total[lo:hi] = total[lo:hi] * np.exp2(np.maximum(now - before, -1000.0)) + np.exp2(np.maximum(now[:, None] - bits, -1000.0)).sum(1)
                    least[lo:hi] = now
                rest = [batch.column(c) for c in columns[:-3]]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(lang.tolist(), pa.string()), pa.array(least), pa.array(total)], names=columns)

        out = out.mapInArrow(score, T.StructType([out.schema[c] for c in columns]))
        if k < len(models) - 1:
            out = scratch.keep(out, "scored")
    return out.drop("text")


def predictions(docs: DataFrame, models: list[Model]) -> DataFrame:
    """doc_id, lang_pred, score, bits_per_byte for every row of ``docs`` (doc_id, text)."""
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letters")
    size = F.greatest(F.lit(1), F.coalesce(F.octet_length("text"), F.lit(0))).alias("_size")
    got = _shortest(docs.select(F.col("doc_id").cast("long"), "text", letters, size), models)
    told = F.col("_letters") & F.col("_lang").isNotNull()
    return got.select(
        "doc_id",
        F.when(told, F.col("_lang")).otherwise(F.lit(UND)).alias("lang_pred"),
        F.when(told, 1 / F.col("_total")).otherwise(F.lit(0.0)).alias("score"),
        F.when(F.col("_lang").isNotNull(), F.col("_least") / F.col("_size")).otherwise(F.lit(0.0)).alias("bits_per_byte"),
    )


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Predictions for all of ``docs``, learned from the rows whose remainder is not 1."""
    models = train(docs.select("doc_id", "text", "lang").where(remainder() != 1), per_language)
    held = F.coalesce(remainder() == 1, F.lit(False)).alias("held_out")
    return predictions(docs, models).select("doc_id", held, "lang_pred", "score", "bits_per_byte")


def identified(docs: DataFrame, models: list[Model], most_bits: float = MOST_BITS) -> DataFrame:
    """The rows of ``docs``, all columns, whose language can be told.

    Rejected are texts that are null or without letters, and texts that even the best language
    needs more than ``most_bits`` bits a byte for (encoded data, scripts never seen).
    """
    # The row rides along whole, so that no name of its columns can clash.
    rows = docs.where(F.col("text").rlike(r"\p{L}")).select(F.struct("*").alias("_row"))
    got = _shortest(rows, models).where("_lang is not null")
    return got.where(F.col("_least") <= most_bits * F.octet_length("_row.text")).select("_row.*")
