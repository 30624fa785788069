"""Exact token counts, with overlap resynchronisation for huge documents.

A document of at most ``chunk`` characters is encoded whole. A longer one is encoded in chunks that
overlap, with the offsets of their tokens. Two neighbouring chunks are spliced at a position of the
overlap that is a stable boundary: a space after a character that is no space, where no piece of
the vocabulary can lie across (``Encoder`` proves this from the pieces, or from the pre-tokenizer's
splitting at white space), and where both encodings end a token and go on with the same tokens.
Without such a position the overlap is doubled, at last up to the whole rest of the document.

Defined cases: null and empty texts have 0 bytes and 0 tokens; rows with a null doc_id are rows like
others; repeated rows count again; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgraph.llm.worker import kept

CHUNK, OVERLAP = 32_768, 512
#: Tokens after a splice that both encodings must share (fewer if the overlap ends before).
AGREE = 8
#: Characters encoded by one call of the library.
CALL = 1 << 20


class Encoder:
    """One library and vocabulary: whole texts to counts, chunks to token ids with offsets."""

    def __init__(self, path: str):
        self.path = path
        if path.endswith(".model"):
            import sentencepiece

            self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
            pieces = (self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size()))
            # A piece with the space mark after another character could lie across a boundary.
            self.splits = not any("▁" in p.lstrip("▁") for p in pieces if len(p) > 1)
        else:
            from tokenizers import Tokenizer

            self.sp, self.hf = None, Tokenizer.from_file(path)
            # A special string with a space in it would be found across a boundary.
            self.splits = not any(" " in t.content or t.lstrip or t.rstrip for t in self.hf.get_added_tokens_decoder().values())

    def counts(self, texts: list[str]) -> list[int]:
        if self.sp:
            return [len(x) for x in self.sp.encode(texts, return_type="numpy", num_threads=1)]
        return [len(x) for x in self.hf.encode_batch(texts, add_special_tokens=False)]

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token ids, and where each token begins and ends in ``text``."""
        if self.sp:
            got = self.sp.encode(text, return_type="offset_mapping")
            ids, places = got["ids"], got["offsets"]
        else:
            got = self.hf.encode(text, add_special_tokens=False)
            ids, places = got.ids, got.offsets
        places = np.array(places, np.int64).reshape(-1, 2)
        return np.array(ids, np.int64), places[:, 0], places[:, 1]


def _stable(text: str, lo: int, hi: int) -> list[int]:
    """Positions in lo..hi of a space after a character that is no space."""
    found, at = [], text.find(" ", max(lo, 1), hi)
    while at >= 0:
        if not text[at - 1].isspace():
            found.append(at)
        at = text.find(" ", at + 1, hi)
    return found


def _splice(text: str, left: tuple, right: tuple, lo: int, hi: int) -> tuple[int, int, int] | None:
    """(position, tokens of left before it, tokens of right before it), from the middle of lo..hi on."""
    places = _stable(text, lo, hi)
    middle = (lo + hi) // 2
    for at in sorted(places, key=lambda p: abs(p - middle)):
        i = int(np.searchsorted(left[1], at))
        j = int(np.searchsorted(right[1], at))
        ends = (not i or left[2][i - 1] <= at) and (not j or right[2][j - 1] <= at)
        n = min(AGREE, len(left[0]) - i, len(right[0]) - j)
        # The last tokens of the left chunk may be cut, so only those well inside are held together.
        n = min(n, int(np.count_nonzero(left[2][i : i + n] < hi - 64)))
        if ends and n > 0 and np.array_equal(left[0][i : i + n], right[0][j : j + n]) and np.array_equal(left[1][i : i + n], right[1][j : j + n]):
            return at, i, j
    return None


def count_long(enc: Encoder, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of ``text`` by spliced chunks; equal to encoding it whole."""
    if not enc.splits:
        return enc.counts([text])[0]
    total, begin, skip, wide = 0, 0, 0, overlap
    end = min(len(text), begin + chunk)
    left = enc.spans(text[begin:end])
    left = (left[0], left[1] + begin, left[2] + begin)
    while end < len(text):
        start = max(begin + 1, end - wide)
        if start == begin + 1:  # the overlap has grown over the whole chunk: take a longer chunk
            end = min(len(text), end + chunk)
            chunk *= 2
            left = enc.spans(text[begin:end])
            left = (left[0], left[1] + begin, left[2] + begin)
            wide = overlap
            continue
        stop = min(len(text), start + max(chunk, 2 * wide))
        right = enc.spans(text[start:stop])
        right = (right[0], right[1] + start, right[2] + start)
        found = _splice(text, left, right, start + 1, end)
        if found is None:
            wide *= 2
            continue
        _, i, j = found
        total += i - skip
        begin, end, left, skip, wide = start, stop, right, j, overlap
    return total + len(left[0]) - skip


def token_counts(docs: DataFrame, path: str, limit: int = 4096, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs`` (doc_id, text).

    ``path`` names the vocabulary file on every machine: ``.json`` is read by tokenizers, ``.model``
    by sentencepiece. No special tokens are added and special strings inside texts are handled as
    the library does by default.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = kept((Encoder, path), lambda: Encoder(path))
        for batch in batches:
            sizes = np.zeros(batch.num_rows, np.int64)
            numbers = np.zeros(batch.num_rows, np.int64)
            group: list[tuple[int, str]] = []
            held = 0

            def flush() -> None:
                nonlocal held
                if group:
                    for (i, _), n in zip(group, enc.counts([t for _, t in group]), strict=True):
                        numbers[i] = n
                    group.clear()
                    held = 0

            for i, cell in enumerate(batch.column(1)):
                text = cell.as_py()
                if not text:
                    continue
                sizes[i] = len(text.encode())
                if len(text) > chunk:
                    numbers[i] = count_long(enc, text, chunk, overlap)
                    continue
                group.append((i, text))
                held += len(text)
                if held >= CALL:
                    flush()
            flush()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), pa.array(numbers), pa.array(numbers > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
