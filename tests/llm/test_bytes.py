"""Byte-level building blocks: words and hashes, the range coder, checksums, exact chunked counts."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkgraph.llm.queries import vocabulary
from inkgraph.llm.range_coder import decode_block, encode_block
from inkgraph.llm.textbuf import Texts, shingle_sets
from inkgraph.llm.token_files import WordEncoder, combine_crc32
from inkgraph.llm.tokens import Encoder, count_long

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB \n\t\x0b\x1cé日.", max_size=40) | st.none(), max_size=12))
def test_words(texts):
    t = Texts(pa.array(texts, pa.string()))
    starts, ends, first = t.words(0, t.n)
    got = [[t.data[a:b].tobytes().decode() for a, b in zip(starts[first[d] : first[d + 1]], ends[first[d] : first[d + 1]], strict=True)] for d in range(t.n)]
    want = [WORD.findall(x or "") for x in texts]
    assert got == want
    flat = [w for x in want for w in x]
    for lower, key in ((True, lambda w: "".join(c.lower() if c.isascii() else c for c in w)), (False, str)):
        by = {}
        for h, w in zip(t.hashes(starts, ends, lower=lower).tolist(), flat, strict=True):
            assert by.setdefault(h, key(w)) == key(w)
        assert len(set(by.values())) == len(by)


def test_words_over_slices_and_chunks():
    r = random.Random(0)
    texts = ["".join(r.choice("ab \n") for _ in range(r.randint(0, 400_000))) for _ in range(6)] + ["x" * 2_500_000 + " y", "x" * 2_500_000]
    t = Texts(pa.array(texts))
    sets = list(shingle_sets(t, 1))
    assert [len(s) for s in sets] == [len(set(x.split())) for x in texts]
    assert np.intersect1d(sets[-1], sets[-2]).size == 1


def thue_morse(n, swap=False):
    return "".join("ab"[(k.bit_count() + swap) % 2] for k in range(n))


@pytest.mark.parametrize("n", [64, 1024, 4096])
def test_no_collision_by_construction(n):
    """A Thue-Morse word and its complement have equal polynomial hashes modulo 2^64, whatever the base."""
    from tokenizers import Tokenizer

    pair = [thue_morse(n), thue_morse(n, True)]
    t = Texts(pa.array(pair))
    for width in (1, 2):
        one, other = shingle_sets(Texts(pa.array([f"{w} end" for w in pair])), width)
        assert one.tolist() != other.tolist()
    lib = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    ids, off = WordEncoder(vocabulary("word_bpe_49k.json")).encode(t, 0, 2)
    assert [ids[off[i] : off[i + 1] - 1].tolist() for i in range(2)] == [lib.encode(w, add_special_tokens=False).ids for w in pair]


def test_words_with_equal_keys(monkeypatch):
    """Words whose keys are equal are told apart by their bytes."""
    from tokenizers import Tokenizer

    from inkgraph.llm import token_files

    monkeypatch.setattr(token_files, "run_hashes", lambda data, starts, ends, other=False: np.full(len(starts), 5, np.uint64))
    lib, enc = Tokenizer.from_file(vocabulary("word_bpe_49k.json")), WordEncoder(vocabulary("word_bpe_49k.json"))
    texts = ["a ab abc abcdefgh abcdefghi abcdefghj", "abcdefghij abcdefghi x" + "y" * 40 + " x" + "y" * 39 + "z ab", "abcdefghj <|endoftext|> <|ENDOFTEXT|>"]
    for _ in range(2):
        ids, off = enc.encode(Texts(pa.array(texts)), 0, 3)
        assert [ids[off[i] : off[i + 1] - 1].tolist() for i in range(3)] == [lib.encode(x, add_special_tokens=False).ids for x in texts]


def test_word_table_starts_afresh(monkeypatch):
    from tokenizers import Tokenizer

    from inkgraph.llm import token_files

    monkeypatch.setattr(token_files, "SLOTS", 64)
    monkeypatch.setattr(token_files, "WORDS_AT_ONCE", 20)
    lib, enc = Tokenizer.from_file(vocabulary("word_bpe_49k.json")), WordEncoder(vocabulary("word_bpe_49k.json"))
    r = random.Random(2)
    texts = [" ".join(f"w{i % 97}x" for i in range(a, a + 300)) for a in (0, 50)]
    texts += [" ".join(r.choice(["the", "cat", "sat", "on", "mats,", f"once{r.randrange(10**6)}"]) for _ in range(400)) for _ in range(3)]
    for _ in range(2):
        ids, off = enc.encode(Texts(pa.array(texts)), 0, 5)
        assert [ids[off[i] : off[i + 1] - 1].tolist() for i in range(5)] == [lib.encode(x, add_special_tokens=False).ids for x in texts]
    assert enc.n <= 64


def test_shingles():
    s = list(shingle_sets(Texts(pa.array(["A b c", "a B c d", "a", None, "", " \n"])), 2))
    assert [len(x) for x in s] == [2, 3, 1, 0, 0, 0] and set(s[0]) <= set(s[1]) and not set(s[2]) & set(s[1])


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 129, 1000, 40_000])
def test_coder_round_trip(n):
    r = np.random.default_rng(n)
    for ids in (r.integers(0, 500, n), np.full(n, 499), r.zipf(1.4, n) % 500, np.tile(r.integers(0, 500, 40), n // 40 + 1)[:n]):
        got, index = decode_block(encode_block(ids, 500, b"index"))
        assert (got == ids).all() and index == b"index"


def test_coder_compresses_and_is_checked():
    ids = np.tile(np.random.default_rng(1).integers(0, 49_000, 50), 400)
    block = encode_block(ids, 49_408)
    assert len(block) < len(ids) / 2  # repeated contexts cost well under 16 bits
    for at in (0, 5, 19, 30, len(block) // 2, len(block) - 1):
        broken = bytearray(block)
        broken[at] ^= 4
        with pytest.raises(ValueError):
            decode_block(bytes(broken))
    with pytest.raises(ValueError):
        decode_block(block[:10])


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=200), st.binary(max_size=200))
def test_combined_checksums(a, b):
    assert combine_crc32(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


PARTS = ["a", "B", " ", "'s", "'S", "É", "é", "́", "<|endoftext|>", "<|startoftext|>", "\n", "\t", "1", "23", ".", " ,", "...", "İ", "ß", "Σ", "日本", " ", "\x85", "\x1c", "|>", "'", "ﬁ", "The", "the.", "thé,", "   ", "<s>", "▁"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_word_encoder_is_the_library(name):
    r = random.Random(5)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 50))) for _ in range(1500)] + ["", " ", "x" * 3000]
    enc = WordEncoder(vocabulary(name))
    t = Texts(pa.array(texts))
    ids, off = enc.encode(t, 0, t.n)
    want = enc.library.encode_batch(texts, add_special_tokens=False)
    assert all(ids[off[i] : off[i + 1]].tolist() == e.ids + [1] for i, e in enumerate(want))


def test_word_table_starts_afresh(monkeypatch):
    from inkgraph.llm import token_files

    monkeypatch.setattr(token_files, "SLOTS", 256)
    monkeypatch.setattr(token_files, "WORDS_AT_ONCE", 40)
    enc = WordEncoder(vocabulary("word_bpe_49k.json"))
    r = random.Random(6)
    for _ in range(20):
        texts = [" ".join(r.choice("abcdefgh") * r.randint(1, 9) for _ in range(30)) for _ in range(3)]
        t = Texts(pa.array(texts))
        ids, off = enc.encode(t, 0, t.n)
        assert [ids[off[i] : off[i + 1]].tolist() for i in range(3)] == [enc._ids(x) + [1] for x in texts]


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "word_bpe_49k.json", "byte_bpe_50k.json"])
def test_chunked_counts(name):
    r = random.Random(7)
    enc = Encoder(vocabulary(name))
    texts = ["".join(r.choice(PARTS) for _ in range(r.randint(10, 1500))) for _ in range(25)]
    texts += ["x" * 5000, " " * 3000 + "a" * 100 + " " * 4000, "ab" * 700 + " cd" * 3 + "q" * 2000]
    assert [count_long(enc, x, 256, 16) for x in texts] == [enc.counts([x])[0] for x in texts]
