"""The compiled tokenizer against the library that the vocabulary file is for."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from spanweave.llm import token_counts
from tests.llm.data import awkward, documents

PATH = public_tokenizers.path("word_bpe_49k.json")


def want(texts):
    return [len(e.ids) for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.fixture(scope="module")
def count():
    return token_counts.TokenCounter(open(PATH, encoding="utf-8").read())


def random_texts(seed, n=1500):
    rng = random.Random(seed)
    alphabets = ["abcdefghij stmdrelv''  ", "etaoin shrdlu ETAOIN.,!?'\"-", "0123456789 ½²٣", "éÉçñüßſİIıΣσς αβ", "日本語テキスト ﾊﾝ ", "😂😍❤️🇺🇸👨‍👩 ",
                 "éạ̈ ̧", "\x00\x1c\x1d\x1e\x1f\x85\xa0 　​﻿ a1!", "aaaaaaaa", "!!!???...''''", "кирилл ЖЯ אבגع ن"]
    pieces = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|endoftext", "'re", "'ll", "'ve", "'s", "''s", "!'s", "1's", "'t's", "the ", "don't "]
    out = ["", " ", "'", "''", "'r", "'l", "'v", "x'", "x're", "x'r", "<|endoftext|><|endoftext|>", "a<|endoftext|>́b"]
    for _ in range(n):
        alphabet = rng.choice(alphabets)
        out.append("".join(rng.choice(pieces) if rng.random() < 0.05 else rng.choice(alphabet if rng.random() < 0.8 else rng.choice(alphabets)) for _ in range(rng.randint(0, 80))))
    return out


def test_counts_equal_the_library(count):
    texts = random_texts(1)
    got = count(texts).tolist()
    for text, a, b in zip(texts, got, want(texts)):
        assert a == b, (text, a, b)


@pytest.mark.parametrize("chunk, scalar, states", [(1, 16, 1 << 18), (7, 0, 40), (64, 2, 1 << 18)])
def test_chunks_compose(monkeypatch, count, chunk, scalar, states):
    monkeypatch.setattr(token_counts, "CHUNK", chunk)
    monkeypatch.setattr(token_counts, "SCALAR_CHUNKS", scalar)
    monkeypatch.setattr(token_counts, "MOST_STATES", states)
    texts = random_texts(chunk, 200) + ["ab" * 700, "a" * 999 + " " + "x" * 500, "'" * 300 + "s", "😂" * 100]
    assert count(texts).tolist() == want(texts)


def test_every_letter_is_classed_as_the_library_does(count):
    texts = [f"{chr(p)}a{chr(p)}1{chr(p)}!{chr(p)}" for p in range(0x110000) if not 0xD800 <= p < 0xE000 and (p < 0x3100 or p % 97 == 0)]
    assert count(texts).tolist() == want(texts)


def test_scan_composes_in_order():
    rng = np.random.default_rng(0)
    maps = rng.integers(0, 5, (37, 5)).astype(np.int8)
    scanned = token_counts.scan_maps(maps)
    state = np.arange(5)
    for own, all_before in zip(maps, scanned):
        state = own[state]
        assert (state == all_before).all()


def test_documents(spark, monkeypatch):
    rows = awkward() + [(500 + i, t, "en", "s", 0, "", "", "") for i, t in enumerate(random_texts(9, 60))]
    for piece in (1 << 20, 100):
        monkeypatch.setattr(token_counts, "PIECE_CHARS", piece)
        got = token_counts.count_tokens(documents(spark, rows).repartition(3), PATH, limit=20).collect()
        expected = [(i, len((t or "").encode()), n, n > 20) for (i, t, *_), n in zip(rows, want([t for _, t, *_ in rows]))]
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))
    assert token_counts.count_tokens(documents(spark, []), PATH).collect() == []
