"""Token ids against the tokenizer itself."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltbed.llm import tokens

ALPHABET = ["a", "b", "é", "漢", "字", "1", "2", "!", "'", "s", "t", "re", "ll", " ", "  ", "\n", " \t", "　", "😀", "-", "=", "the", "ing", " cat", "\xa0", "\x1c", "́", "ß", "<|endoftext|>"]


@pytest.fixture(scope="module")
def enc():
    return tokens.encoder()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(ALPHABET), st.sampled_from([1, 1, 1, 2, 30])), max_size=60), st.sampled_from([1, 2, 3, 7, 20, 64]))
def test_exact(parts, leaf):
    enc = tokens.encoder()
    text = "".join(a * n for a, n in parts)
    want = enc.plain(text)
    assert enc.ids(text).tolist() == want
    leaves = [enc.ids(text[i : i + leaf]) for i in range(0, len(text), leaf)]
    assert tokens.concatenate(enc, leaves).tolist() == want


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=200), st.integers(1, 30))
def test_any_text(text, leaf):
    enc = tokens.encoder()
    text = text.encode("utf-8", "ignore").decode()
    leaves = [enc.ids(text[i : i + leaf]) for i in range(0, len(text), leaf)]
    assert tokens.concatenate(enc, leaves).tolist() == enc.plain(text) == enc.ids(text).tolist()


def test_separators_that_are_no_white_space_here():
    enc = tokens.encoder()
    rng = random.Random(5)
    some = ["a", "b", "'s", "1", "!", " ", "  ", "\n", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\u2028", " cat"]
    for _ in range(20_000):
        text = "".join(rng.choice(some) * rng.choice([1, 1, 2, 9]) for _ in range(rng.randrange(4, 30)))
        leaves = [enc.ids(text[i : i + 8]) for i in range(0, len(text), 8)]
        assert tokens.concatenate(enc, leaves).tolist() == enc.plain(text)


def test_same_as_other_library(enc):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{tokens.DIRECTORY}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    rng = random.Random(1)
    for _ in range(100):
        text = "".join(rng.choice(ALPHABET) for _ in range(60))
        assert t.encode(text, add_special_tokens=False).ids == enc.ids(text).tolist()


def test_words_are_bounded(enc, monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_WORDS", 10)
    e = tokens.Encoder(tokens.DIRECTORY, tokens.VOCABULARY)
    text = " ".join(f"w{i}" for i in range(200))
    assert e.ids(text).tolist() == enc.plain(text) and len(e.words) <= 10


def test_table(spark, enc):
    rng = random.Random(4)
    long_run = "x" * 5000 + "é" * 3000 + " " * 2000 + "ab1!" * 2000
    rows = [(1, None, "n"), (2, "", "i"), (3, " \n ", "i"), (4, "<|endoftext|> is text", None), (5, long_run, "x"), (5, long_run, "x"), (None, "no id", ""), (7, "".join(rng.choice(ALPHABET) for _ in range(30_000)), "l")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    for leaf in (97, 1000, 10**6):
        got = sorted(((r["doc_id"], r["ids"]) for r in tokens.encode(df, leaf=leaf).collect()), key=repr)
        assert got == sorted(((d, enc.plain(t) if t else []) for d, t, _ in rows), key=repr)
    counts = {r["doc_id"]: r["n"] for r in tokens.encode(df, leaf=500, count_only=True).collect()}
    assert counts[1] == 0 and counts[5] == len(enc.plain(long_run))
    assert tokens.encode(df.limit(0)).count() == 0
    assert dict(tokens.encode(df).dtypes) == {"doc_id": "bigint", "ids": "array<int>"}


def test_lists_do_not_alias():
    lists = tokens._lists([b"", np.array([1, 2], "<i4").tobytes(), b""])
    assert lists.to_pylist() == [[], [1, 2], []]
