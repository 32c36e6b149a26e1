"""Token ids against the public tokenizer, and edge cases."""

from __future__ import annotations

import random

import pytest

from paperloom.llm.tokenizer import DEFAULT_FILE, Encoder, encode_corpus, encode_long_word, encode_words, load_merges

tokenizers = pytest.importorskip("tokenizers")
TEXTS = ["", "plain words, it's 2024.", "aaaaaaa aaaa", "  \n\t two  blanks ", "<|endoftext|> is text", "naïve β-catenin Ca²⁺ 样本之间 🙂‍↔️", "x" * 5000, "ACGT" * 900, " ​﻿"]


@pytest.fixture(scope="module")
def merges():
    return load_merges()


def test_equal_to_public_tokenizer(merges):
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("abcdeé 0123,.\n") for _ in range(rng.randrange(200))) for _ in range(200)]
    public = tokenizers.Tokenizer.from_file(DEFAULT_FILE)
    public.encode_special_tokens = True
    assert Encoder(merges).encode(texts) == [e.ids for e in public.encode_batch(texts, add_special_tokens=False)]


def test_long_words_by_queue(merges):
    rng = random.Random(5)
    for _ in range(50):
        word = "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(1, 300)))
        assert encode_long_word(word, merges) == encode_words([word], merges)[0]


def test_frame(spark, merges):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "hello", "c"), (3, "hello", "c")], "id int, text string, ids string")
    got = sorted((r.id, list(r.ids)) for r in encode_corpus(df).collect())
    assert got == [(1, []), (2, []), (3, Encoder(merges).encode(["hello"])[0]), (3, Encoder(merges).encode(["hello"])[0])]
    assert {r.id: r.n for r in encode_corpus(df, out="n", counts_only=True).collect()} == {1: 0, 2: 0, 3: 1}
    assert encode_corpus(df.limit(0)).count() == 0
