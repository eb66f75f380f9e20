"""Token counts against the library itself."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from isobath.llm import token_counts
from isobath.llm.token_counts import TokenCounter, count_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
MARK = "<|endoftext|>"
ODD = ["\0", "\1", "\2", "\x0b", "\x0c", "\x1c", "\x1f", "\x7f", "\x85", " ", " ", " ", " ", "​", "　", "﻿", "\r", "\n", "\t", " ", "  ", "   ", "\n\n", " \n", MARK, "<|endof", "'s", "'LL", "'"]
WORDS = ["the", "House", "über", "naïve", "日本語", "русский", "é", "🙂", "👩‍👩‍👧", "12", "3.14", "٣", "x²", "Ⅷ", "!?", "--", "aaaaaaa", "a" * 300, "Straße", "İ", "don't"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def random_texts(n, seed):
    pick = random.Random(seed)
    for _ in range(n):
        kinds = pick.choice([(ODD, WORDS), (ODD, WORDS, [" "]), (ODD,), (["\0", "\1", " "], ["a", "bc", "\0"]), ([" ", "\n", "\t"], ["a", ""])])
        yield "".join(pick.choice(pick.choice(kinds)) for _ in range(pick.randrange(14)))


@pytest.mark.parametrize("cache", [400_000, 50])
def test_random_texts_equal_the_library(library, monkeypatch, cache):
    monkeypatch.setattr(token_counts, "CACHE", cache)
    counter, texts = TokenCounter(PATH), list(random_texts(25_000 if cache > 50 else 2_000, cache))
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    got = []
    for i in range(0, len(texts), 500):
        got += counter.count(texts[i : i + 500])
    assert [(t, a, b) for t, a, b in zip(texts, want, got) if a != b] == []


def test_rows(spark, library):
    texts = [None, "", " ", "a", "a", MARK, f"x {MARK}y", "\0 \0\1 \1", " lead", "trail ", "word " * 60_000, "z" * 20_000, "tab\t\tnew\n\n\n line"]
    docs = spark.createDataFrame([(i, t, -1, [i]) for i, t in enumerate(texts)] + [(None, "no id", -1, [])], "id long, text string, N_TOKENS long, `a.b` array<long>").repartition(3)
    got = count_tokens(docs, PATH, limit=5)
    assert sorted(got.columns) == sorted(["id", "text", "a.b", "n_bytes", "n_tokens", "over_limit"])
    rows = {r.id: r for r in got.collect()}
    assert len(rows) == len(texts) + 1
    for i, t in [*enumerate(texts), (None, "no id")]:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (rows[i].n_bytes, rows[i].n_tokens, rows[i].over_limit) == (len((t or "").encode()), n, n > 5), i
    none = count_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH)
    assert none.collect() == [] and none.columns == ["doc_id", "text", "n_bytes", "n_tokens", "over_limit"]


def test_whole_table_equals_the_library(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.n_tokens for r in count_tokens(docs, PATH).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == len(library.encode(r.text or "", add_special_tokens=False).ids)
