"""Ids and texts against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tablewise.llm import bpe
from tablewise.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["the", "ing", " ", "  ", "\n", "\t", "a", "A", "é", "漢", "1", "२", "\x1c", "\x85", "\xa0", "　", "​"]
PARTS += ["🙂", "́", "'s", "'ll", "<|endoftext|>", "<|", "!!", "\x00", "\r\n", "ß", "aaaa", "==", "\U000e0001", "﻿"]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.load(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


def test_query_on_given_documents(spark, library):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op2_bpe"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(np.array(ids, dtype="<u4").tobytes()))
        assert r.decoded_sha256 == sha(back.encode())


def test_fuzz_against_the_library(vocabulary, library):
    rnd = random.Random(3)
    texts = ["".join(rnd.choices(PARTS, k=rnd.randint(0, 30))) for _ in range(8000)]
    texts += ["".join(chr(rnd.choice([rnd.randrange(32, 0x3000), rnd.randrange(0xE000, 0x1FFFF)])) for _ in range(20)) for _ in range(1000)]
    encoder = bpe.Encoder(vocabulary)
    for want, got in zip(library.encode_batch(texts, add_special_tokens=False), encoder([t.encode() for t in texts])):
        assert want.ids == got.tolist()
        assert library.decode(want.ids, skip_special_tokens=False) == bpe.decoded(vocabulary, got)


def test_broken_bytes_become_replacement_signs(vocabulary, library):
    rnd = np.random.default_rng(5)
    for _ in range(300):
        ids = rnd.integers(0, 256, 12)
        assert library.decode(ids.tolist(), skip_special_tokens=False) == bpe.decoded(vocabulary, ids)


def test_merges_side_by_side(vocabulary, library):
    rnd = random.Random(1)
    words = ["".join(rnd.choices("abeinorst", k=rnd.randint(1, 14))) for _ in range(3000)] + ["a" * n for n in range(1, 40)]
    got = vocabulary.merged([w.encode() for w in words])
    assert got == [e.ids for e in library.encode_batch(words, add_special_tokens=False)]


def test_pairs_against_whole_merges(vocabulary):
    rnd = np.random.default_rng(2)
    a, b = rnd.integers(0, 3000, 3000), rnd.integers(0, 3000, 3000)
    whole = vocabulary.merged([vocabulary.tokens[x] + vocabulary.tokens[y] for x, y in zip(a, b)])
    want = [w == [x, y] for w, x, y in zip(whole, a.tolist(), b.tolist())]
    assert vocabulary.compatible(a, b).tolist() == want


def test_round_trip_and_odd_rows(spark, vocabulary):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Hi <|endoftext|> é", "x"), (3, "Hi <|endoftext|> é", "x"), (4, "ab " * 300_000, "x"), (None, "n", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.encode(docs, vocabulary)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
    back = {r.doc_id: r.text for r in bpe.decode(out.select("doc_id", "ids"), vocabulary).collect()}
    assert back == {i: t or "" for i, t, _ in rows}
    assert {r.doc_id: r.n_tokens for r in out.collect()}[1] == 0
    assert bpe.encode(docs.limit(0), vocabulary).count() == 0


def test_other_kinds_of_files_are_refused():
    with pytest.raises(ValueError):
        bpe.Vocabulary.load(public_tokenizers.path("word_bpe_49k.json"))
