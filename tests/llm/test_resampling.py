"""Importance resampling against plain Python."""

import hashlib
import math
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from tablewise.llm import resampling
from tablewise.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _features(text, grams):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(lower)
    return len(words), [" ".join(words[i : i + n]) for n in range(1, grams + 1) for i in range(len(words) - n + 1)]


def brute_force(docs, target, s):
    def counts(texts):
        out = [0] * s.buckets
        for t in texts:
            for f in _features(t, s.grams)[1]:
                out[crc32(f.encode()) % s.buckets] += 1
        return out

    source, wanted = counts([t for _, t in docs]), counts(target)
    n, m = sum(source) + s.buckets, sum(wanted) + s.buckets
    gain = [math.floor(1000 * math.log((t + 1) * n / ((c + 1) * m))) for c, t in zip(source, wanted)]
    rows = []
    for k, text in docs:
        words, found = _features(text, s.grams)
        weight = sum(gain[crc32(f.encode()) % s.buckets] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{s.seed}:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((words, (k, len(found), weight, score)))
    long = sorted((r for w, r in rows if w >= s.min_words), key=lambda r: (-r[3], r[0] is None, r[0]))
    quota = len(long) * s.percent // 100
    drawn = [(*r, i + 1) for i, r in enumerate(long[:quota])]
    rest = [(*r, None) for r in long[quota:]] + [(*r, None) for w, r in rows if w < s.min_words]
    return sorted(drawn + rest, key=repr)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_crcs_are_those_of_zlib():
    rng = np.random.default_rng(1)
    sizes = [0, 1, 1, 2, 7, 7, 8, 30, resampling.LONG, resampling.LONG + 1, 5000]
    values = [rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in sizes for _ in range(5)]
    got = resampling.crcs(pa.array([b"skipped", *values], type=pa.large_binary()).slice(1))
    assert got.tolist() == [crc32(v) for v in values]
    assert len(resampling.crcs(pa.array([], type=pa.large_binary()))) == 0


def test_query_is_the_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert _rows(QUERIES["op13_importance_resampling"](spark, FOLDER)) == brute_force(docs, items, resampling.Settings())


@pytest.mark.parametrize("grams", [1, 3])
def test_odd_rows(spark, grams):
    docs = [
        (1, None),
        (2, ""),
        (3, "., \n-"),
        (4, "Ünïcode ÄB ab AB " * 30),
        (5, "x" * 300_000),
        (6, "one two three " * 40_000),
        (6, "one two three " * 40_000),
        (6, "one two four " * 20),
        (None, "ab cd ef " * 10),
        (8, "it's a b c d e f g h i j k l m n o p q r s t u v w"),
    ]
    s = resampling.Settings(grams=grams, buckets=97, percent=60, min_words=3)
    target = ["one two three", None, "", "ab AB"]
    left = spark.createDataFrame([(k, t, "x", 1, 2) for k, t in docs], "doc_id long, text string, score string, rank int, n_words int")
    right = spark.createDataFrame([(t,) for t in target], "text string")
    assert _rows(resampling.draw(left, right, s)) == brute_force(docs, target, s)
    kept = resampling.sample(left, right, s)
    assert kept.columns == left.columns
    want = {r[0] for r in brute_force(docs, target, s) if r[4] is not None} - {None}
    assert {r.doc_id for r in kept.collect()} == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([(k, "a b c d") for k in range(10)], "doc_id long, text string")
    s = resampling.Settings(min_words=1, percent=50)
    assert _rows(resampling.draw(docs.limit(0), docs, s)) == []
    assert _rows(resampling.draw(docs, docs.limit(0), s)) == brute_force([tuple(r) for r in docs.collect()], [], s)
    assert resampling.draw(docs, docs, resampling.Settings()).where("rank IS NOT NULL").isEmpty()
    assert resampling.sample(docs, docs, resampling.Settings()).isEmpty()
