"""Suffix arrays, common prefixes, segments and the whole operator against brute force."""

from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from tablewise.llm import suffix_dedup
from tablewise.llm.queries import QUERIES
from tablewise.llm.suffix_dedup import Settings

FOLDER = "/root/testdata/sf0.001"


def brute_force(texts, length):
    """n_bytes, n_removed, n_spans and digest of what is left, for every text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t) + 2, dtype=bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i + 1 : i + 1 + length] = True
        left = bytes(np.frombuffer(t, dtype=np.uint8)[~gone[1:-1]])
        out.append((len(t), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), sha256(left).hexdigest()))
    return out


def _texts(rng, n, size, letters):
    return [bytes(rng.integers(97, 97 + letters, rng.integers(0, size)).astype(np.uint8)).decode() for _ in range(n)]


@pytest.mark.parametrize("letters, n", [(1, 700), (2, 3000), (26, 5000), (3, 1), (4, 9)])
def test_suffix_array_and_common_prefixes(letters, n):
    rng = np.random.default_rng(n)
    data = rng.integers(97, 97 + letters, n).astype(np.uint8)
    if n > 2000:
        data[1500:2300] = data[100:900]
    order = suffix_dedup.suffix_array(data, 2 * n + 16)
    raw = data.tobytes()
    assert order.tolist() == sorted(range(n), key=lambda i: raw[i:])
    got = suffix_dedup.common_prefixes(data, order, 300, stretch=64)

    def common(a, b):
        k = 0
        while k < 300 and max(a, b) + k < n and raw[a + k] == raw[b + k]:
            k += 1
        return k

    assert got.tolist() == [0] + [common(a, b) for a, b in zip(order[:-1], order[1:])]


@pytest.mark.parametrize("seed", range(30))
def test_repeats_longer_than_the_sorted_depth(seed):
    rng = np.random.default_rng(seed)
    passage = rng.integers(97, 101, 100).astype(np.uint8).tobytes()
    bodies = [rng.integers(97, 101, 150).astype(np.uint8).tobytes() + passage for _ in range(8)]
    place, _, count = suffix_dedup.repeated_windows(bodies, np.ones(8, dtype=np.int64), 40)
    seen = Counter(b[i : i + 40] for b in bodies for i in range(len(b) - 39))
    want = [k * 250 + i for k, b in enumerate(bodies) for i in range(len(b) - 39) if seen[b[i : i + 40]] > 1]
    assert sorted(place[count >= 2].tolist()) == want


def test_equal_windows_have_one_anchor():
    s = Settings(length=40, gram=16)
    rng = np.random.default_rng(5)
    texts = [t.encode() for t in _texts(rng, 60, 400, 2) if len(t) >= 40]
    texts += [texts[0][7:90] + texts[1], b"a" * 200, b"ab" * 100]
    texts = [t for t in texts if len(t) >= 40]
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    at, starts, anchor, owner = suffix_dedup.segments(data, ends, s)
    assert all(a <= o <= a + n - 1 + 24 for a, n, o in zip(at, starts, owner))
    windows = {}
    begin = 0
    for t in texts:
        for i in range(len(t) - 39):
            k = np.searchsorted(at, begin + i, side="right") - 1
            assert at[k] <= begin + i < at[k] + starts[k]
            windows.setdefault(t[i : i + 40], set()).add(int(anchor[k]))
        begin += len(t)
    assert {len(v) for v in windows.values()} == {1}
    assert sum(starts) == sum(len(t) - 39 for t in texts)


def _check(spark, texts, settings, ids=None):
    ids = ids or list(range(len(texts)))
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in zip(ids, texts)], "doc_id long, text string, ranges string, rows int")
    rows = suffix_dedup.repeats(docs.repartition(5), settings).collect()
    want = [(k, *r) for k, r in zip(ids, brute_force(texts, settings.length))]
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)
    return docs


@pytest.mark.parametrize("hot, shard, stride", [(2000, 4 << 20, 16), (2, 500, 8), (1, 500, 1), (3, 2000, 40)])
def test_against_brute_force(spark, hot, shard, stride):
    rng = np.random.default_rng(11)
    texts = _texts(rng, 60, 600, 4)
    part = _texts(rng, 1, 2000, 26)[0] + "é" * 60
    texts += [a + part[k : k + 30 + 11 * k] + b for k, (a, b) in enumerate(zip(texts[:40], texts[20:]))]
    texts += [texts[3]] * 4 + ["a" * 500, "a" * 39, "a" * 40, "ab" * 300, None, None, "", "ü" * 21]
    # one passage, shorter than the length, in many rows
    texts += [a[:50] + part[:36] + b[:50] for a, b in zip(texts[:50], texts[7:])]
    # one with the length, and one longer
    texts += [a[:30] + part[100:140] + b[:30] for a, b in zip(texts[:50], texts[5:])]
    texts += [a[:45] + part[200:300] + b[:45] for a, b in zip(texts[:50], texts[3:])]
    _check(spark, texts, Settings(length=40, gram=16, hot=hot, shard_bytes=shard, stride=stride, filter_bits=1 << 10))


def test_odd_rows(spark):
    s = Settings(length=40, gram=16)
    long = "".join(chr(97 + int(x)) for x in np.random.default_rng(2).integers(0, 26, 300_000))
    texts = [long, "q" + long[150_000:150_100], long[5:100], long[5:100], "ä" * 30 + "x", "é" + "ä" * 30, None, ""]
    ids = [1, 1, 2, 2, None, None, None, 7]
    docs = _check(spark, texts, s, ids)
    left = suffix_dedup.without_repeats(docs, s)
    assert left.columns == docs.columns
    assert max((r.text or "" for r in left.collect()), key=len).startswith(long[:5] + long[100:200])
    assert [r.text for r in left.collect()].count(None) == 1
    assert suffix_dedup.repeats(docs.limit(0), s).isEmpty()


def test_very_long_text_in_parts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_PIECE", 300)
    parts = list(suffix_dedup._pieces([b"x" * 40, bytes(range(256)) * 5, b"y" * 90], 40))
    assert all(len(p) <= 339 for run in parts for *_, p in run)
    starts = [(k, o + i) for run in parts for k, o, p in run for i in range(len(p) - 39)]
    assert starts == [(0, 0), *((1, i) for i in range(1241)), *((2, i) for i in range(51))]


def test_query_on_given_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    rows = QUERIES["op12_suffix_dedup"](spark, FOLDER).collect()
    want = [(d.doc_id, *r) for d, r in zip(docs, brute_force([d.text for d in docs], 400))]
    assert sorted(map(tuple, rows)) == sorted(want)
    assert sum(r.n_removed for r in rows) > 10_000 and any(0 < r.n_removed < r.n_bytes for r in rows)
