"""Held-out accuracy, and votes against plain sums over all neighbours."""

from zlib import crc32

import numpy as np

from tablewise.llm import quality_knn as qk
from tablewise.llm.queries import QUERIES


def test_held_out_accuracy_of_the_query(spark):
    folder = "/root/testdata/sf0.1"
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = QUERIES["op4_quality"](spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(marks[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in marks]
    bad = [p for y, p in held if y == 0]
    good = [p for y, p in held if y == 1]
    assert sum(bad) <= 0.05 * len(bad) and sum(good) >= 0.98 * len(good)


def test_vote_against_plain_sums():
    rng = np.random.default_rng(3)
    s = qk.Settings(neighbours=5, power=2.0)
    known = qk._unit(rng.normal(size=(40, 8)).astype(np.float32))
    y = rng.integers(0, 2, 40).astype(np.float32)
    model = qk.Model(s, None, None, known, y, 0.5)
    probes = qk._unit(rng.normal(size=(30, 8)).astype(np.float32))
    for probe, got in zip(probes, qk.vote(model, probes, block=7)):
        close = sorted(((float(probe @ k), n) for n, k in enumerate(known)), reverse=True)[:5]
        w = [max(c, 0) ** 2 for c, _ in close]
        assert abs(got - sum(a * y[n] for a, (_, n) in zip(w, close)) / sum(w)) < 1e-5


def test_odd_rows_and_tables(spark):
    texts = [b"good words here for all %d" % i for i in range(20)] + [b"### $$$ *** %d" % i for i in range(20)]
    model = qk.train(texts, [1] * 20 + [0] * 20)
    rows = [(1, None, "a"), (2, "", "b"), (3, "good words here", "c"), (3, "good words here", "c"), (4, "### " * 100_000, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = {r.doc_id: (r.score, r.predicted) for r in qk.score(docs, model).collect()}
    assert got[1] == got[2] == (0.5, 1) and got[3][1] == 1 and got[4][1] == 0
    assert qk.score(docs.limit(0), model).count() == 0
    labels = spark.createDataFrame([(9, 1)], "doc_id long, quality int")
    none = qk.fit(docs, labels)
    assert {r.score for r in qk.score(docs, none).collect()} == {0.5}


def test_ties_go_to_the_smaller_ids():
    """Of neighbours at one similarity those that come first in the model, which is sorted by id."""
    rng = np.random.default_rng(9)
    known = qk._unit(rng.normal(size=(6, 8)).astype(np.float32))[rng.integers(0, 6, 50)]
    y = rng.integers(0, 2, 50).astype(np.float32)
    model = qk.Model(qk.Settings(neighbours=7, power=1.0), None, None, known, y, 0.5)
    probes = np.concatenate([known[:4], qk._unit(rng.normal(size=(20, 8)).astype(np.float32))])
    for block in (1, 5, 256):
        for probe, got in zip(probes, qk.vote(model, probes, block=block)):
            close = sorted((-round(float(probe @ k), 5), n) for n, k in enumerate(known))[:7]
            w = [max(-c, 0) for c, _ in close]
            want = sum(a * y[n] for a, (_, n) in zip(w, close)) / sum(w) if sum(w) else 0.5
            assert abs(got - want) < 1e-4


def test_space_is_that_of_a_plain_decomposition():
    """On a small table: similarities in the space against those of numpy's own truncated SVD."""
    rng = np.random.default_rng(2)
    topics = [[b"w%d" % rng.integers(20 * t, 20 * t + 20) for _ in range(400)] for t in range(4)]
    texts = [b" ".join(rng.choice(topics[k % 4], 60)) for k in range(80)]
    s = qk.Settings(dimensions=6)
    model = qk.train(texts, [k % 2 for k in range(80)], s)
    bags = qk._unit(qk._bags(texts, qk._Words(s)) * model.rarity)
    plain = np.linalg.svd(bags, full_matrices=False)[2][:6].T
    one, two = qk._unit(bags @ plain), model.vectors
    assert np.abs(one @ one.T - two @ two.T).max() < 0.05
