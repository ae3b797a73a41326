"""Held-out accuracy, and defined scores for odd rows."""

from zlib import crc32

import numpy as np

from tablewise.llm import toxicity
from tablewise.llm.queries import QUERIES


def test_held_out_accuracy_of_the_query(spark):
    folder = "/root/testdata/sf0.1"
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = QUERIES["op1_toxicity"](spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(marks[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in marks]
    toxic = [p for y, p in held if y == 1]
    clean = [p for y, p in held if y == 0]
    assert sum(toxic) >= 0.8 * len(toxic) and sum(clean) <= 0.02 * len(clean)


def made(n, seed=0):
    rng = np.random.default_rng(seed)
    texts, marks = [], []
    for i in range(n):
        words = [f"w{rng.integers(400)}" for _ in range(rng.integers(5, 60))]
        if i % 4 == 0:
            words[rng.integers(len(words))] = f"vile{rng.integers(1000)}"
        texts.append(" ".join(words).encode())
        marks.append(int(i % 4 == 0))
    return texts, marks


def test_stems_of_unseen_words_count():
    model = toxicity.train(*made(800))
    texts, marks = made(200, seed=1)
    _, predicted = toxicity.scorer(model)()(texts)
    assert np.mean(predicted == np.array(marks)) > 0.95


def test_one_label_and_no_labels():
    assert toxicity.scorer(toxicity.train([b"a", b"b"], [0, 0]))()([b"a", None])[1].tolist() == [0, 0]
    assert toxicity.scorer(toxicity.train([b"a"], [1]))()([b"a"])[1].tolist() == [1]
    assert toxicity.scorer(toxicity.train([], []))()([b"a"])[1].tolist() == [0]


def test_odd_rows_and_tables(spark):
    model = toxicity.train(*made(800))
    long = "w1 " * 200_000 + "vile17"
    rows = [(1, None, 1), (2, "", 2), (3, "vile3", 3), (3, "vile3", 3), (4, long, 4), (None, "w1 w2 w3 w4 w5 w6 w7", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = {r.doc_id: (r.score, r.predicted) for r in toxicity.score(docs, model).collect()}
    assert got[1] == got[2] and got[3][1] == got[4][1] == 1 and got[None][1] == 0
    left = toxicity.reject(docs, model)
    assert left.columns == docs.columns and left.where("doc_id IN (3, 4)").count() == 0
    assert left.where("doc_id IS NULL").count() == 1
    assert toxicity.reject(docs.limit(0), model).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()} == {0}


def test_language_is_read_from_the_text():
    texts = [b"der Hund und die Katze", b"the dog and the cat", "le chien et les chats".encode(), b"xyz", b""]
    words = toxicity._Words(toxicity.Settings())
    ids, starts = toxicity._flat(texts, words)
    tells = np.array([0, *words.tells])
    names = [toxicity.LANGUAGES[k] for k in toxicity._guess(ids, starts, tells)]
    assert names == ["de", "en", "fr", "other", "other"]


def test_pooling_is_a_plain_convolution():
    """Every place of a text and its two zeros against loops; texts do not see each other."""
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(30, 6))
    vectors[0] = 0
    filters = [rng.normal(size=(w, 6, 4)) for w in (1, 2, 3)]
    bias = rng.normal(size=12)
    texts = [rng.integers(1, 30, n).tolist() for n in (1, 2, 3, 9, 1, 40)] + [[0]]
    ids, starts = [], []
    for t in texts:
        starts.append(len(ids))
        ids += [*t, 0, 0]
    ids, starts = np.array(ids), np.array(starts)
    got = toxicity._pool(toxicity._reach(filters, vectors), ids, starts, bias)
    for row, t in zip(got, texts):
        padded = [*t, 0, 0]
        want = [
            max(sum(vectors[padded[p + j]] @ f[j][:, k] for j in range(len(f))) for p in range(len(padded) - len(f) + 1))
            for f in filters
            for k in range(4)
        ]
        assert np.allclose(row, np.array(want) + bias)


def test_a_score_does_not_depend_on_the_texts_around():
    model = toxicity.train(*made(400))
    texts, _ = made(60, seed=2)
    together, _ = toxicity.scorer(model)()(texts)
    alone = [toxicity.scorer(model)()([t])[0][0] for t in texts]
    other, _ = toxicity.scorer(model)()(texts[::-1])
    assert np.allclose(together, alone, atol=1e-6) and np.allclose(together, other[::-1], atol=1e-6)
